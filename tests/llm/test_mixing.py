import hashlib
import math
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import duckdb
from pyspark.sql import functions as F

from fieldloom.llm import mixing, queries

from .conftest import ROWS


def plain_copies(key, rate, seed=mixing.SEED):
    u = (int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while c < u and k < 500:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_follow_the_draws(few):
    docs = few[0]
    rows = docs.select("doc_id", "source").collect()
    counts = Counter(r.source for r in rows)
    rate = {s: len(rows) / (len(counts) * n) for s, n in counts.items()}
    expected = Counter({r.doc_id: plain_copies(r.doc_id, rate[r.source]) for r in rows})
    found = mixing.replicate(docs).collect()
    assert Counter(r.doc_id for r in found) == +expected
    assert all(sorted(x.copy for x in found if x.doc_id == r.doc_id) == list(range(r.n_copies)) for r in found[:30])


def test_means(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'small' ELSE 'large' END AS source")
    n = {r.source: r["count"] for r in mixing.replicate(docs, {"small": 3.0, "large": 1.0}).groupBy("source").count().collect()}
    assert abs(n["small"] - 30_000) < 1_000 and abs(n["large"] - 10_000) < 500


def test_order_is_global(few):
    keys = [r.order_key for r in mixing.replicate(few[0]).select("order_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_odd_rows(odd, no_rows):
    found = mixing.replicate(odd, rows=10 * len(ROWS))
    assert found.columns == [*odd.columns, "rate", "n_copies", "copy", "order_key"]
    sources = {r.source for r in found.collect()}
    assert sources == {None, "s0"}
    assert mixing.replicate(no_rows).collect() == []
    assert {r.source for r in mixing.replicate(odd, {"s0": 1.0}, rows=200).collect()} == {"s0"}
    assert mixing.replicate(odd, {}).collect() == []


def quantiles(rate):
    """Cumulative probabilities by the log-gamma function, from far below the mean on, and their first k."""
    low = max(0, int(rate - 15 * math.sqrt(rate)))
    terms = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(low, int(rate + 15 * math.sqrt(rate)))]
    return low, list(accumulate(terms))


def test_rates_of_all_sizes(spark):
    """Also where exp(-rate) is zero or no normal double."""
    rates = [0.01, 1.0, 30.0, 300.0, 499.5, 500.5, 720.0, 800.0, 100_000.0, 1_000_000.0]
    docs = spark.range(200).withColumn("u", mixing.uniform(F.col("id"), mixing.SEED)).crossJoin(spark.createDataFrame([(x,) for x in rates], "rate double"))
    rows = docs.withColumn("k", mixing.inverse_poisson(F.col("u"), F.col("rate"))).collect()
    for rate in rates:
        low, cumulative = quantiles(rate)
        own = [r for r in rows if r.rate == rate]
        assert [r.k for r in own] == [low + bisect_left(cumulative, r.u) for r in own]
        assert abs(sum(r.k for r in own) / len(own) - rate) < 5 * math.sqrt(rate / len(own))


def test_a_rare_source_meets_its_share(spark):
    docs = spark.range(40_020).selectExpr("id AS doc_id", "CASE WHEN id < 20 THEN 'rare' ELSE 'hot' END AS source")
    n = {r.source: r["count"] for r in mixing.replicate(docs).groupBy("source").count().collect()}
    assert abs(n["rare"] - 20_010) < 5 * math.sqrt(20_010)


def test_sql_and_spark_on_a_skewed_table(spark, tmp_path):
    """One document of a rare source against 20,000 of the others: the rate of the rare one is 10,000.5."""
    docs = spark.range(20_001).selectExpr("id AS doc_id", "concat('t', id % 7) AS text", "'en' AS lang", "CASE WHEN id = 5 THEN 'rare' ELSE 'hot' END AS source", "2L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = c.execute(f"SELECT doc_id, source, n_copies, copy, order_key FROM ({queries.SQL['op10_mixing']})").fetchall()
    found = [tuple(r) for r in queries.op10_mixing(spark, str(tmp_path)).select("doc_id", "source", "n_copies", "copy", "order_key").collect()]
    assert sorted(found) == sorted(expected) and sum(r[0] == 5 for r in found) > 9_000


def test_many_sources_are_joined_by_salted_keys(spark, odd, monkeypatch):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('s', id % 50) END AS source")
    few = sorted(map(tuple, mixing.replicate(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(map(tuple, mixing.replicate(docs).collect()), key=str) == few
    assert mixing.replicate(odd.limit(0)).collect() == []


def test_null_and_empty_sources(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'a' END AS source", "7 AS rate", "'x' AS copy")
    found = mixing.replicate(docs, {"": 1.0})
    assert found.columns == ["doc_id", "source", "rate", "n_copies", "copy", "order_key"]
    assert {r.source for r in found.collect()} == {""} and abs(found.count() - 900) < 150


def test_very_many_copies_are_made_in_blocks(spark, monkeypatch):
    """A rare source's row has some thousand copies: the same rows in blocks dealt to tasks as in one array."""
    docs = spark.range(3_000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN 'rare' ELSE 'hot' END AS source", "'t' AS text")
    whole = mixing.replicate(docs).select("doc_id", "copy", "n_copies", "order_key").collect()
    monkeypatch.setattr(mixing, "BLOCK_COPIES", 64)
    parts = mixing.replicate(docs).select("doc_id", "copy", "n_copies", "order_key").collect()
    assert parts == whole and sum(r.doc_id == 7 for r in parts) > 1_300


def test_ten_million_copies_of_one_row(spark):
    row = spark.range(1).selectExpr("id AS doc_id", "10000000 AS n")
    made = mixing.numbered(row, "n", "copy", spread=True)
    found = made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("copy").alias("s")).collect()
    assert sum(r.n for r in found) == 10_000_000 and sum(r.s for r in found) == 10_000_000 * 9_999_999 // 2
    assert len(found) > 1 and max(r.n for r in found) < 5_000_000
    assert mixing.numbered(row.withColumn("n", F.lit(0)), "n", "copy").count() == 0
