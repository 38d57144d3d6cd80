"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit for each rule; policies are
versioned masks over these bits and can be applied, compared and ablated later without reading a text again.

Defined cases: a null text counts as empty (no words, so ``few_words`` fails); very long texts stay one row; every input
row, also a repeated one, gives one ledger row; an empty table gives an empty ledger; columns other than doc_id and text
are ignored. Repeated windows are found by 64-bit hashes of five words in one document, where a collision is too rare to
matter (under 1e-9 for a text of 100,000 words).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base_columns, written

#: White space of the contract as characters, and the pattern of its runs.
BLANKS, BLANK_RUN, WORD = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SHINGLE = 5

#: name: the condition that fails a document, over the measurements. A rule's bit is its place here; add new ones at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_upper > word_chars",
}
BASE = ("few_words", "repeated_words")
#: version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbols", "capitals"), "v2": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def measured(keyed: DataFrame) -> DataFrame:
    """doc_id (any type) and the measurements of the whole text."""
    t, none = F.col("t"), F.lit(0)
    rows = keyed.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select(
        "doc_id",
        F.split(F.btrim(t, F.lit(BLANKS)), BLANK_RUN).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
    )
    rows = rows.select(
        "doc_id", "w", "n_symbols", "n_upper",
        F.when(F.get("w", none) == "", none).otherwise(F.size("w")).alias("n"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    w = F.col("w")
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    rows = rows.withColumn("h", F.when(F.col("n") >= SHINGLE, F.transform(F.sequence(none, F.col("n") - SHINGLE), window)))
    # positions of equal windows meet in one sort, which only texts with a repeated window need
    twice = F.size("h") > F.size(F.array_distinct("h"))
    rows = rows.withColumn("s", F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("s")
    at = lambda j: F.get(s, j)
    same = lambda j: F.when((at(j)["x"] == at(j - 1)["x"]) | (at(j)["x"] == at(j + 1)["x"]), at(j)["i"])
    places = F.sort_array(F.filter(F.transform(F.sequence(none, F.size(s) - 1), same), lambda p: p.isNotNull()))
    rows = rows.withColumn("p", F.when(s.isNotNull(), places))
    end = lambda a, p: F.struct((p + SHINGLE).alias("e"), (a["n"] + p + SHINGLE - F.greatest(a["e"], p)).alias("n"))
    covered = F.aggregate("p", F.struct(none.alias("e"), none.alias("n")), end, lambda a: a["n"])
    found = rows.select(
        "doc_id", F.col("n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(F.col("p").isNotNull(), covered), none).cast("bigint").alias("n_repeat_words"), "n_lines", "n_upper",
    )
    # a generator stands in the way of filters on measurements, which the optimiser would else push below and evaluate word by word
    return found.select(F.inline(F.array(F.struct(*found.columns))))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: bit k is set if the k-th of RULES fails the document."""
    return with_bits(measured(base_columns(docs, "doc_id", "text")))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """As ``ledger``, written to the shared folder: policies and ablations read it and no text."""
    return written(ledger(docs), "ledger")


def with_bits(rows: DataFrame) -> DataFrame:
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("fail_bits", total.cast("bigint"))


def apply_policy(rows: DataFrame, version: str = "v1", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``rows`` of a ledger with base_failed and kept under the policy."""
    fails = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("bigint")) != 0
    return rows.withColumn("base_failed", fails(BASE)).withColumn("kept", ~F.col("base_failed") & ~fails(policies[version]))


def ablations(rows: DataFrame, version: str = "v1", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (documents that it alone rejects), and all bits that occur with it.

    One pass over the ledger: counts and a bitwise OR of the failure bits.
    """
    m, names = F.col("fail_bits").bitwiseAND(F.lit(mask(policies[version])).cast("bigint")), list(RULES)
    aggregates = []
    for r in policies[version]:
        bit = F.lit(1 << names.index(r)).cast("bigint")
        aggregates += [F.count_if(m.bitwiseAND(bit) != 0).alias(f"failed_{r}"), F.count_if(m == bit).alias(f"only_{r}"), F.coalesce(F.bit_or(F.when(m.bitwiseAND(bit) != 0, m)), F.lit(0)).alias(f"with_{r}")]
    one = rows.agg(*aggregates)
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"failed_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only"), F.col(f"with_{r}").alias("with_bits")) for r in policies[version]])))


def with_ablation(rows: DataFrame, version: str = "v1", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``rows`` of a stored ledger under a policy, with n_saved: how many documents the policy would keep more of without the rule that alone rejects this one (else null)."""
    m = F.col("fail_bits").bitwiseAND(F.lit(mask(policies[version])).cast("bigint"))
    # one row: the count of each rule, from the report of as many rows as the policy has rules
    counts = ablations(rows, version, policies).agg(F.map_from_entries(F.collect_list(F.struct("rule", "n_only"))).alias("_counts"))
    names = list(RULES)
    alone = F.coalesce(*[F.when(m == F.lit(1 << names.index(r)).cast("bigint"), F.lit(r)) for r in policies[version]])
    return apply_policy(rows, version, policies).crossJoin(F.broadcast(counts)).withColumn("n_saved", F.try_element_at("_counts", alone)).drop("_counts")


def keep_passing(docs: DataFrame, version: str = "v1") -> DataFrame:
    """``docs`` without the rows that the policy rejects. Rules are evaluated beside the row, so nothing is shuffled."""
    row = F.struct(*[docs[c] for c in docs.columns])
    judged = apply_policy(with_bits(measured(docs.select(row.alias("doc_id"), docs["text"].cast("string").alias("text")))), version)
    return judged.where("kept").select("doc_id.*")
