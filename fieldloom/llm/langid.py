"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per page: the likelihood of its visible text under character-trigram models,
the likelihoods of the language that its markup declares and of the suffix of its address, and a prior of its host. Likelihoods of
declarations and suffixes and the host priors are counts of first-pass posteriors (text alone), added up by grouped aggregation.
Priors are smoothed down a hierarchy: all pages, registered domain, host; every level is drawn towards the one above it by
STRENGTH pages, and a page's own count is left out of its prior and of its likelihoods.

Defined cases: a null html has no text and no declaration, a null url has no host and suffix, and such evidence is left out;
a page without any evidence gets the prior of all pages; texts of any length are read whole, in time proportional to their length
whatever they hold (their likelihood is tempered to TEMPER effective trigrams, so that long texts don't drown the rest); markup
that never ends is text, an unclosed script's contents too; every row gives one row; an empty table gives none;
without training documents all languages of LANGUAGES weigh the same; other columns are ignored.

The trigram models learn from at most MOST_DOCUMENTS documents, drawn by a hash of their id.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

LANGUAGES = ("de", "en", "es", "fr")
MOST_DOCUMENTS, BUCKETS, SMOOTH, TEMPER = 4_000, 1 << 14, 0.5, 200.0
#: Pages that a level of the prior hierarchy weighs against its own counts; pseudo-count of each declaration and suffix.
STRENGTH, PSEUDO = 5.0, 1.0
HIDDEN = re.compile(r"(?i)(script|style|noscript)\b")
CLOSERS = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript")}
HTML = re.compile(r"(?i)<html\b")
DECLARED = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2})""")
#: Character references of more digits than any character has.
HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


def declared(page: str | None) -> str | None:
    """The two letters of the language that the first html tag declares."""
    m = HTML.search(page or "")
    if not m:
        return None
    end = page.find(">", m.end())
    found = DECLARED.search(page, m.end(), len(page) if end < 0 else end)
    return found[1].lower() if found else None


def visible(page: str | None) -> str:
    """The text that a reader of the page sees. Each kind of closing mark is looked for from left to right once."""
    page = page or ""
    out, at, closers, ahead = [], 0, {}, {}

    def closed(kind: str, begin: int) -> int:
        """Where the next closing tag of an element ends, -1 if there is none."""
        tags = closers.setdefault(kind, CLOSERS[kind].finditer(page))
        m = ahead.get(kind) or next(tags, None)
        while m and m.start() < begin:
            m = next(tags, None)
        ahead[kind] = m
        return m.end() if m else -1

    last_comment, last_tag = page.rfind("-->"), page.rfind(">")
    while 0 <= (i := page.find("<", at)) < last_tag:
        end = -1
        if page.startswith("<!--", i) and last_comment >= i + 4:
            end = page.find("-->", i + 4) + 3
        elif m := HIDDEN.match(page, i + 1):
            end = closed(m[1].lower(), m.end())
        out.append(page[at:i])
        at = end if end > 0 else page.find(">", i) + 1
    out.append(page[at:])
    return html.unescape(HUGE.sub("\ufffd", " ".join(out)))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of the lower-cased text, runs of white space as one blank."""
    points = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(2654435761) ^ points[1:-1] * np.uint64(40503)) * np.uint64(31) + points[2:] * np.uint64(97)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """(languages, BUCKETS) log probabilities of trigrams, from documents with a known language."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCUMENTS)
    sample = known.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most MOST_DOCUMENTS ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                total[languages.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        where = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(total[where[:, 0], where[:, 1]])], names=["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    counts = np.zeros((len(languages), BUCKETS))
    # at most languages x BUCKETS rows, whatever the input
    for r in sample.mapInArrow(count, "lang bigint, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.lang, r.bucket] = r.n
    counts += SMOOTH
    return np.log(counts / counts.sum(1, keepdims=True))


def likelihoods(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """page_id, url, declared (or null), n_trigrams and ``text``, the tempered log likelihood of each language."""
    names = ["page_id", "url", "declared", "n_trigrams", "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, n, logs = [], [], []
            for page in b.column("html").to_pylist():
                t = trigrams(visible(page))
                log = model[:, t].sum(1) if len(t) else np.zeros(len(model))
                langs.append(declared(page))
                n.append(len(t))
                logs.append((log * min(1.0, TEMPER / max(len(t), 1))).tolist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(langs, pa.string()), pa.array(n, pa.int64()), pa.array(logs, pa.list_(pa.float64()))], names=names)

    small_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id bigint, url string, declared string, n_trigrams bigint, text array<double>")


def softmax(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials of an array."""
    most = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - most))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, y: a + y))


def address(url: Column) -> tuple[Column, Column, Column]:
    """host, registered domain (its last three labels or fewer, without the first of more) and suffix of an address; null without a host."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    size = F.least(F.size(labels), F.lit(3))
    return host, F.array_join(F.slice(labels, -size, size), "."), F.element_at(labels, -1)


def sums(rows: DataFrame, key: str, k: int) -> DataFrame:
    """key, n_<key>: sums of the posteriors of all pages of each key, one per language."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("first")[i]) for i in range(k)]).alias(f"n_{key}"))


def fuse(scored: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Posteriors of pages from ``likelihoods``: page_id, host, declared, text_lang, lang, probability, posterior, host_prior."""
    k = len(languages)
    host, domain, suffix = address(F.col("url"))
    first = written(scored.withColumns({"host": host, "domain": domain, "suffix": suffix, "first": softmax(F.col("text"))}), "langid")
    total = lambda name: F.array(*[F.coalesce(F.sum(F.col(name)[i]), F.lit(0.0)) for i in range(k)])
    rows = first.crossJoin(F.broadcast(first.agg(total("first").alias("n_all"))))  # one row
    for key in ("domain", "host"):
        rows = rows.join(sums(first, key, k), key, "left")
    for key in ("declared", "suffix"):
        counts = sums(first, key, k)
        rows = rows.join(counts, key, "left").crossJoin(F.broadcast(counts.agg(total(f"n_{key}").alias(f"all_{key}"), F.count("*").alias(f"kinds_{key}"))))  # one row
    own = F.col("first")
    none = F.array(*[F.lit(0.0)] * k)

    def without_own(counts: Column) -> Column:
        return F.zip_with(F.coalesce(counts, own), own, lambda n, o: F.greatest(n - o, F.lit(0.0)))

    def level(counts: Column, above: Column) -> Column:
        """Counts without the page's own, drawn towards the level above."""
        rest = without_own(counts)
        total = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, above, lambda n, p: (n + STRENGTH * p) / (total + STRENGTH))

    prior = F.array(*[F.lit(1.0 / k)] * k)
    for n, key in enumerate(("n_all", "n_domain", "n_host")):
        rows = rows.withColumn(f"prior{n}", level(F.col(key), prior))
        prior = F.col(f"prior{n}")

    def evidence(key: str) -> Column:
        """Log of how likely a value is in each language among the pages that have one, by counts without the page's own; zero without a value."""
        share = F.zip_with(without_own(F.col(f"n_{key}")), without_own(F.col(f"all_{key}")), lambda n, a: F.log((n + PSEUDO) / (a + PSEUDO * F.col(f"kinds_{key}"))))
        return F.when(F.col(key).isNull(), none).otherwise(share)

    logs = F.zip_with("text", F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b)
    for key in ("declared", "suffix"):
        logs = F.zip_with(logs, evidence(key), lambda a, b: a + b)
    posterior = rows.withColumn("posterior", softmax(logs))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return posterior.select(
        "page_id", "host", "declared", F.when(F.col("n_trigrams") > 0, best(F.col("text"))).alias("text_lang"), best(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("probability"), "posterior", F.col("prior2").alias("host_prior"),
    )


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Language and probability of every page of ``pages``; trigram models from ``docs``."""
    return fuse(likelihoods(pages, train(docs)))
