"""Quality by a regularised quadratic discriminant over transformed statistics of whole texts.

Statistics are computed once per document and written; class means and covariances come from sums that every partition adds
up (d x d numbers each), so all labelled rows count and none is collected. Covariances shrink towards their diagonal and
towards the pooled covariance. A score is the logistic of the difference of the two log densities (Mahalanobis distances by
cached Cholesky factors, log determinants and log priors).

Defined cases: a null or empty text has all-zero statistics and is scored like any other; a row without label isn't learnt
from; repeated rows are scored alike; without labels of both classes every score is the prior (0.5 with none at all); an
empty table gives no rows; columns other than doc_id and text (and quality of the labels) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import base_columns, small_batches, written

NAMES = ("word_length", "upper", "symbols", "pipes", "bangs", "digits", "stops", "other_marks", "distinct", "repeats", "top_word", "line_copies", "line_words", "short_words", "hyper_words")
SHRINK_DIAGONAL, SHRINK_POOLED, LEAST_VARIANCE = 0.1, 0.1, 1e-3
_CLASS = np.full(256, 0, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>@^~=+_\\{}[]", b"|", b"!?", b"0123456789", b".,;:", b"\"'()/-`"), 1):
    _CLASS[list(_chars)] = _k


def statistics(text: str | None) -> list[float]:
    """The numbers NAMES of a whole text, transformed to be roughly bell-shaped over clean documents."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper, symbols, pipes, bangs, digits, stops, marks = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=8)[1:8] / len(raw)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log(lengths.mean())), root(upper), root(symbols), root(pipes), root(bangs), root(digits), root(stops), root(marks),
        float(np.log1p(n) - np.log1p(len(counts))), root(repeats), root((max(counts.values()) - 1) / n), root(1 - len(set(lines)) / max(len(lines), 1)),
        float(np.log(n / max(len(lines), 1))), root((lengths <= 2).mean()), root((lengths > 24).mean()),
    ]


def statistic_table(keyed: DataFrame) -> DataFrame:
    """All columns of ``keyed`` but text, and x, the statistics of text."""
    others = [c for c in keyed.columns if c != "text"]
    schema = keyed.select(*others).schema.add("x", T.ArrayType(T.DoubleType()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(x, pa.list_(pa.float64()))], names=[*others, "x"])

    small_batches(keyed.sparkSession)
    return keyed.mapInArrow(measure, schema)


@dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of ``x``."""
        d = []
        for k in (0, 1):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            d.append(self.log_priors[k] - 0.5 * ((z * z).sum(0) + self.log_dets[k]))
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def moments(labelled: DataFrame, d: int = len(NAMES)) -> np.ndarray:
    """(2, 1 + d + d*d) sums over the rows (label, x) of each class: count, x and its products. One row per task reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, d)
                y = b.column("label").to_numpy()
                for k in (0, 1):
                    own = x[y == k]
                    total[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = labelled.select("label", "x").mapInArrow(add, "sums array<double>")
    # summed by Spark number by number: 2 * (1 + d + d * d) rows, whatever the input
    rows = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * (1 + d + d * d))
    for r in rows:
        out[r.i] = r.v
    return out.reshape(2, -1)


def fit(sums: np.ndarray, d: int = len(NAMES)) -> Discriminant | float:
    """The discriminant, or the share of class 1 where one class has no rows."""
    n = sums[:, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    means = sums[:, 1 : 1 + d] / n[:, None]
    scatter = sums[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    factors, log_dets = [], []
    for k in (0, 1):
        own = scatter[k] / n[k]
        c = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c)) + LEAST_VARIANCE * np.eye(d)
        factors.append(np.linalg.cholesky(c))
        log_dets.append(2 * np.log(np.diag(factors[k])).sum())
    return Discriminant(means, np.array(factors), np.array(log_dets), np.log(n / n.sum()))


#: Labelled ids to which ``keep_good`` fits (12 bytes each).
MOST_LABELLED = 50_000


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document's labels are kept for tests: CRC-32 of its id as text modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def known_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, label of the rows whose label isn't held out; contradictory labels of an id are two rows."""
    return labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label")).distinct()


def learn(table: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | float:
    """Fit to the rows of ``table`` (doc_id, x) whose label isn't held out; contradictory labels of an id count as two rows."""
    return fit(moments(table.select("doc_id", "x").join(known_labels(labels, label), "doc_id")))


def scored(table: DataFrame, model: Discriminant | float) -> DataFrame:
    """``table`` with score for its statistics x, or where it has none for those of its text, in one pass."""
    source = "x" if "x" in table.columns else "text"
    others = table.drop(source).columns
    schema = table.drop(source).schema.add("score", T.DoubleType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(source).to_pylist()
            x = np.array(rows if source == "x" else [statistics(t) for t in rows], np.float64).reshape(-1, len(NAMES))
            s = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(s)], names=[*others, "score"])

    small_batches(table.sparkSession)
    return table.mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    table = written(statistic_table(base_columns(docs, "doc_id", "text")), "statistics")
    found = scored(table, learn(table, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = MOST_LABELLED) -> DataFrame:
    """``docs`` without the rows scored under ``least``. No text is shuffled or written.

    The fit takes the labelled ids with the smallest hashes, ``most`` at most, which are broadcast; statistics of other rows are taken once, as they are scored.
    """
    chosen = known_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    sample = base_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    model = fit(moments(statistic_table(sample.select("doc_id", "label", "text"))))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    return scored(row, model).where(F.col("score") >= least).select("row.*")
