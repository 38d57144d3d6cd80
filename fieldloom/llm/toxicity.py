"""Toxicity by a support vector machine with a gap-tolerant subsequence string kernel and Nyström landmarks.

A sentence's features are its subsequences of four letters (the start and the end of a word count as letters), each occurrence
weighted by DECAY to the number of characters that it spans (at most SPAN, so gaps and inserted characters lower a match but
don't end it) and divided by what a word of that length has with itself. Subsequences may run over one blank. Single letters with marks or
blanks between them ("i d-i o t") and marks inside a word ("id*iot") are first joined to one word. The kernel of two
sentences is the product of their features, so it sums the kernels of their words.

Training: sentences of labelled documents, with their document's label; a document is a bag of sentences. Words that toxic sentences have
significantly more often are counted in one grouped aggregation; they are the first landmarks, beside frequent and hash-drawn
words of clean sentences. A squared-hinge machine is fitted to Nyström features of sentences: of toxic documents those
with such a word, of clean ones WORST by hash. Then ROUNDS times every sentence of the sample is scored, the highest BEST of
toxic documents become the positive ones, the highest WORST of every clean document join the negative ones, and their highest
words the landmarks. As the features are finite, the machine folds into one weight for each four-letter subsequence, so a text
costs some table look-ups for each character. A document's margin is that of its highest sentence; the logistic is fitted to
documents of the sample that the machine hasn't seen, with both classes weighing the same.

Bounds of the fit: MOST_TOXIC and MOST_CLEAN labelled documents, drawn by a hash of their id (an id that repeats is as many documents as it has texts), LANDMARKS first landmarks, HARDER more in a
round, BEST sentences of a toxic document and WORST of a clean one in a round, LONGEST characters of a landmark. Sentences of any length stay on executors, where their
kernels are taken; the driver gets a row of Nyström features for each. Every document is scored whole.

Defined cases: a null or empty text, or one without letters, has the margin of a sentence without words; a row without label isn't learnt
from; repeated rows are scored alike; without labels of both classes every score is the share of toxic labels (0 with none);
an empty table gives no rows; columns other than doc_id and text (and toxic of the labels) are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import base_columns, scratch, small_batches, text_groups, written
from .vectors import unpacked

DECAY, SPAN, CLASSES, START, END = 0.6, 6, 41, 39, 40
#: Log-likelihood ratio from which a word counts as a witness.
LEAST_RATIO = 13.0
MOST_TOXIC, MOST_CLEAN, LANDMARKS, HARDER, ROUNDS, BEST, WORST = 1_500, 3_500, 320, 80, 3, 3, 2
#: Longest word that becomes a landmark, in characters (longer ones are learnt from and scored like any other); places whose features are summed at once.
LONGEST, STRETCH = 256, 1 << 21
#: Rows that a step of the fit takes at once.
BLOCK = 1024
#: One of so many documents of the sample is kept for the logistic.
FOLDS = 5
SENTENCE = re.compile(r"[^.!?|\n]+")
STOPS = ".!?|\n"
#: A single letter or digit, then marks or blanks, before another single one.
LONE = re.compile(r"(?<![^\W_])([^\W_])[\W_]{1,3}(?=[^\W_](?![^\W_]))")
#: Marks inside a word, other than those that end sentences and their parts.
INNER = re.compile(r"(?<=[^\W_])(?:[^\w\s.!?|,;:]|_){1,2}(?=[^\W_])")
WORD = re.compile(r"[^\W_]+")
#: Distances of the other three letters from the first.
STEPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def letter_classes() -> np.ndarray:
    """A class for each character of the basic plane: 0 none, 1-26 letters, 27 digits, others spread over 28-38."""
    table = np.zeros(1 << 16, np.int32)
    for c in range(1 << 16):
        if chr(c).isalnum():
            table[c] = 28 + c * 40503 % (START - 28)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = 27
    return table


_TABLE: list[np.ndarray] = []


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(text: str) -> np.ndarray:
    """Classes of the characters; that before a word is START, that after it END, if it isn't the START of the next."""
    if not _TABLE:
        _TABLE.append(letter_classes())
    codes = _TABLE[0][np.minimum(_points(text), 0xFFFF)]
    blank = codes == 0
    codes[1:][blank[1:] & ~blank[:-1]] = END
    codes[:-1][blank[:-1] & ~blank[1:]] = START
    return codes


def plain(text: str) -> str:
    """Lower case, with spelt-out single letters and words with inner marks joined."""
    return INNER.sub("", LONE.sub(r"\1", text.lower()))


def sentences(text: str | None) -> list[str]:
    """The different sentences of a text with a word in them, in plain form."""
    return [s for s in dict.fromkeys(SENTENCE.findall(plain(text or ""))) if WORD.search(s)]


@dataclass
class Layout:
    """Texts in one array of classes, with the number of the word and of the sentence of each place, and where texts begin."""

    codes: np.ndarray
    words: np.ndarray
    stops: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, parts: Sequence[str]) -> Layout:
        """``parts`` in plain form. Blanks are doubled, so that there is room for END and START between words."""
        doubled = [p.replace(" ", "  ").replace("\n", "\n\n") for p in parts]
        joined = f" {'  '.join(doubled)} "
        starts = np.concatenate([[0], np.cumsum([len(p) + 2 for p in doubled])]).astype(np.int64)
        codes, stop = classes(joined), np.isin(_points(joined), [ord(c) for c in STOPS])
        stop[starts[:-1]] = True
        return cls(codes, np.cumsum((codes == 0) | (codes == START), dtype=np.int32), np.cumsum(stop, dtype=np.int32), starts)

    def norms(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and the root of what each has with itself."""
        begins = np.flatnonzero(self.codes == START)
        if not len(begins):
            return begins, np.ones(0)
        letters = np.add.reduceat((self.codes > 0) & (self.codes < START), begins, dtype=np.int32)
        return begins, np.sqrt(self_kernel(np.arange(letters.max() + 1)))[letters]

    def matches(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each of STEPS: of all places the subsequence that begins there, whether it counts, and its weight."""
        codes, words, letter = self.codes, self.words, (self.codes > 0) & (self.codes < START)
        for x, y, z in STEPS:
            n = len(codes) - z
            if n <= 0:
                continue
            feature = ((codes[:n] * CLASSES + codes[x : n + x]) * CLASSES + codes[y : n + y]) * CLASSES + codes[z:]
            apart = words[z:] - words[:n]
            counts = (apart == 0) & (codes[:n] > 0)
            if z == SPAN - 1:  # the least that two words and the blank between them take
                counts |= (apart == 1) & letter[:n] & letter[x : n + x] & letter[y : n + y] & letter[z:] & (self.stops[z:] == self.stops[:n])
            yield feature, counts, DECAY ** (z + 1)


def self_kernel(lengths: np.ndarray) -> np.ndarray:
    """The kernel of a word of different letters with itself, by length; 1 for words too short to have a subsequence."""
    n = np.asarray(lengths, np.float64) + 2
    total = sum(np.maximum(n - c, 0) * DECAY ** (2 * (c + 1)) for *_, c in STEPS)
    return np.where(total > 0, total, 1.0)


def features(parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, feature, weight of all subsequences of sentences in plain form."""
    at = Layout.of(parts)
    begins, norms = at.norms()
    places, found, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for feature, counts, weight in at.matches():
        here = np.flatnonzero(counts)
        places.append(here)
        found.append(feature[here])
        weights.append(weight / norms[np.searchsorted(begins, here, side="right") - 1])
    place = np.concatenate(places)
    return np.searchsorted(at.starts, place, side="right") - 1, np.concatenate(found), np.concatenate(weights)


class Landmarks:
    """Features of the landmarks, to which kernels of any number of sentences are taken in bounded memory."""

    def __init__(self, marks: Sequence[str]):
        rows, found, values = features(marks)
        self.known, inverse = np.unique(found, return_inverse=True)
        self.right = np.zeros((len(self.known), len(marks)))
        np.add.at(self.right, (inverse, rows), values)
        self.place = np.full(CLASSES**4, -1, np.int32)
        self.place[self.known] = np.arange(len(self.known))

    def kernel(self, parts: Sequence[str]) -> np.ndarray:
        """Kernel matrix of sentences in plain form and the landmarks."""
        out = np.zeros((len(parts), self.right.shape[1]))
        for a, b in text_groups(list(parts), 500_000):
            both, sums = self._sums(parts[a:b])
            rows, cols = both // len(self.known), both % len(self.known)
            bounds = np.searchsorted(rows, np.arange(b - a + 1))
            for i in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[i], bounds[i + 1])
                out[a + i] = sums[own] @ self.right[cols[own]]
        return out

    def _sums(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the landmarks' features in each sentence, summed STRETCH places at a time: key (sentence and feature) and sum."""
        at = Layout.of(parts)
        begins, norms = at.norms()
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for feature, counts, weight in at.matches():
            for first in range(0, len(counts), STRETCH):
                here = np.flatnonzero(counts[first : first + STRETCH]) + first
                col = self.place[feature[here]]
                here, col = here[col >= 0], col[col >= 0]
                key = (np.searchsorted(at.starts, here, side="right") - 1) * len(self.known) + col
                both, inverse = np.unique(key, return_inverse=True)
                keys.append(both)
                sums.append(np.bincount(inverse, weight / norms[np.searchsorted(begins, here, side="right") - 1], minlength=len(both)))
        both, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return both, np.bincount(inverse, np.concatenate(sums), minlength=len(both))


def kernel(parts: Sequence[str], others: Sequence[str]) -> np.ndarray:
    """Kernel matrix of two lists of sentences in plain form."""
    return Landmarks(others).kernel(parts)


@dataclass
class Machine:
    """Weights of the subsequences, the bias, and the slope and shift of the logistic."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def table(self) -> np.ndarray:
        out = np.zeros(CLASSES**4, np.float32)
        out[self.features] = self.weights
        return out


def word_sums(at: Layout, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and what each adds to its sentence's margin."""
    begins, norms = at.norms()
    if not len(begins):
        return begins, np.zeros(0)
    gain = np.zeros(len(at.codes), np.float32)
    for feature, counts, weight in at.matches():
        found = table[feature]
        found[~counts] = 0
        gain[: len(found)] += np.float32(weight) * found
    return begins, np.add.reduceat(gain, begins) / norms


def sentence_margins(at: Layout, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """text, margin of every sentence with a word."""
    begins, sums = word_sums(at, table)
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0)
    own = at.stops[begins + 1]  # of the first letter
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return np.searchsorted(at.starts, begins[first], side="right") - 1, np.add.reduceat(sums, first) + bias


def margins(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """The highest margin of the sentences of each whole text; without words that of an empty sentence."""
    out = np.full(len(texts), bias)
    for a, b in text_groups(texts, 500_000):
        owner, found = sentence_margins(Layout.of([plain(t or "") for t in texts[a:b]]), table, bias)
        if len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[a + owner[first]] = np.maximum.reduceat(found, first)
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half the squared weights plus the sum of c times the squared hinge losses (Newton).

    ``x`` may be of single precision; sums are of double precision, over BLOCK rows at a time, so nothing as large as ``x`` is made.
    """
    n, d = x.shape
    w, ridge = np.zeros(d + 1), np.eye(d + 1)
    ridge[-1, -1] = 1e-6
    blocks = [slice(a, a + BLOCK) for a in range(0, n, BLOCK)]
    wide = lambda k: np.hstack([x[k].astype(np.float64), np.ones((len(x[k]), 1))])
    gaps = lambda v: np.concatenate([np.zeros(0), *[1 - y[k] * (wide(k) @ v) for k in blocks]])
    loss = lambda v, gap: 0.5 * v @ ridge @ v + (c * np.maximum(0, gap) ** 2).sum()
    gap = gaps(w)
    for _ in range(rounds):
        gradient, hessian = ridge @ w, ridge.copy()
        for k in blocks:
            on = gap[k] > 0
            z = wide(k)[on]
            gradient -= 2 * z.T @ (c[k] * y[k] * gap[k])[on]
            hessian += 2 * (z.T * c[k][on]) @ z
        step = np.linalg.solve(hessian, gradient)
        size, now = 1.0, loss(w, gap)
        while size > 1e-6 and loss(w - size * step, gaps(w - size * step)) > now - 1e-4 * size * gradient @ step:
            size /= 2
        w = w - size * step
        gap = gaps(w)
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def sentence_words(docs: DataFrame) -> DataFrame:
    """sentence (a hash), label, word: the different words of every sentence of labelled documents (label, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            out = []
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                for s in sentences(text):
                    words = WORD.findall(s)
                    key = xxh64_intdigest(" ".join(words)) >> 1
                    out += [(key, label, w) for w in dict.fromkeys(words)]
            for i in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[i : i + 100_000], strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["sentence", "label", "word"])

    return docs.mapInArrow(split, "sentence bigint, label int, word string")


def ratio(n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of a word's sentences with each label (columns t and c), negative for words of clean sentences."""
    share, total = (n_toxic + 1) / (n_toxic + n_clean + 2), F.col("t") + F.col("c")
    part = lambda n, s: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / total / s)).otherwise(0.0)
    both = 2 * (part("t", share) + part("c", 1 - share))
    return F.when(F.col("t") > total * share, both).otherwise(-both)


def whitening(marks: Sequence[str]) -> np.ndarray:
    """The matrix that makes Nyström features of kernels to the landmarks."""
    k = kernel(marks, marks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-6 * values.max(initial=0.0)
    return vectors[:, keep] / np.sqrt(values[keep])


def folded(x: np.ndarray, labels: np.ndarray, marks: Sequence[str], root: np.ndarray) -> Machine:
    """The machine of Nyström features ``x`` (labels 1 and -1, both classes weighing the same), as one weight for each subsequence of the landmarks."""
    weight = np.where(labels > 0, 2000 / max((labels > 0).sum(), 1), 2000 / max((labels < 0).sum(), 1))
    v, bias = squared_hinge(x, labels, weight)
    alpha = root @ v
    row, found, value = features(marks)
    known, inverse = np.unique(found, return_inverse=True)
    return Machine(known, np.bincount(inverse, value * alpha[row], minlength=len(known)), bias)


def fit(parts: Sequence[str], labels: np.ndarray, marks: Sequence[str]) -> Machine:
    """The folded machine of sentences in plain form over the landmarks."""
    root = whitening(marks)
    return folded(kernel(parts, marks) @ root, labels, marks, root)


def fit_table(parts: DataFrame, marks: Sequence[str]) -> Machine:
    """As ``fit``, of a table (label 1 or -1, sentence): kernels are taken on executors, and one row of Nyström features for each sentence reaches the driver."""
    root = whitening(marks)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known = Landmarks(marks)
        for b in batches:
            own = b.column("sentence").to_pylist()
            x = (known.kernel(own) @ root).astype(np.float32)
            keys = np.array([xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(keys), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "key", "x"])

    found = parts.select("label", "sentence").mapInArrow(measure, "label int, key bigint, x binary").toArrow()
    labels, keys, x = found.column("label").to_numpy().astype(np.float64), found.column("key").to_numpy(), np.zeros((len(found), root.shape[1]), np.float32)
    at = 0
    for chunk in found.column("x").chunks:
        x[at : at + len(chunk)] = unpacked(chunk, "<f4", root.shape[1])
        at += len(chunk)
    del found
    # whatever the order of tasks, the same sums
    order = np.lexsort((keys, -labels))
    return folded(x[order], labels[order], marks, root)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a document's labels are kept for tests: CRC-32 of its id as text modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def margin_table(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, margin of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine.table()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(margins(b.column("text").to_pylist(), own, machine.bias))], names=["doc_id", "margin"])

    small_batches(docs.sparkSession)
    return base_columns(docs, "doc_id", "text").mapInArrow(measure, T.StructType().add("doc_id", T.LongType()).add("margin", T.DoubleType()))


def chosen_sentences(docs: DataFrame, witnesses: Sequence[str]) -> DataFrame:
    """label, sentence, word (null), margin (null): of toxic documents (label, text) the first BEST sentences with a witness, of others WORST by hash."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known = set(witnesses)
        for b in batches:
            out = []
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = sentences(text)
                take = [s for s in own if known.intersection(WORD.findall(s))][:BEST] if label else sorted(own, key=xxh64_intdigest)[:WORST]
                out += [(label, s, None, None) for s in take]
            yield _chosen(out)

    return docs.mapInArrow(choose, CHOSEN)


CHOSEN = "label int, sentence string, word string, margin double"


def _chosen(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["label", "sentence", "word", "margin"])


def highest_sentences(docs: DataFrame, machine: Machine) -> DataFrame:
    """CHOSEN: of every document (label, text) its highest sentence, of toxic ones up to BEST if over a margin of zero, of others up to WORST; with the highest word and the margin."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = machine.table()
        for b in batches:
            labels, texts = b.column("label").to_pylist(), b.column("text").to_pylist()
            for first, last in text_groups(texts, 500_000):
                own = [sentences(t) for t in texts[first:last]]
                parts, doc = [s for ss in own for s in ss], np.repeat(np.arange(len(own)), [len(ss) for ss in own])
                owner, m = sentence_margins(Layout.of(parts), table, machine.bias)
                order = np.lexsort((-m, doc[owner]))
                bounds, out = np.searchsorted(doc[owner][order], np.arange(len(own) + 1)), []
                for k, label in enumerate(labels[first:last]):
                    for rank, i in enumerate(order[bounds[k] : bounds[k + 1]][: BEST if label else WORST].tolist()):
                        if not rank or not label or m[i] > 0:
                            out.append((label, parts[owner[i]], float(m[i])))
                words = [WORD.findall(s) for _, s, _ in out]
                at = Layout.of([w for ws in words for w in ws])
                sums = word_sums(at, table)[1].tolist()  # one word in each part
                ends = np.cumsum([len(ws) for ws in words]).tolist()
                yield _chosen([(label, s, max(zip(sums[e - len(ws) : e], ws, strict=True))[1], x) for (label, s, x), ws, e in zip(out, words, ends, strict=True)])

    return docs.mapInArrow(choose, CHOSEN)


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic of ``margin``, by Newton steps on the smoothed log loss of both classes alike."""
    n1, n0 = max(label.sum(), 1), max((1 - label).sum(), 1)
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0) * (n0 + n1)
    z, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        gradient = z.T @ (weight * (p - goal)) + 1e-3 * w
        w = w - np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + 1e-3 * np.eye(2), gradient)
    return float(w[0]), float(w[1])


def landmarks(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Witnesses of toxic sentences of ``sample`` (label, text), at most half of LANDMARKS, and as many words of clean ones."""
    # different sentences, so that copies of a document don't lend weight to its rare words
    pairs = written(sentence_words(sample).distinct(), "sentence_words")
    n = {r.label: r.n for r in pairs.select("sentence", "label").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
    in_label = lambda k: F.count(F.when(F.col("label") == k, 1))
    words = written(pairs.groupBy("word").agg(in_label(1).alias("t"), in_label(0).alias("c")).withColumn("ratio", ratio(n.get(1, 0), n.get(0, 0))).where(F.char_length("word") <= LONGEST), "words")
    first = lambda rows, count, *order: [r.word for r in rows.orderBy(*order, "word").limit(count).collect()]
    good = first(words.where(F.col("ratio") > LEAST_RATIO), LANDMARKS // 2, F.desc("ratio")) or first(words.where("t > 0"), LANDMARKS // 8, F.desc("ratio"))
    clean = words.where((F.col("c") > 0) & (F.col("ratio") < 3))
    return good, list(dict.fromkeys([*first(clean, LANDMARKS // 4, F.desc("c")), *first(clean, LANDMARKS // 4, F.xxhash64("word"))]))


def train(sample: DataFrame) -> Machine:
    """The machine for a bounded, written sample of documents (label, text). Sentences stay in tables; the driver has landmarks, which are words, and numbers."""
    good, clean = landmarks(sample)
    marks = list(dict.fromkeys([*good, *clean]))
    positive, negative, machine = None, [], None
    for k in range(ROUNDS + 1):
        # at most BEST or WORST sentences of each document of the sample
        rows = written(chosen_sentences(sample, good) if machine is None else highest_sentences(sample, machine), "sentences", "zstd")
        own = rows.where("label = 1").select("sentence").distinct()
        if positive is None or not own.isEmpty():
            positive = own
        fresh = rows.where("label = 0 AND (margin IS NULL OR margin > -1)")
        negative.append(fresh.select("sentence"))
        if k:
            hard = fresh.where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.max("margin").alias("m")).orderBy(F.desc("m"), "word").limit(HARDER)
            marks = list(dict.fromkeys([*marks, *[r.word for r in hard.collect()]]))
        clear = reduce(DataFrame.unionByName, negative).distinct()
        machine = fit_table(positive.withColumn("label", F.lit(1)).unionByName(clear.withColumn("label", F.lit(-1))), marks)
    return machine


def only_so_many(known: DataFrame) -> DataFrame:
    """``known`` (row, doc_id, label, text, apart) with one row for each text of an id, MOST_TOXIC and MOST_CLEAN rows at most: ids may repeat."""
    keyed = known.groupBy("label", "doc_id", F.xxhash64("text").alias("h")).agg(F.min("row").alias("row"))
    least = lambda label, most: keyed.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most).select("row")
    return known.join(F.broadcast(least(1, MOST_TOXIC).unionByName(least(0, MOST_CLEAN))), "row", "left_semi")


def learn(docs: DataFrame, labels: DataFrame) -> Machine | float:
    """The machine and its logistic from labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    first = lambda label, most: known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = first(1, MOST_TOXIC).unionByName(first(0, MOST_CLEAN))
    with scratch(docs.sparkSession):
        apart = F.pmod(F.xxhash64(F.lit("logistic"), "doc_id"), F.lit(FOLDS)) == 0
        known = base_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", apart.alias("apart"), F.monotonically_increasing_id().alias("row"))
        sample = only_so_many(written(known, "toxicity_sample"))
        found = {(r.label, r.apart): r.n for r in sample.groupBy("label", "apart").agg(F.count("*").alias("n")).collect()}
        n1, n0 = (found.get((k, True), 0) + found.get((k, False), 0) for k in (1, 0))
        if not n1 or not n0:
            return 1.0 if n1 else 0.0
        # both parts need both classes
        split = all(found.get((k, side), 0) for k in (0, 1) for side in (True, False))
        machine = train((sample.where("NOT apart") if split else sample).select("label", "text"))
        rest = sample.where("apart") if split else sample
        margin = margin_table(rest.withColumnRenamed("doc_id", "id").withColumnRenamed("row", "doc_id"), machine).join(F.broadcast(rest.select(F.col("row").alias("doc_id"), "label")), "doc_id").select("margin", "label").toPandas()
    machine.slope, machine.shift = logistic(margin["margin"].to_numpy(), margin["label"].to_numpy())
    return machine


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    machine = learn(docs, labels)
    if isinstance(machine, Machine):
        rows = margin_table(docs, machine).select("doc_id", (1 / (1 + F.exp(-(F.col("margin") * machine.slope + machine.shift)))).alias("score"))
    else:
        rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.lit(float(machine)).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
