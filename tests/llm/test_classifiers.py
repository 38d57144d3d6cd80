import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import quality, toxicity

from .conftest import ROWS


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


@pytest.fixture(scope="module")
def medium(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_on_held_out_rows(medium):
    docs, labels = medium
    rows = quality.quality_scores(docs, labels)
    assert rows.count() == docs.count()
    found = rows.join(labels, "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    out = found[found.held_out]
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.97
    assert (out.predicted == out.quality).mean() > 0.95


def test_discriminant_against_dense_formulas():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = [rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + k for k, n in enumerate((300, 500))]
    sums = np.stack([np.r_[len(a), a.sum(0), (a.T @ a).ravel()] for a in x])
    model = quality.fit(sums)
    pooled = sum(np.cov(a.T, bias=True) * len(a) for a in x) / 800
    logs = []
    point = rng.normal(size=(7, d))
    for a in x:
        c = 0.9 * np.cov(a.T, bias=True) + 0.1 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + quality.LEAST_VARIANCE * np.eye(d)
        m = point - a.mean(0)
        logs.append(np.log(len(a) / 800) - 0.5 * ((m @ np.linalg.inv(c)) * m).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.score(point), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def test_moments_count_every_row(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), rng.normal(size=3).tolist()) for k in rng.integers(0, 2, 200)]
    sums = quality.moments(spark.createDataFrame(rows, "label int, x array<double>").repartition(5), 3)
    for k in (0, 1):
        x = np.array([v for c, v in rows if c == k])
        assert np.allclose(sums[k], np.r_[len(x), x.sum(0), (x.T @ x).ravel()])


def test_odd_documents(odd, no_rows, medium):
    labels = medium[1]
    for scores in (quality.quality_scores(odd, labels), toxicity.toxicity_scores(odd, labels)):
        rows = scores.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.quality_scores(no_rows, labels).collect() == []
    assert toxicity.toxicity_scores(no_rows, labels).collect() == []
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(odd, none).collect()} == {0.0}


def test_quality_filter(medium):
    docs, labels = medium
    kept = quality.keep_good(docs.withColumn("row", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "row"]
    share = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    total = {r.quality: r["count"] for r in labels.join(docs, "doc_id").groupBy("quality").count().collect()}
    shares = {r.quality: r["count"] / total[r.quality] for r in share}
    assert shares[1] > 0.95 and shares.get(0, 0) < 0.1


def slow_kernel(a, b):
    """Common subsequences of four, START and END among them, by enumeration."""
    def parts(w):
        w = [toxicity.START, *toxicity.classes(w).tolist(), toxicity.END] if w else []
        out = {}
        for at in combinations(range(len(w)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                key = tuple(w[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[3] - at[0] + 1)
        return out

    x, y = parts(a), parts(b)
    own = lambda w: float(toxicity.self_kernel(len(w)))
    return sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(own(a) * own(b))


def test_kernel_against_enumeration():
    words = ["idiot", "idxiot", "stupid", "a", "ab", "trash", "the", "idiotic", "crash"]
    fast = toxicity.kernel(words, words)
    assert np.allclose(fast, [[slow_kernel(a, b) for b in words] for a in words])
    assert fast[0, 1] > fast[0, 2] and np.allclose(fast, fast.T)


def slow_features(sentence):
    """Of a plain sentence of words between single blanks or marks: subsequences inside words and over one blank, each in the share of the word that it begins in."""
    out, letters = {}, toxicity.classes(sentence).tolist()
    spans = [m.span() for m in toxicity.WORD.finditer(sentence)]
    for k, (a, b) in enumerate(spans):
        own = [toxicity.START, *letters[a:b], toxicity.END]
        norm = np.sqrt(float(toxicity.self_kernel(b - a)))
        near = k + 1 < len(spans) and sentence[b : spans[k + 1][0]] == " "
        wide = [*letters[a:b], None, None, *letters[slice(*spans[k + 1])]] if near else []
        for seq, over in ((own, False), (wide, True)):
            for at in combinations(range(len(seq)), 4):
                key = tuple(seq[i] for i in at)
                if at[3] - at[0] < toxicity.SPAN and None not in key and (not over or at[0] < b - a < at[3]):
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[3] - at[0] + 1) / norm
    return out


SENTENCES = ["you are an idiot now", "wor thless", "worthless", "the river, table", "a b", "ab cd ef", "trash the crash", "x", "wor, thless", "idiot"]


def test_sentence_kernel_against_enumeration():
    own = [slow_features(s) for s in SENTENCES]
    slow = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in own] for a in own]
    assert np.allclose(toxicity.kernel(SENTENCES, SENTENCES), slow)
    assert slow[1][2] > slow[8][2] > 0


def test_fit_against_the_dual_in_full():
    """With every sentence a landmark, the machine is the kernel machine: its margins minimise the objective over all expansions."""
    labels = np.array([1, 1, 1, -1, -1, -1, 1, -1, 1, 1])
    machine = toxicity.fit(SENTENCES, labels, SENTENCES)
    k = toxicity.kernel(SENTENCES, SENTENCES)
    found = (toxicity.kernel(SENTENCES, SENTENCES) @ np.zeros(len(k))) + machine.bias
    table = machine.table()
    for i, s in enumerate(SENTENCES):
        found[i] = sum(v * table[((a * 41 + b) * 41 + c) * 41 + d] for (a, b, c, d), v in slow_features(s).items()) + machine.bias
    weight = np.where(labels > 0, 2000 / (labels > 0).sum(), 2000 / (labels < 0).sum())
    # at the optimum alpha is twice weight times label times the hinge, by the derivative of the objective
    alpha = 2 * weight * labels * np.maximum(0, 1 - labels * found)
    assert np.allclose(k @ alpha + machine.bias, found, atol=1e-2) and abs(alpha.sum()) < 1e-2


TOXIC = ["you idiot go", "such an idiot", "moron that you are", "what a moron", "idiot and moron", "a stupid idiot"]
CLEAN = ["the river is wide", "a table in the morning", "more on the window", "studio near the river", "in the window", "stupendous table"]


@pytest.fixture(scope="module")
def machine():
    return toxicity.fit([*TOXIC, *CLEAN], np.r_[np.ones(6), -np.ones(6)], ["idiot", "moron", "stupid", "river", "table", "the", "window", "morning", "studio"])


def test_folded_margins_are_those_of_the_features(machine):
    table = machine.table()
    texts = ["idiot", "the window. you idiot! river", "wor thless|table\nmoron", "stupidly idxiot", "a-b c"]
    for t, m in zip(texts, toxicity.margins(texts, table, machine.bias), strict=True):
        best = max(sum(v * table[((a * 41 + b) * 41 + c) * 41 + d] for (a, b, c, d), v in slow_features(s).items()) for s in toxicity.sentences(t))
        assert np.isclose(m, best + machine.bias, atol=1e-3)


def test_gaps_and_inserted_characters(machine):
    found = toxicity.margins(["say i d i o t now", "say i.d.i.o.t now", "id*iot", "mo_r*on", "idxiot here", "id iot", "river table", None, "", "..."], machine.table(), machine.bias)
    assert (found[:4] > 0.5).all() and found[4] > found[6] and found[5] > found[6] and (found[7:] == machine.bias).all()


def test_whole_texts_are_read(machine):
    far = "the river. " * 100_000 + "idiot"
    assert toxicity.margins([far, "x"], machine.table(), machine.bias)[0] > 0.5


def test_chosen_and_highest_sentences(spark, machine):
    docs = spark.createDataFrame([(1, "The river. You idiot! What a moron. Idiot and moron. Such an idiot."), (0, "A window. More on the window. In the morning the river"), (1, None), (0, "..")], "label int, text string")
    chosen = {(r.label, r.sentence.strip()) for r in toxicity.chosen_sentences(docs, ["idiot", "moron"]).collect()}
    assert {s for k, s in chosen if k} == {"you idiot", "what a moron", "idiot and moron"} and len([s for k, s in chosen if not k]) == toxicity.WORST
    table = machine.table()
    found = toxicity.highest_sentences(docs, machine).collect()
    for label in (0, 1):
        own = toxicity.sentences(docs.where(f"label = {label} AND length(text) > 2").first().text)
        score = {s.strip(): toxicity.margins([s], table, machine.bias)[0] for s in own}
        best = sorted(score, key=score.get, reverse=True)[: toxicity.BEST if label else toxicity.WORST]
        rows = {r.sentence.strip(): r for r in found if r.label == label}
        assert set(rows) == {s for s in best if not label or score[s] > 0 or s == best[0]}
        for s, r in rows.items():
            assert np.isclose(r.margin, score[s], atol=1e-4) and r.word == max(toxicity.WORD.findall(s), key=lambda w: toxicity.margins([w], table, 0.0)[0])


def test_words_of_sentences_are_counted(spark):
    docs = spark.createDataFrame([(1, "Aa bb. Aa bb! cc"), (1, "aa  bb|cc dd"), (0, "Bb cc"), (0, None)], "label int, text string")
    rows = toxicity.sentence_words(docs).distinct().groupBy("label", "word").count().collect()
    assert {(r.label, r.word): r["count"] for r in rows} == {(1, "aa"): 1, (1, "bb"): 1, (1, "cc"): 2, (1, "dd"): 1, (0, "bb"): 1, (0, "cc"): 1}
    counted = spark.createDataFrame([("w", 8, 2), ("v", 1, 9), ("u", 0, 5)], "word string, t long, c long").withColumn("r", toxicity.ratio(20, 60)).collect()
    for r in counted:
        share, n = 21 / 82, r.t + r.c
        both = 2 * sum(x * np.log(x / n / s) for x, s in ((r.t, share), (r.c, 1 - share)) if x)
        assert np.isclose(r.r, both if r.t > n * share else -both)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels)
    found = rows.join(labels, "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    out = found[found.held_out]
    assert auc(out.score.to_numpy(), out.toxic.to_numpy()) > 0.93
    assert out[out.toxic == 1].predicted.mean() > 0.88 and out[out.toxic == 0].predicted.mean() < 0.04


def test_fit_on_executors_is_the_fit(spark):
    """Features that executors take give the machine of a fit in one place, up to single precision, whatever the order of rows."""
    marks = ["idiot", "moron", "river", "the"]
    labels = np.r_[np.ones(6), -np.ones(6)]
    want = toxicity.fit([*TOXIC, *CLEAN], labels, marks)
    rows = spark.createDataFrame([(int(k), s) for k, s in zip(labels, [*TOXIC, *CLEAN], strict=True)], "label int, sentence string")
    found = toxicity.fit_table(rows.repartition(3), marks)
    again = toxicity.fit_table(rows.orderBy(F.desc("sentence")), marks)
    assert (found.features == want.features).all() and np.allclose(found.weights, want.weights, atol=1e-4) and np.isclose(found.bias, want.bias, atol=1e-4)
    assert (found.weights == again.weights).all() and found.bias == again.bias


def test_a_labelled_text_of_10_mb_without_stops(spark):
    """One sentence, labelled and scored, and a word of a million letters; an id that repeats counts as rows."""
    long = "some idiot words without any end to them " * 250_000
    rows = [(k, f"you are such an idiot number {k}, really" if k % 2 else f"the river runs by table {k}, quietly") for k in range(1, 60)]
    rows += [(100, long), (101, "z" * 1_000_000), (102, "you stupid idiot"), *[(102, f"you idiot {k}") for k in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 or k in (100, 102))) for k in [*range(1, 60), 100, 101, 102]], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).where("doc_id <> 102").collect()}
    assert len(scores) == 61 and scores[100] > 0.5 and scores[2] < 0.5 < scores[1]


def test_rows_of_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 5)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 3)
    rows = [(k, 7 if k < 50 else k, 1 if k < 50 else 0, f"text {k % 20}", False) for k in range(100)]
    kept = toxicity.only_so_many(spark.createDataFrame(rows, "row long, doc_id long, label int, text string, apart boolean")).collect()
    assert [sum(r.label == k for r in kept) for k in (1, 0)] == [5, 3] and len({(r.doc_id, r.text) for r in kept}) == 8
