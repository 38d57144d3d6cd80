import re
from collections import Counter

from pyspark.sql import functions as F

from fieldloom.llm import rules

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(odd, few):
    for docs in (odd, few[0]):
        texts = docs.select("doc_id", "text").collect()
        found = rules.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(map(tuple, found)) == Counter((r.doc_id, *plain(r.text)) for r in texts)


def test_overlapping_windows(spark):
    text = "a b c d e a b c d e f g a a a a a a a\nx\nx\n\n \nx"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = rules.ledger(docs).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)


def test_policies_and_ablations(few):
    ledger = rules.ledger(few[0]).cache()
    rows = ledger.collect()
    base = rules.apply_policy(ledger, "base").collect()
    for r in base:
        fails = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == fails and r.kept == (not fails)
    names = list(rules.RULES)
    for a in rules.ablations(ledger, "v2").collect():
        bit = 1 << names.index(a.rule)
        assert a.n_failed == sum(1 for r in rows if r.fail_bits & bit)
        assert a.n_only == sum(1 for r in rows if r.fail_bits == bit)


def test_filter_keeps_rows_whole(odd, no_rows):
    kept = rules.keep_passing(odd, "base")
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 6, 7, 8, None}
    assert rules.keep_passing(no_rows).collect() == [] and rules.ledger(no_rows).collect() == []
    assert rules.ledger(odd).count() == len(ROWS)


def test_no_python_in_the_plan(odd):
    for df in (rules.ledger(odd), rules.with_ablation(rules.stored_ledger(odd))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    plan = rules.apply_policy(rules.ledger(odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert kept_once(plan)
    assert rules.keep_passing(odd).where(F.col("doc_id") == 1).count() == 1


def kept_once(plan):
    """Words are split in one place, not again for each measurement."""
    return len(re.findall(r"split\(trim", plan)) <= 1


def test_stored_ledger_and_its_ablation(few, odd, no_rows):
    for docs in (few[0], odd):
        rows = rules.with_ablation(rules.stored_ledger(docs), "v2").collect()
        kept = Counter(r.fail_bits for r in rows)
        for r in rows:
            alone = r.fail_bits.bit_count() == 1
            assert r.n_saved == (kept[r.fail_bits] if alone else None) and r.kept == (r.fail_bits == 0)
        assert sorted(map(tuple, rules.stored_ledger(docs).collect()), key=str) == sorted(map(tuple, rules.ledger(docs).collect()), key=str)
    assert rules.with_ablation(rules.stored_ledger(no_rows)).collect() == []
