"""Counts against a plain computation, the estimate against known accuracies, and the edge cases."""

import random
import re
from collections import Counter

import pytest

from demur.llm import quality as q

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r",
    "a",
    "a a a a",
    "a b c a b c",
    "a b a b a b a",
    "x\ny\nx\n\n \ny \ny",
    "🙂🙂 é é #*$%&|<>",
    "one two three " * 4000,
    " ".join(str(i) for i in range(30000)),
]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, w int, t string")
    for r in q.text_counts(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain(TEXTS[r["doc_id"]]), r["doc_id"]


def test_counts_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in q.text_counts(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain(texts[r["doc_id"]]), r["doc_id"]


def test_variety_has_no_step_at_long_texts(spark):
    variety = next(r for r in q.RULES if r.name == "variety")
    rows = [(n, d) for n in (1000, 2000, 2001, 2100, 200000) for d in (5, 150, 300, 499, 501, 2100, 9000)]
    cells = spark.createDataFrame(rows, "n_words long, n_distinct long").selectExpr("*", f"{variety.good} as good", f"{variety.bad} as bad")
    out = {(r["n_words"], r["n_distinct"]): (r["good"], r["bad"]) for r in cells.collect()}
    for d in (5, 150, 300, 499, 2100):
        assert out[2000, d] == out[2001, d] == out[2100, d], d
    assert out[2001, 5] == (False, True) and out[200000, 300] == (False, True)
    assert out[200000, 2100] == (False, False) and out[200000, 9000] == (True, False)


def test_estimate_finds_accuracies(spark):
    rng = random.Random(5)
    rules = tuple(q.Rule(f"r{i}", "true", "true") for i in range(4))
    right = (0.95, 0.9, 0.85, 0.82)
    rows = []
    for _ in range(20000):  # accuracies on good texts stay within their limits
        y = 1 if rng.random() < 0.6 else -1
        rows.append(tuple((y if rng.random() < a else -y) if rng.random() < 0.9 else 0 for a in right))
    w = q.estimate(spark.createDataFrame(rows, ", ".join(f"v_r{i} int" for i in range(4))), rules, rounds=60)
    assert w.prior == pytest.approx(0.6, abs=0.05)
    assert w.good == pytest.approx(right, abs=0.05) and w.bad == pytest.approx(right, abs=0.05)


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = q.quality(spark.read.parquet(f"{sf}/documents.parquet"))
    got = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.95 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_base_failure_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 100), (2, None), (2, None), (3, "few words")], "doc_id long, text string")
    out = q.quality(docs)
    assert [(r["base_failed"], r["kept"]) for r in out.collect()] == [(True, False)] * 4
    assert q.quality(docs.where("doc_id > 9")).count() == 0
