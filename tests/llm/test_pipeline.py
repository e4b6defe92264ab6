"""The stages over documents: each one's decisions against a plain computation on its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from demur.llm import quality
from tests.llm.test_jaccard import plain as plain_classes
from tests.llm.test_pii import brute as plain_spans
from tests.llm.test_quality import plain as plain_counts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = docs.collect()
    stage = dict(cp.STAGES)

    good = stage["quality rules"](spark, docs, SF)
    good_rows = good.collect()
    assert good.columns == names and 0 < len(good_rows) < len(rows)
    kept = {r["doc_id"] for r in good_rows}
    for r in rows:
        n_words, _, _, _, n_repeat = plain_counts(r["text"])
        if n_words < 50 or 100 * n_repeat > 50 * n_words:
            assert r["doc_id"] not in kept
    assert {r["doc_id"]: r["text"] for r in good_rows} == {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in kept}

    good = spark.createDataFrame(good_rows, good.schema)
    one = stage["n-gram Jaccard join"](spark, good, SF)
    one_rows = one.collect()
    assert one.columns == names
    want = {c for _, c, _ in plain_classes([(r["doc_id"], r["text"]) for r in good_rows])}
    assert {r["doc_id"] for r in one_rows} == want and len(one_rows) == len(want)

    one = spark.createDataFrame(one_rows, one.schema)
    masked = stage["PII"](spark, one, SF)
    masked_rows = {r["doc_id"]: r for r in masked.collect()}
    assert masked.columns == names and len(masked_rows) == len(one_rows)
    for r in one_rows:
        new = masked_rows[r["doc_id"]]
        assert plain_spans(new["text"]) == [] and new["n_chars"] == len(new["text"])
        if not plain_spans(r["text"]) and "=" not in r["text"]:
            assert new["text"] == r["text"]

    masked = spark.createDataFrame(list(masked_rows.values()), masked.schema)
    mixed = stage["mixing sources to target weights"](spark, masked, SF)
    mixed_rows = {r["doc_id"]: r for r in mixed.collect()}
    assert mixed.columns == names and 0.6 * len(masked_rows) < len(mixed_rows) < len(masked_rows)
    tokens = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert tokens(mixed_rows.values()) <= 0.9 * tokens(masked_rows.values()) + 1

    mixed = spark.createDataFrame(list(mixed_rows.values()), mixed.schema)
    pieces = stage["packing"](spark, mixed, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in mixed_rows.items()}


def test_run_and_odd_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert cp.run(spark, sf).count() > 0
    text = " ".join(f"word{i}" for i in range(80))
    odd = spark.createDataFrame(
        [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text, "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    seen = []
    for docs in (odd, odd.where("n_chars > 9")):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            seen.append(docs.count())
    # quality keeps the three rows of the long text, of which one stays
    assert seen[:4] == [3, 1, 1, seen[3]] and seen[5:] == [0] * 5
    assert quality.MAX_RULES == 8


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (7, c), (None, c), (None, c), (8, b + " more"), (9, "d e"), (9, "d e"), (None, "f g"), (None, "f g"), (None, None), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(cp.STAGES)["n-gram Jaccard join"](spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(3, a), (5, b), (7, c), (9, "d e"), (None, "f g"), (None, None), (None, None), (4, "")], key=repr)
