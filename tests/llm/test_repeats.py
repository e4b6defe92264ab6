"""Removed bytes against a dictionary of all 100-byte strings, transforms against sorted suffixes."""

import hashlib
import random

import pytest

from demur.llm import bwt, repeats


def plain(rows):
    """``[(doc_id, text)]`` with distinct ids to ``{doc_id: (n_bytes, n_removed, n_spans, sha)}``."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n long, start string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == plain(rows)


def made():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(18, 60))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        text = " ".join(x for p in parts for x in (p, rng.choice(passages) if rng.random() < 0.6 else ""))
        if rng.random() < 0.3 and rows:
            base = rows[rng.randrange(len(rows))][1] or ""
            k = rng.randrange(max(1, len(base)))
            text = base[:k] + "#" + base[k + 1 :]
        rows.append((i * 3 - 7, text))
    rows += [(300, None), (301, ""), (302, "x" * 99), (303, "ab" * 400), (304, "abc" * 2000), (305, "x" * 5000), (306, "x" * 100)]
    rows += [(307, rows[5][1]), (308, rows[5][1]), (1, "日本" * 300)]
    return rows


def test_against_all_strings(spark):
    check(spark, made())


def test_common_cores_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CORE_STRIPS", 3)
    monkeypatch.setattr(repeats, "CHUNK", 333)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 700)
    check(spark, made())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + i % 23) for i in range(150)) + "".join(chr(65 + i * i % 26) for i in range(90))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other"), (2, text), (None, text), (None, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert [n for i, n in out if i == 2] == [240] and [n for i, n in out if i == 0] == [0, 0]
    assert len({n for i, n in out if i == 1}) <= 2 and len(out) == 6
    assert repeats.remove_repeats(docs.where("doc_id > 9")).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merge_finds_the_repeated_intervals(shards):
    rng = random.Random(shards)
    strings = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    blocks = [strings[i::shards] for i in range(shards)]
    order = [s for b in blocks for s in b]
    interval, string, offset = bwt.repeated(blocks, 6)
    got = {}
    for g, s, o in zip(interval.tolist(), string.tolist(), offset.tolist()):
        got.setdefault(g, set()).add((s, o))
    want = {}
    for s, x in enumerate(order):
        for o in range(len(x) - 5):
            want.setdefault(x[o : o + 6], set()).add((s, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_transform_equals_sorted_suffixes():
    strings = [b"banana", b"ananas", b"", b"nab\0a"]
    shard = bwt.build(strings)
    suffixes = sorted((s[o:], i, o) for i, s in enumerate(strings) for o in range(len(s) + 1))
    assert shard.before.tolist() == [0 if o == 0 else strings[i][o - 1] + 1 for _, i, o in suffixes]
    step = shard.step()
    where = {(i, o): r for r, (_, i, o) in enumerate(suffixes)}
    assert step.tolist() == [where.get((i, o - 1), -1) for _, i, o in suffixes]
