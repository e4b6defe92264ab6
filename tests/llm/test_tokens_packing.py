"""Token counts, prefixes and pieces against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from demur.llm import bpe, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "b", "'", "s", "re", " ", "  ", "\n", "1", "٣", "é", "日", "!", "　", "ll", "<|endoftext|>", "\r", "hello"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def made(n, size):
    rng = random.Random(n)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_every_prefix():
    table = bpe.load(PATH)
    for text in made(200, 12):
        counts = table.prefix_counts(text.encode())
        for i in range(len(text) + 1):
            assert counts[len(text[:i].encode())] == len(ids(text[:i])), (text, i)


def test_counts_and_pieces(spark):
    texts = [None, "", "a" * 500, " " * 300 + "b", "word " * 5000, *made(60, 40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, t int")
    for r in tokens.token_counts(docs, PATH, limit=20).collect():
        text = texts[r["doc_id"]] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(ids(text)), len(text.encode()))
        assert len(ids(text.encode()[: r["fit_bytes"]].decode())) <= 20 and r["over_limit"] == (r["n_tokens"] > 20)
    filled = {}
    for r in packing.pack(docs, PATH).collect():
        own = np.array([*ids(texts[r["doc_id"]]), 1], "<u4")
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.where("doc_id < 0"), PATH).count() == 0


def test_assignment_is_that_of_the_cheapest_open_sequence():
    rng = np.random.default_rng(9)
    for capacity, size in ((50, 400), (2048, 300), (8, 200)):
        lengths = np.sort(rng.integers(1, capacity + 1, size) ** 2 // capacity + 1)[::-1].clip(1, capacity)
        sequence, offset = packing.assign(lengths, capacity, 1.0, 0.01)
        room, cost = [], []
        for n, got, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
            fits = [i for i in range(len(room)) if room[i] >= n]
            i = min(fits, key=lambda i: (cost[i], i), default=len(room))
            if i == len(room):
                room.append(capacity)
                cost.append(0.0)
            assert (got, at) == (i, capacity - room[i])
            room[i] -= n
            cost[i] += 1.0 * n + 0.01 * n * n


def test_little_padding_and_repeated_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pieces = packing.pack(docs.unionByName(docs.where("doc_id < 5")), PATH).toPandas()
    used = pieces["length"].sum()
    assert used >= 0.97 * 2048 * pieces["sequence_id"].nunique()
    one = pieces[pieces["doc_id"] == 3].groupby("start").size()
    assert (one == 2).all()
