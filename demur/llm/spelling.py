"""Spelling variants: words that differ by one edit, grouped under their most frequent form.

Words with equal letter counts in a few letter groups are a block; one edit changes a block's counts by one
in at most two groups, so a word's neighbours stand in blocks of the same or an adjacent length nearby.
A task takes part of one block and part of its neighbouring blocks as two matrices of letter counts. Their
Gram product gives all squared distances at once; one edit changes the squared distance by at most two.
The few pairs within that are compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.registry import query, stored, table
from demur.llm.textbytes import Slice, column_slices, lowered, running_hash, runs, span_hash

# words that a task counts before it hands them on
HELD_WORDS = 100_000
# runs of more bytes are hashed one by one
SHORT_RUN = 64


def _crc_table() -> np.ndarray:
    """Change of a CRC-32 by each byte (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (t >> np.uint32(1))
    return t


CRC = _crc_table()


def crc_of_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, continued from the CRC-32 of what stands before it."""
    out = before.astype(np.uint32)
    size = end - start
    for i in np.flatnonzero(size > SHORT_RUN):
        out[i] = zlib.crc32(data[start[i] : end[i]], int(out[i]))
    short = np.flatnonzero(size <= SHORT_RUN)
    short = short[np.argsort(-size[short], kind="stable")]
    at, state = start[short], ~out[short]
    left = np.searchsorted(-size[short], -np.arange(SHORT_RUN), "left")
    for j, m in enumerate(left.tolist()):
        if not m:
            break
        state[:m] = CRC[(state[:m] ^ data[at[:m] + j]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out[short] = ~state
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of A-Z, a-z and U+00C0 to U+00FF (lead byte C3 and the byte behind it)."""
    low = data | np.uint8(32)
    inside = (low >= 97) & (low <= 122) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def _without(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def count_words(
    docs: DataFrame, least_letters: int, slip_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n``: runs of letters of all texts, A-Z in lower case, with at least ``least_letters`` letters.

    With ``slip_one_in`` m, a run whose CRC-32 of ``id:run`` is a multiple of m loses the letter at that
    CRC modulo its length, before its letters are counted: typing errors that are the same at every run.
    A null text has no word; a null id is written as nothing before the colon; repeated rows count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held.keys()), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["word", "n"],
            )
            held.clear()
            return batch

        def count(s: Slice, before: np.ndarray) -> None:
            s = lowered(s)
            start, end, row = runs(s, letters(s.data))
            wide = np.concatenate([[0], np.cumsum(s.data == 0xC3)])
            size = end - start - (wide[end] - wide[start])
            enough = np.flatnonzero(size >= least_letters)
            start, end, row, size = start[enough], end[enough], row[enough], size[enough]
            raw = s.data.tobytes()
            if slip_one_in:
                crc = crc_of_runs(s.data, start, end, before[row])
                slip = crc % np.uint32(slip_one_in) == 0
                for i in np.flatnonzero(slip & (size > least_letters)).tolist():
                    word = raw[start[i] : end[i]].decode()
                    held[_without(word, int(crc[i]) % int(size[i])).encode()] += 1
                start, end = start[~slip], end[~slip]
            code, seen = pd.factorize(span_hash(running_hash(s.data), start, end))
            first = np.zeros(len(seen), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            many = np.bincount(code, minlength=len(seen))
            for x, y, n in zip(start[first].tolist(), end[first].tolist(), many.tolist()):
                held[raw[x:y]] += n

        for batch in batches:
            before = np.zeros(batch.num_rows, np.uint32)
            if slip_one_in:
                before[:] = [zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()]
            for s in column_slices(batch, "t"):
                count(s, before[s.first : s.first + len(s.ends) - 1])
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("t")
    )
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# words of a block that one task compares at a time with words of neighbouring blocks
CHUNK, PIECE = 1024, 4096
BUCKETS = 256
NEAR = "word string, n_near long, form_n long, form string"


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word starts."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=at[1:])
    return flat, at


def letter_groups(words: DataFrame, n_groups: int) -> np.ndarray:
    """Group of every code point modulo ``BUCKETS``: groups of about equal use, the commonest letters first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(_codes(batch.column(0).to_pylist())[0] % BUCKETS, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(n)], names=["letter", "n"])

    used = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).toArrow()
    use = np.zeros(BUCKETS, np.int64)
    use[used.column("letter").to_numpy()] = used.column("n").to_numpy()
    group, load = np.zeros(BUCKETS, np.int64), np.zeros(n_groups, np.int64)
    for letter in np.argsort(-use, kind="stable"):
        group[letter] = np.argmin(load)
        load[group[letter]] += use[letter]
    return group


def blocks(words: DataFrame, group: np.ndarray, n_groups: int) -> DataFrame:
    """``word, n, block, owners``: a block's number and those of the blocks that compare it with their words.

    A block is a vector of letter counts by group. Its owners lack one letter of it or have one of an earlier
    group in place of one of a later group; so of two neighbouring blocks exactly one owns the other.
    """
    weight = np.random.default_rng(7).integers(1, 1 << 62, n_groups, dtype=np.int64) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _codes(batch.column(0).to_pylist())
            n = batch.num_rows
            row = np.repeat(np.arange(n), np.diff(at))
            counts = np.bincount(row * n_groups + group[flat % BUCKETS], minlength=n * n_groups).reshape(n, n_groups)
            block = counts @ weight  # modulo 2**64; the weights are odd and random
            less = [(g, block - weight[g]) for g in range(n_groups)]
            less += [(g, block - weight[g] + weight[h]) for g in range(n_groups) for h in range(g)]
            has = np.stack([counts[:, g] > 0 for g, _ in less], axis=1)
            owners = np.stack([b for _, b in less], axis=1)
            ends = np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(block), pa.ListArray.from_arrays(pa.array(ends), pa.array(owners[has]))],
                names=["word", "n", "block", "owners"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, block long, owners array<long>")


def _matrix(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Code points of words of ``size`` letters, one row each."""
    return flat[at[:, None] + np.arange(size)]


def near_pairs(own: list[str], other: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``own``, of ``other``) that differ by one edit; own words have one length, others that or one more.

    One product of the letter counts, extended by their squared norms, gives every squared distance.
    """
    size = len(own[0])
    flat, at = _codes(own + other)
    n, dims = len(own) + len(other), int(letter.max()) + 1
    row = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(row * dims + letter[flat % BUCKETS], minlength=n * dims).reshape(n, dims)
    counts = counts.astype(np.float32 if size < 2000 else np.float64)  # whole numbers below 2**24 or 2**53
    norm, one = np.square(counts).sum(axis=1, keepdims=True), np.ones((n, 1), counts.dtype)
    left = np.hstack([counts, norm, one])[: len(own)]
    right = np.hstack([-2 * counts, one, norm])[len(own) :]
    i, j = np.nonzero(left @ right.T <= 2)
    longer = np.diff(at)[len(own) + j] > size
    if not size:  # the empty word is near every word of one letter
        return i[longer], j[longer]
    codes = _matrix(flat, at[:-1][: len(own)], size)
    out_i, out_j = [], []
    step = max(1, (1 << 22) // max(1, size))
    for x in range(0, len(i), step):
        a, b = codes[i[x : x + step]], len(own) + j[x : x + step]
        long = longer[x : x + step]
        # letters that agree from the left, and from the right
        start = at[b]
        head = a == _matrix(flat, start, size)
        tail = np.ones_like(head)
        tail[long] = a[long] == _matrix(flat, start[long] + 1, size)
        hits = head.sum(axis=1) == size - 1
        # one more letter: agreeing letters from the left, then from the right without that letter, cover the word
        first_off = np.where(head.all(axis=1), size, np.argmin(head, axis=1))
        last_off = np.where(tail.all(axis=1), 0, size - np.argmin(tail[:, ::-1], axis=1))
        ok = np.where(long, first_off >= last_off, hits)
        out_i.append(i[x : x + step][ok])
        out_j.append(j[x : x + step][ok])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])


def compared(parts: DataFrame, letter: np.ndarray) -> DataFrame:
    """Near words by word: their number and the best of them, for each part of the comparison."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, own, own_n, other, other_n, first = None, [], [], [], [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            words, n = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(words)]):
                block, chunk, side = key[x].tolist()
                if (block, chunk) != current:
                    if own and (first or other):
                        yield own, own_n, other, other_n, first
                    current, own, own_n, other, other_n, first = (block, chunk), [], [], [], [], True
                if side == 0:
                    own, own_n = own + words[x:y], own_n + n[x:y]
                elif own:
                    other, other_n = other + words[x:y], other_n + n[x:y]
                    if len(other) >= PIECE:
                        yield own, own_n, other, other_n, first
                        other, other_n, first = [], [], False
        if own and (first or other):
            yield own, own_n, other, other_n, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def add(word: str, near: str, n: int) -> None:
            e = found.get(word)
            if e is None:
                found[word] = [1, n, near]
                return
            e[0] += 1
            if n > e[1] or (n == e[1] and near < e[2]):
                e[1:] = n, near

        def out() -> pa.RecordBatch:
            columns = [list(found), *map(list, zip(*found.values()))]
            found.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "form_n", "form"])

        for own, own_n, other, other_n, first in pieces(batches):
            if first:
                i, j = near_pairs(own, own, letter)
                for a, b in zip(i.tolist(), j.tolist()):
                    add(own[a], own[b], own_n[b])
            if other:
                i, j = near_pairs(own, other, letter)
                for a, b in zip(i.tolist(), j.tolist()):
                    add(own[a], other[b], other_n[b])
                    add(other[b], own[a], own_n[a])
            if len(found) > HELD_WORDS:
                yield out()
        if found:
            yield out()

    return parts.mapInArrow(run, NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form`` of every word that has a near one; ``form`` is the near word of largest n.

    ``words``: distinct ``word, n``. Ties go to the word that is smaller in code-point order.
    """
    total = words.count()
    if not total:
        return words.sparkSession.createDataFrame([], NEAR)
    # more groups make smaller blocks and more neighbours of each; both stay small if groups grow with the logarithm
    n_groups = max(2, round(np.log2(total) / 3))
    group = letter_groups(words, n_groups)
    letter = np.arange(BUCKETS)
    placed = stored(blocks(words, group, n_groups), "blocks")
    # a block of very many words is dealt to several parts; its words meet in pairs of parts
    many = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n_words")).where(F.col("n_words") > CHUNK)
    many = many.select(F.col("block").alias("owner"), F.ceil(F.col("n_words") / CHUNK).cast("int").alias("chunks"))
    chunks = F.coalesce(F.col("chunks"), F.lit(1))
    chunk = F.pmod(F.xxhash64("word"), chunks).cast("int")
    own = placed.join(many, placed["block"] == many["owner"], "left").select("block", chunk.alias("chunk"), chunks.alias("chunks"), "word", "n")
    same = own.where("chunk > 0").select("block", F.explode(F.expr("sequence(0, chunk - 1)")).alias("chunk"), F.lit(1).alias("side"), "word", "n")
    sent = placed.select(F.explode("owners").alias("to"), "word", "n")
    sent = sent.join(many, sent["to"] == many["owner"], "left").select(
        F.col("to").alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("side"), "word", "n"
    )
    parts = own.select("block", "chunk", F.lit(0).alias("side"), "word", "n").unionByName(same).unionByName(sent)
    parts = parts.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side")
    near = compared(parts, letter)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form")
    )


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (distinct ``word, n``).

    Near words differ by one inserted, deleted or replaced letter. A word's form is its most frequent near
    word (ties: smaller in code-point order) if that is at least ``ratio`` (2 or more) times as frequent, else
    null; the root is where forms lead to. Frequencies at least double along the way, so paths are short and
    have no loops. An empty table gives no row; other columns are not carried.
    """
    words = words.select("word", "n")
    near = near_words(words)
    is_form = F.col("form_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word",
        F.when(is_form, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    out = stored(out, "forms")
    # each round doubles the length of the path that a link stands for
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        links = stored(links.join(step, links["root"] == step["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            break
        links = links.select("word", "root")
    return out.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    counted = count_words(table(spark, sf_dir, "documents"), least_letters=5, slip_one_in=97).where("n >= 3")
    return variant_groups(stored(counted, "words"))
