"""Exact byte-level BPE over many texts at once: pieces, and token tables of every prefix of a piece.

A text falls into pieces (words with their blank, numbers, signs, white space) that tokens never cross.
For a piece, ``last[i]`` is the token that ends the encoding of its first i bytes; it is the one token t
for which (last[i - len(t)], t) can stand side by side, and so ``count[i] = count[i - len(t)] + 1``.
The table is built once for each distinct piece of a worker; texts are then sums over their pieces.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

from demur.llm.textbytes import Slice, mixed, running_hash, span_hash

U64 = np.uint64
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# endings that stay with their apostrophe (fixed values of the vocabulary's splitting pattern)
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
# pieces up to this length are worked on together; longer ones one by one
TOGETHER = 48
# fewer pieces than this are worked on one by one, too
FEW = 64
# distinct pieces that a worker remembers before it starts anew
REMEMBERED = 400_000
STEP = U64(0x100000001B3)
NEAR_SHIFT = U64(44)


class Lookup:
    """Vectorised map from 64-bit keys to small numbers: one wide table, a second for its collisions."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = U64(64 - max(8, int(len(keys) * 24).bit_length()))
        spot = (mixed(keys) >> self.shift).astype(np.int64)
        size = 1 << (64 - int(self.shift))
        self.keys = np.zeros(size, U64)
        self.values = np.full(size, -1, np.int32)
        _, own = np.unique(spot, return_index=True)
        self.keys[spot[own]], self.values[spot[own]] = keys[own], values[own]
        rest = np.setdiff1d(np.arange(len(keys)), own)
        order = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_values = keys[order], values[order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        spot = (mixed(keys) >> self.shift).astype(np.int64)
        found = self.values[spot]
        miss = (found >= 0) & (self.keys[spot] != keys)
        if miss.any():
            at = np.flatnonzero(miss)
            found[at] = -1
            if len(self.more_keys):
                k = np.minimum(np.searchsorted(self.more_keys, keys[at]), len(self.more_keys) - 1)
                found[at] = np.where(self.more_keys[k] == keys[at], self.more_values[k], -1)
        return found


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, text))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = char_classes()
    cls = table[:256][data]
    for lead, low, mask, size in ((0xC0, 0xE0, 0x1F, 2), (0xE0, 0xF0, 0x0F, 3), (0xF0, 0xF8, 0x07, 4)):
        at = np.flatnonzero((data >= lead) & (data < low))
        if len(at):
            code = data[at].astype(np.uint32) & mask
            for k in range(1, size):
                code = (code << 6) | (data[at + k] & 0x3F)
            kind = table[code]
            for k in range(size):
                cls[at + k] = kind
    return cls


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First byte of every piece; ``ends`` cuts the data into texts that are split independently."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(data)
    limits = np.unique(ends[(ends > 0) & (ends < n)])
    edge = np.zeros(n, bool)
    edge[0] = True
    edge[limits] = True
    run = edge.copy()
    run[1:] |= cls[1:] != cls[:-1]
    start = run.copy()
    first = np.flatnonzero(run)
    length = np.diff(np.append(first, n))
    kind = cls[first]
    # white space before another run gives its last character away: a blank to the run, others alone
    closes = np.append(edge[first[1:]], True)
    inner = (kind == SPACE) & ~closes
    last = first + length - 1
    back = last[inner].copy()
    while (low := (data[back] & 0xC0) == 0x80).any():
        back[low] -= 1
    start[back] = True
    blank = data[back] == 0x20
    start[last[inner][blank] + 1] = False
    # endings such as 's where the apostrophe begins a piece
    quote = first[(kind == OTHER) & (length == 1) & (data[first] == 0x27) & start[first] & (first + 1 < n)]
    quote = quote[~edge[quote + 1]]
    done = np.zeros(len(quote), bool)
    for ending in ENDINGS:
        fits = ~done & (quote + len(ending) < n)
        for k, byte in enumerate(ending, 1):
            at = np.minimum(quote + k, n - 1)
            fits &= (data[at] == byte) & ~edge[at]
        at = quote[fits]
        start[at + 1] = False
        after = at + len(ending) + 1
        after = after[after < n]
        start[after] |= cls[after] == LETTER
        done |= fits
    return np.flatnonzero(start)


class Bpe:
    """Tables of one vocabulary, and what this worker has learnt about pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        added = [a["content"] for a in spec.get("added_tokens", [])]
        self.specials = [(a["content"].encode(), a["id"]) for a in spec.get("added_tokens", [])]
        single = {b[0]: vocab[t] for t, b in as_bytes.items() if len(b) == 1 and t not in added}
        # own numbers: bytes first, then merges in their order, so that a smaller number merges earlier
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        number = {bytes([b]): b for b in range(256)}
        self.ids = np.zeros(256 + len(merges), np.uint32)
        self.ids[:256] = [single.get(b, 0) for b in range(256)]
        self.left = np.arange(256 + len(merges), dtype=np.int64)
        self.right = self.left.copy()
        pairs = np.zeros(len(merges), U64)
        self.pair: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            x, y = number[as_bytes[a]], number[as_bytes[b]]
            number[as_bytes[a] + as_bytes[b]] = t = 256 + i
            self.left[t], self.right[t], self.ids[t] = x, y, vocab[a + b]
            pairs[i] = (x << 20) | y
            self.pair[x, y] = t
        self.number = number
        self.longest = max(map(len, number))
        self.pairs = Lookup(pairs, np.arange(256, 256 + len(merges), dtype=np.int32))
        names = list(number)
        hashes = np.array([self._hash(b) for b in names], U64)
        self.tokens = Lookup(hashes, np.array([number[b] for b in names], np.int32))
        self.lengths = sorted({len(b) for b in names})
        self.forget()

    @staticmethod
    def _hash(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * int(STEP) + x + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.near_key = np.zeros(1 << 20, U64)
        self.near_slot = np.full(1 << 20, -1, np.int32)
        self.counts = np.zeros(1024, np.int32)
        self.at = np.zeros(1024 + 1, np.int64)
        self.flat = np.zeros(4096, np.uint32)

    # -- which tokens can stand side by side

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where the encoding of a's bytes and b's bytes is just (a, b).

        The newest merge inside the two is undone again and again; if the tokens that then meet at the
        border merge earlier than it, the border would not have survived.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(at):
            met = self.pairs.get((a << 20 | b).astype(U64))
            bad = (met >= 0) & (met < limit)
            ok[at[bad]] = False
            a_next, b_next = self.right[a], self.left[b]
            a_open, b_open = a_next != a, b_next != b
            on_a = a_open & ((a > b) | ~b_open)
            limit = np.where(on_a, a, b + 1)
            go = ~bad & (a_open | b_open)
            a, b = np.where(on_a, a_next, a), np.where(on_a, b, b_next)
            a, b, limit, at = a[go], b[go], limit[go], at[go]
        return ok

    @lru_cache(maxsize=200_000)  # noqa: B019  (one object by worker)
    def fit_one(self, a: int, b: int) -> bool:
        limit = 1 << 40
        while True:
            met = self.pair.get((a, b))
            if met is not None and met < limit:
                return False
            a_next, b_next = int(self.right[a]), int(self.left[b])
            if a_next != a and (a > b or b_next == b):
                a, limit = a_next, a
            elif b_next != b:
                b, limit = b_next, b + 1
            else:
                return True

    # -- tables of prefixes

    def prefix_tokens(self, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece ``(last, count)`` over its prefixes of 0, 1, ... bytes."""
        out: list = [None] * len(pieces)
        for part, last, count in self._tables(pieces):
            for row, i in enumerate(part):
                n = len(pieces[i]) + 1
                out[i] = (last[:n, row], count[:n, row])
        return out

    def _tables(self, pieces: list[bytes]):
        """The tables in groups ``(numbers of the pieces, last, count)``, prefix length by row."""
        sizes = np.array([len(p) for p in pieces])
        # array work pays from some pieces on
        alone = sizes > (TOGETHER if len(pieces) >= FEW else 0)
        short = np.flatnonzero(~alone)
        short = short[np.argsort(-sizes[short], kind="stable")]
        for k in range(0, len(short), 16_384):
            part = short[k : k + 16_384]
            yield part, *self._together([pieces[i] for i in part])
        for i in np.flatnonzero(alone):
            last, count = self._alone(pieces[i])
            yield np.array([i]), last[:, None], count[:, None]

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max(initial=0))
        m = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        h = np.zeros((width + 1, m), U64)
        last = np.full((width + 1, m), -1, np.int32)
        count = np.zeros((width + 1, m), np.int32)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(width, STEP)]))
        for i in range(1, width + 1):
            rows = int(np.searchsorted(-sizes, -i, "right"))
            h[i, :rows] = h[i - 1, :rows] * STEP + raw[:rows, i - 1] + U64(1)
            who, tok, size = [], [], []
            for length in self.lengths:
                if length > i:
                    break
                t = self.tokens.get(h[i, :rows] - h[i - length, :rows] * power[length])
                at = np.flatnonzero(t >= 0)
                who.append(at)
                tok.append(t[at])
                size.append(np.full(len(at), length))
            who, tok, size = np.concatenate(who), np.concatenate(tok), np.concatenate(size)
            before = last[i - size, who]
            ok = before < 0
            more = np.flatnonzero(~ok)
            ok[more] = self.fit(before[more], tok[more])
            who, tok, size = who[ok], tok[ok], size[ok]
            last[i, who] = tok
            count[i, who] = count[i - size, who] + 1
        return last, count

    def _alone(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(piece)
        last, count = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        ends = [-1] * (n + 1)
        counts = [0] * (n + 1)
        for i in range(1, n + 1):
            for length in self.lengths:
                if length > i:
                    break
                t = self.number.get(piece[i - length : i])
                if t is not None and (length == i or self.fit_one(ends[i - length], t)):
                    ends[i], counts[i] = t, counts[i - length] + 1
                    break
        last[:], count[:] = ends, counts
        return last, count

    # -- whole texts

    def split(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces, their number by text, and the ids of pieces that are special strings (else -1)."""
        ends, special = s.ends, []
        raw = s.data.tobytes() if self.specials else b""
        for content, token in self.specials:
            at = raw.find(content)
            while at >= 0:
                row = int(np.searchsorted(s.ends, at, "right")) - 1
                if at + len(content) <= s.ends[row + 1]:
                    special.append((at, at + len(content), token))
                    at = raw.find(content, at + len(content))
                else:
                    at = raw.find(content, at + 1)
        if special:
            ends = np.unique(np.concatenate([ends, [x for a, b, _ in special for x in (a, b)]]))
        start = piece_starts(s.data, ends)
        token = np.full(len(start), -1, np.int64)
        if special:
            keep = np.ones(len(start), bool)
            for a, b, t in special:
                x, y = np.searchsorted(start, [a, b])
                keep[x + 1 : y] = False
                token[x] = t
            start, token = start[keep], token[keep]
        return start, np.diff(np.searchsorted(start, s.ends)), token

    def slots(self, s: Slice, start: np.ndarray) -> np.ndarray:
        """Number of each piece in this worker's memory, which learns the new ones first."""
        end = np.append(start[1:], len(s.data))
        key = span_hash(running_hash(s.data), start, end)
        if len(self.known) > REMEMBERED:
            self.forget()
        spot = (key >> NEAR_SHIFT).astype(np.int64)
        slot = self.near_slot[spot].astype(np.int64)
        miss = np.flatnonzero((slot < 0) | (self.near_key[spot] != key))
        if not len(miss):
            return slot
        distinct, where, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
        known = self.known
        found = np.fromiter((known.get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            raw = s.data.tobytes()
            at = miss[where[new]]
            base = len(known)
            self._learn([raw[x:y] for x, y in zip(start[at].tolist(), end[at].tolist())])
            found[new] = np.arange(base, base + len(new))
            known.update(zip(distinct[new].tolist(), range(base, base + len(new))))
            spot = (distinct[new] >> NEAR_SHIFT).astype(np.int64)
            free = self.near_slot[spot] < 0
            self.near_key[spot[free]], self.near_slot[spot[free]] = distinct[new][free], found[new][free]
            # two new pieces may share a spot: the key that stayed owns the slot
            own = free & (self.near_key[spot] == distinct[new])
            self.near_slot[spot[own]] = found[new][own]
        slot[miss] = found[inverse]
        return slot

    def _learn(self, pieces: list[bytes]) -> None:
        """Stores the tokens of new pieces, read backwards from the tables."""
        base = len(self.known)
        need = base + len(pieces)
        if need > len(self.counts):
            self.counts = np.resize(self.counts, 2 * need)
            self.at = np.resize(self.at, 2 * need + 1)
        found = []
        for part, last, count in self._tables(pieces):
            n = np.array([len(pieces[i]) for i in part])
            col = np.arange(len(part))
            total = count[n, col]
            self.counts[base + part] = total
            tokens = np.zeros(int(total.sum()), np.uint32)
            stop = np.cumsum(total)
            left = total.copy()
            while len(col):
                t = last[n, col]
                left[col] -= 1
                tokens[stop[col] - total[col] + left[col]] = self.ids[t]
                n = n - self.size[t]
                go = n > 0
                n, col = n[go], col[go]
            found.append((part, stop, total, tokens))
        used = int(self.at[base]) if base else 0
        self.at[base] = used
        np.cumsum(self.counts[base:need], out=self.at[base + 1 : need + 1])
        self.at[base + 1 : need + 1] += used
        if int(self.at[need]) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * int(self.at[need]))
        for part, stop, total, tokens in found:
            inside = np.arange(len(tokens)) - np.repeat(stop - total, total)
            self.flat[np.repeat(self.at[base + part], total) + inside] = tokens

    def counted(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece starts, slots, special ids, tokens by piece, and the pieces' limits by text."""
        start, by_text, special = self.split(s)
        slot = self.slots(s, start)
        counts = np.where(special >= 0, 1, self.counts[slot]).astype(np.int64)
        return start, slot, special, counts, np.concatenate([[0], np.cumsum(by_text)])

    def totals(self, s: Slice) -> np.ndarray:
        """Tokens of each text of a slice."""
        _, _, _, counts, limits = self.counted(s)
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(total[limits])

    def encoded(self, s: Slice, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each text followed by the id ``closing``, and the texts' limits."""
        _, slot, special, counts, limits = self.counted(s)
        total = np.concatenate([[0], np.cumsum(counts)])
        n_text = len(limits) - 1
        rows = np.repeat(np.arange(n_text), np.diff(limits))
        out = np.full(int(total[-1]) + n_text, closing, np.uint32)
        source = np.repeat(self.at[slot] - total[:-1], counts) + np.arange(total[-1])
        ids = self.flat[np.minimum(source, len(self.flat) - 1)]
        mark = np.flatnonzero(special >= 0)
        ids[total[mark]] = special[mark]
        out[np.arange(len(ids)) + np.repeat(rows, counts)] = ids
        return out, total[limits] + np.arange(n_text + 1)

    def prefix_counts(self, raw: bytes) -> np.ndarray:
        """Tokens of every prefix of a text: entry i counts the text's first i bytes taken as a text.

        Entries inside a character count its bytes so far. A special string that is cut short is
        ordinary text, so each stretch of text is counted together with the special string behind it.
        """
        out = np.zeros(len(raw) + 1, np.int32)
        done = 0
        while done < len(raw):
            at, size = min(
                ((raw.find(content, done), len(content)) for content, _ in self.specials if content in raw[done:]),
                default=(len(raw), 0),
            )
            out[done + 1 : at + size + 1] = out[done] + self._plain_prefixes(raw[done : at + size])[1:]
            if size:
                out[at + size] = out[at] + 1
            done = at + size
        return out

    def _plain_prefixes(self, raw: bytes) -> np.ndarray:
        """``prefix_counts`` for text without special strings.

        Two places need more than the piece's own table: a prefix that ends in a run of white space
        keeps the run whole, and an apostrophe parts from the letters of an ending that is cut short.
        """
        data = np.frombuffer(raw, np.uint8)
        out = np.zeros(len(data) + 1, np.int32)
        if not len(data):
            return out
        start = piece_starts(data, np.array([0, len(data)]))
        end = np.append(start[1:], len(data))
        pieces = [raw[a:b] for a, b in zip(start, end)]
        total = 0
        for piece, a, b, (_, count) in zip(pieces, start.tolist(), end.tolist(), self.prefix_tokens(pieces)):
            out[a + 1 : b + 1] = total + count[1:]
            if piece[0] == 0x27 and b - a == 3 and piece[1:] in ENDINGS:
                out[a + 2] = total + self.plain(piece[:1]) + self.plain(piece[1:2])
            total += int(count[-1])
        kind = byte_classes(data)
        edges = np.append(np.flatnonzero(np.append(True, kind[1:] != kind[:-1])), len(data)).tolist()
        for x, y in zip(edges[:-1], edges[1:]):
            if kind[x] == SPACE and y < len(data) and y - x > 1:
                out[x + 1 : y + 1] = out[x] + self.prefix_tokens([raw[x:y]])[0][1][1:]
        return out

    def plain(self, raw: bytes) -> int:
        """Tokens of a short text without special strings."""
        data = np.frombuffer(raw, np.uint8)
        start = piece_starts(data, np.array([0, len(data)]))
        end = np.append(start[1:], len(data))
        return sum(int(c[-1]) for _, c in self.prefix_tokens([raw[a:b] for a, b in zip(start, end)]))

    @property
    def size(self) -> np.ndarray:
        if not hasattr(self, "_size"):
            self._size = np.zeros(len(self.ids), np.int64)
            for b, t in self.number.items():
                self._size[t] = len(b)
        return self._size


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary by worker process."""
    return Bpe(path)
