"""Burrows-Wheeler transforms of sets of strings, merged by refining their interleave.

A shard is the transform of a block of strings: the character before each suffix, suffixes in order
(equal ones by string). Shards are merged without sorting suffixes again: an interleave by the first h
characters becomes one by h + 2 when every suffix is replaced by the one two characters longer, stably
by those two characters. A border between two neighbours appears at the depth that is their common
prefix; suffixes that stand alone between borders stay alone and are dropped.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# bytes packed into one number for the first order of a shard's suffixes, nine bits each (0 ends a string)
PACKED = 7


class Shard(NamedTuple):
    """``before[r]``: byte before the r-th suffix plus one, 0 before a whole string; ``strings``: how many."""

    before: np.ndarray
    strings: int

    def step(self) -> np.ndarray:
        """Rank of the suffix that is one character longer, -1 for whole strings.

        The empty suffixes come first; then suffixes stand by first character and, within it, in the
        order of what follows, which is the order in which their characters appear in ``before``.
        """
        order = np.argsort(self.before, kind="stable")
        whole = int((self.before == 0).sum())
        out = np.full(len(self.before), -1, np.int64)
        out[order[whole:]] = self.strings + np.arange(len(order) - whole)
        return out


def build(strings: list[bytes]) -> Shard:
    """Transform of a block of strings: suffixes are ordered by doubling the known length."""
    size = np.array([len(s) for s in strings])
    width = int(size.max())
    count = size + 1
    total = int(count.sum())
    first = np.cumsum(count) - count
    text = np.zeros(total + PACKED, np.int64)
    inside = np.ones(total, bool)
    inside[first + size] = False
    text[:total][inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    left = np.repeat(first + size, count) - np.arange(total)
    packed = np.zeros(total, np.int64)
    for k in range(PACKED):
        packed = (packed << 9) | np.where(left > k, text[k : total + k], 0)
    _, rank = np.unique(packed, return_inverse=True)
    known = PACKED
    while known < width:
        more = np.where(left > known, rank[np.minimum(np.arange(total) + known, total - 1)] + 1, 0)
        _, rank = np.unique(rank * (total + 1) + more, return_inverse=True)
        known *= 2
    order = np.argsort(rank, kind="stable")
    start = np.zeros(total, bool)
    start[first] = True
    before = np.where(start, 0, text[np.maximum(np.arange(total) - 1, 0)])
    return Shard(before[order].astype(np.uint16), len(strings))


def places(shard: Shard, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every suffix, read by walking back from the strings' ends."""
    string, offset = np.zeros(len(shard.before), np.int64), np.zeros(len(shard.before), np.int64)
    rank, who, at = np.arange(shard.strings), np.arange(shard.strings), sizes.astype(np.int64).copy()
    while len(rank):
        string[rank], offset[rank] = who, at
        rank = step[rank]
        go = rank >= 0
        rank, who, at = rank[go], who[go], at[go] - 1
    return string, offset


def repeated(blocks: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``interval, string, offset`` of the suffixes whose first ``depth`` (even) bytes stand more than once.

    Strings are numbered through all blocks. Suffixes of one interval have those bytes in common.
    """
    blocks = [b for b in blocks if b]
    shards = [build(b) for b in blocks]
    key, longer, string, offset, ranks, names = [], [], [], [], 0, 0
    for shard, strings in zip(shards, blocks):
        step = shard.step()
        who, at = places(shard, np.array([len(s) for s in strings]), step)
        one = shard.before.astype(np.int64) - 1
        two = np.where(step >= 0, step[step], -1)
        both = np.where(two >= 0, one[np.maximum(step, 0)] * 256 + one, -1)
        key.append(both)
        longer.append(np.where(two >= 0, two + ranks, -1))
        string.append(who + names)
        offset.append(at)
        ranks += len(step)
        names += len(strings)
    key, longer = np.concatenate(key), np.concatenate(longer)
    rank, group = np.arange(ranks), np.zeros(ranks, np.int64)
    for _ in range(depth // 2):
        go = longer[rank] >= 0
        rank, group = rank[go], group[go]
        # the two characters as 16 bits: the first decides, so it stands in the high byte
        by = key[rank].astype(np.uint16)
        order = np.argsort(by, kind="stable")
        by, group, rank = by[order], group[order], longer[rank[order]]
        border = np.ones(len(rank) + 1, bool)
        border[1:-1] = (by[1:] != by[:-1]) | (group[1:] != group[:-1])
        alone = border[:-1] & border[1:]
        group = np.cumsum(border[:-1])[~alone]
        rank = rank[~alone]
    return group, np.concatenate(string)[rank], np.concatenate(offset)[rank]
