"""Imports every module that registers queries."""

from demur.llm import (  # noqa: F401
    importance,
    jaccard,
    licenses,
    mixing,
    neighbours,
    packing,
    periods,
    pii,
    quality,
    repeats,
    spelling,
    tokens,
    winnow,
)
