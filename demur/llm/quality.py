"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule votes good (1), bad (-1) or abstains (0) from counts of a text. The counts are built-in
functions by row, so no row is shuffled; only vote patterns are grouped (at most ``3 ** rules`` of them).
EM runs over that small table as aggregates: the E-step is an expression, the M-step one row of sums.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.registry import query, stored, table
from demur.session import num_lit

WORD = "[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+"
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """``good`` and ``bad``: conditions over the counts; neither true means that the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 60", "n_words < 40"),
    Rule("word_length", "word_chars between 3 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 30 * n_words"),
    # a vocabulary grows with the root of the length: from 2,000 words on, the shares go down so, without a step
    Rule(
        "variety",
        "if(n_words <= 2000, 100 * n_distinct >= 25 * n_words, n_distinct * n_distinct >= 125 * n_words)",
        "if(n_words <= 2000, 100 * n_distinct < 10 * n_words, n_distinct * n_distinct < 20 * n_words)",
    ),
    Rule("capitals", "100 * n_capitals <= 10 * word_chars", "100 * n_capitals > 40 * word_chars"),
    Rule("marks", "100 * n_marks <= 6 * word_chars", "100 * n_marks > 9 * word_chars"),
)
MAX_RULES = 8
ROUNDS = 25
# Start and limits of a rule's accuracy on good and on bad texts. A rule looks for one fault: it seldom
# speaks against a good text, but passes the many bad texts that have other faults.
GOOD_START, GOOD_LIMITS = 0.95, (0.8, 0.995)
BAD_START, BAD_LIMITS = 0.3, (0.05, 0.99)
# share of good texts that EM starts from
PRIOR = 0.8
KEEP_FROM = 0.5


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every row's whole text: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, ...``.

    Windows of three words are found twice by sorting their hashes with their places in the row's own
    array; the words they cover follow from the sorted places. A null text has no word.
    """
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
        *keep,
    )
    df = df.withColumn("w", F.expr(f"regexp_extract_all(t, '{WORD}', 0)"))
    # hashes and places of the windows, in one sorted array
    df = df.withColumn("n", F.expr("size(w)")).withColumn(
        "s",
        F.expr(
            "if(n < 4, null, sort_array(transform(slice(w, 1, n - 2), "
            "(x, i) -> named_struct('h', xxhash64(x, w[i + 1], w[i + 2]), 'i', i))))"
        ),
    )
    # places of windows that a neighbour in that order equals
    df = df.withColumn(
        "p",
        F.expr(
            "if(s is null, null, sort_array(transform(filter(s, (x, k) -> "
            "(k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h)), x -> x.i)))"
        ),
    )
    lines = "filter(split(t, '\\n', -1), l -> l rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')"
    df = df.withColumn("l", F.expr(lines))
    return df.select(
        "doc_id",
        F.expr("cast(n as bigint) as n_words"),
        F.expr("cast(length(translate(t, ' \\t\\n\\u000b\\u000c\\r', '')) as bigint) as word_chars"),
        F.expr(f"cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols"),
        F.expr("cast(size(l) - size(array_distinct(l)) as bigint) as n_dup_lines"),
        # each window covers three words, less those that the next one covers as well
        F.expr(
            "if(p is null or size(p) = 0, 0L, aggregate(transform(p, (x, k) -> "
            "if(k < size(p) - 1, least(3, p[k + 1] - x), 3)), 0L, (a, x) -> a + x)) as n_repeat_words"
        ),
        F.expr("cast(size(l) as bigint) as n_lines"),
        F.expr("cast(size(array_distinct(w)) as bigint) as n_distinct"),
        F.expr("cast(length(t) - length(regexp_replace(t, '\\\\p{Lu}', '')) as bigint) as n_capitals"),
        F.expr("cast(length(t) - length(regexp_replace(t, '[!-/:-@\\\\[-`{-~]', '')) as bigint) as n_marks"),
        *keep,
    )


def add_votes(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``v_<rule>``: 1, -1 or 0."""
    return counts.withColumns(
        {f"v_{r.name}": F.expr(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end") for r in rules}
    )


class Weights(NamedTuple):
    """``prior``: share of good texts; ``good[r]`` and ``bad[r]``: accuracy of rule r on good and on bad texts."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: list[str]) -> str:
        """Probability of good as an expression over the votes."""
        odds = num_lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.good, self.bad):
            up, down = num_lit(math.log(g / (1 - b))), num_lit(math.log((1 - g) / b))
            odds += f" + case {v} when 1 then {up} when -1 then {down} else 0D end"
        return f"1D / (1D + exp(-({odds})))"


def estimate(votes: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Weights:
    """Expectation-maximisation over the vote patterns of all rows; an empty table keeps the start values.

    Abstaining says nothing about a text (its probability does not depend on the class).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules: the patterns are 3 ** rules")
    names = [f"v_{r.name}" for r in rules]
    weights = Weights(PRIOR, (GOOD_START,) * len(rules), (BAD_START,) * len(rules))
    patterns = stored(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "votes")
    for _ in range(rounds):
        q = f"n * ({weights.posterior(names)})"
        sums = patterns.withColumn("q", F.expr(q)).agg(
            F.sum("n").alias("n"),
            F.sum("q").alias("q"),
            *(F.expr(f"sum(if({v} <> 0, q, 0D)) as g_{v}") for v in names),
            *(F.expr(f"sum(if({v} = 1, q, 0D)) as gu_{v}") for v in names),
            *(F.expr(f"sum(if({v} <> 0, n - q, 0D)) as b_{v}") for v in names),
            *(F.expr(f"sum(if({v} = -1, n - q, 0D)) as bd_{v}") for v in names),
        ).first()
        if not sums["n"]:
            break

        def held(hits: float, of: float, start: float, limits: tuple[float, float]) -> float:
            # ten votes besides as at the start, so that a rule without votes keeps what it had
            return min(limits[1], max(limits[0], (hits + 10 * start) / (of + 10)))

        new = Weights(
            min(0.99, max(0.01, sums["q"] / sums["n"])),
            tuple(held(sums[f"gu_{v}"], sums[f"g_{v}"], GOOD_START, GOOD_LIMITS) for v in names),
            tuple(held(sums[f"bd_{v}"], sums[f"b_{v}"], BAD_START, BAD_LIMITS) for v in names),
        )
        moved = max(abs(x - y) for x, y in zip((new.prior, *new.good, *new.bad), (weights.prior, *weights.good, *weights.bad)))
        weights = new
        if moved < 1e-6:
            break
    return weights


def quality(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, ``base_failed``, votes, ``posterior`` and ``kept`` of every row.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated windows; such a row is
    never kept. Any other is kept if its posterior is ``KEEP_FROM`` or more. Null and empty texts have no
    word and fail. Rows with equal ids or texts are judged one by one. The counts are written once to the
    shared folder, since EM and the verdict both read them. ``keep``: more columns to carry.
    """
    counts = stored(text_counts(docs, id_col, text_col, keep), "quality")
    votes = add_votes(counts, rules)
    weights = estimate(votes, rules)
    failed = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
    return votes.withColumns(
        {
            "base_failed": F.expr(failed),
            "posterior": F.expr(weights.posterior([f"v_{r.name}" for r in rules])),
        }
    ).withColumn("kept", F.expr(f"not base_failed and posterior >= {KEEP_FROM}D"))


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = quality(table(spark, sf_dir, "documents"))
    return out.select(*first, "posterior", *(f"v_{r.name}" for r in RULES))
