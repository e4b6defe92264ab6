"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is built-in functions. A pattern is run twice over the texts that can hold a match: once for
the matches, once for the gaps between them, and the running lengths of both are the positions. Every
pattern starts only where a match can start, and gives nothing back, so long runs of its characters cost
linear time and no stack.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.llm.registry import query, table
from demur.session import str_lit


class Kind(NamedTuple):
    """``needs``: cheap condition that every text with a match fulfils; ``valid``: check of a match ``m``.

    ``prior``: score of a valid match; a word of ``context`` before or behind it adds ``CONTEXT_GAIN``.
    """

    name: str
    pattern: str
    needs: str
    valid: str
    prior: float
    context: tuple[str, ...]


CONTEXT_GAIN = 0.3
THRESHOLD = 0.5
# characters looked at on both sides of a match
NEAR = 48

DIGITS = "regexp_replace(m, '[^0-9]', '')"
# every second digit from the right doubled, nines cast out
LUHN = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + "
    "if(i % 2 = 0, element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + int(substr(d, -i, 1))), "
    "int(substr(d, -i, 1)))) % 10 = 0"
)
# first four characters to the end, letters as 10 to 35, remainder by 97
MOD97 = (
    "aggregate(sequence(1, length(c)), 0, (s, i) -> "
    "(if(substr(c, 1 + (i + 3) % length(c), 1) between '0' and '9', "
    "s * 10 + int(try_cast(substr(c, 1 + (i + 3) % length(c), 1) as int)), "
    "s * 100 + ascii(substr(c, 1 + (i + 3) % length(c), 1)) - 55)) % 97) = 1"
)


# characters of an account number by country: the registry of ISO 13616 and the numbers in use without an entry
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_START = "(?:" + "|".join(sorted(" ".join(IBAN_LENGTHS.values()).split())) + ")[0-9]{2}"
# as long as its country says, so that capitals behind it stay outside; else as long as it goes, up to the next start
IBAN = (
    "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    + f"|[A-Z]{{2}}[0-9]{{2}}(?:(?:\\x20(?!{IBAN_START}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"
)


def _with(name: str, value: str, check: str) -> str:
    """``check`` over one value that is computed once: a one-element array stands for the name."""
    return f"exists(array({value}), {name} -> {check})"


BASE_KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "instr({t}, '@') > 0",
        "true",
        0.9,
        ("mail", "contact", "write"),
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"{t} rlike '[0-9][.][0-9]'",
        "forall(split(m, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and int(right(p, 3)) <= 255)",
        0.7,
        ("ip", "host", "server", "address"),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "{t} rlike '[0-9](?:[ -]?[0-9]){{12}}'",
        _with("d", DIGITS, f"length(d) between 13 and 19 and {LUHN}"),
        0.8,
        ("card", "visa", "credit", "payment"),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "instr({t}, '+') > 0",
        f"length({DIGITS}) between 9 and 15",
        0.7,
        ("phone", "call", "tel", "mobile", "fax"),
    ),
)
MORE_KINDS = (
    # account numbers of two letters, two check digits and up to 30 more by country, confirmed by mod 97
    Kind(
        "iban",
        IBAN,
        r"{t} rlike '[A-Z]{{2}}[0-9]{{2}}'",
        _with("c", "replace(m, ' ', '')", f"length(c) between 15 and 34 and {MOD97}"),
        0.9,
        ("iban", "account", "konto", "bank"),
    ),
    # no checksum: the form alone is not enough, a word nearby has to speak for it
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"{t} rlike '[0-9]-[0-9]{{2}}-[0-9]'",
        "substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00'"
        " and substr(m, 8) <> '0000'",
        0.3,
        ("ssn", "social", "security"),
    ),
    # access keys and passwords behind their name
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_])(?i:password|passwd|secret|token|api_?key)\x20?[=:]\x20?[\x22']?[A-Za-z0-9_+/.-]{12,}",
        "{t} rlike '(?i:password|passwd|secret|token|api_?key) ?[=:]'",
        "true",
        0.8,
        ("key", "login"),
    ),
)
ALL_KINDS = BASE_KINDS + MORE_KINDS


def _gaps_and_matches(df: DataFrame, text: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """Adds ``f_<kind>`` (matches) and ``g_<kind>`` (the gaps around them); null where none can be."""
    df = df.withColumns(
        {
            f"f_{k.name}": F.expr(f"if({k.needs.format(t=text)}, regexp_extract_all({text}, {str_lit(k.pattern)}, 0), null)")
            for k in kinds
        }
    )
    return df.withColumns(
        {
            f"g_{k.name}": F.expr(f"if(size(f_{k.name}) > 0, split({text}, {str_lit(k.pattern)}, -1), null)")
            for k in kinds
        }
    )


def _scored(kind: Kind) -> str:
    """Score of match i: null if its check fails."""
    words = str_lit("(?i)(?<![a-z])(?:" + "|".join(kind.context) + ")(?![a-z])")
    near = f"concat(right(g_{kind.name}[i], {NEAR}), ' ', left(g_{kind.name}[i + 1], {NEAR}))"
    return f"if({kind.valid}, {kind.prior}D + if({near} rlike {words}, {CONTEXT_GAIN}D, 0D), null)"


def _positions(kind: Kind) -> Column:
    """``array<struct<kind, s, e, score>>`` of the valid matches of a kind.

    Positions are running sums of the lengths of gaps and matches. They are taken in blocks of 128
    matches and then over the blocks, so that a text full of matches stays near linear.
    """
    name = kind.name
    item = "struct<s:int,e:int,score:double>"
    parts = (
        f"transform(f_{name}, (m, i) -> named_struct('g', length(g_{name}[i]), 'm', length(m), 'score', {_scored(kind)}))"
    )
    block = (
        "aggregate(b, named_struct('at', 0, 'out', cast(array() as array<" + item + ">)), (a, x) -> named_struct("
        "'at', a.at + x.g + x.m, 'out', a.out || array(named_struct('s', a.at + x.g, 'e', a.at + x.g + x.m, 'score', x.score))))"
    )
    blocks = (
        f"transform(sequence(0, (size(f_{name}) - 1) div 128), k -> slice(p, k * 128 + 1, 128))"
    )
    whole = (
        f"aggregate(transform({blocks}, b -> {block}), "
        f"named_struct('at', 0, 'out', cast(array() as array<array<{item}>>)), (a, x) -> named_struct("
        "'at', a.at + x.at, 'out', a.out || array(transform(x.out, y -> named_struct("
        "'s', a.at + y.s, 'e', a.at + y.e, 'score', y.score))))).out"
    )
    least = 0.0 if kind in BASE_KINDS else THRESHOLD
    return F.expr(
        f"if(size(f_{name}) > 0, transform(filter(flatten(flatten(transform(array({parts}), p -> {whole}))), "
        f"y -> y.score >= {least}D), y -> named_struct('kind', '{name}', 's', y.s, 'e', y.e, 'score', y.score)), "
        "cast(array() as array<struct<kind:string,s:int,e:int,score:double>>))"
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_<kind>..., base_sha256, spans, found`` for every row.

    ``spans``: ``kind:start:end`` in code points, end exclusive, by kind as listed in ``ALL_KINDS`` and
    then by start; ``base_sha256`` is over those of the first four kinds. ``found`` has the scores. Spans
    of the other kinds are kept from ``THRESHOLD`` on. A null or empty text has no span; rows with equal
    ids or texts are worked on one by one; other columns of the input are not carried.
    """
    df = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )
    df = _gaps_and_matches(df, "t", ALL_KINDS)
    df = df.select("doc_id", *(_positions(k).alias(f"p_{k.name}") for k in ALL_KINDS))
    label = "x -> concat_ws(':', x.kind, x.s, x.e)"
    base = "concat(" + ", ".join(f"p_{k.name}" for k in BASE_KINDS) + ")"
    every = "concat(" + ", ".join(f"p_{k.name}" for k in ALL_KINDS) + ")"
    return df.select(
        "doc_id",
        *(F.expr(f"cast(size(p_{k.name}) as bigint)").alias(f"n_{k.name}") for k in BASE_KINDS),
        F.expr(f"sha2(array_join(transform({base}, {label}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform({every}, {label}), ',')").alias("spans"),
        *(F.expr(f"cast(size(p_{k.name}) as bigint)").alias(f"n_{k.name}") for k in MORE_KINDS),
        F.expr(every).alias("found"),
    )


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with ``[EMAIL]``, ``[CARD]``, ... in place of the spans in the text.

    Kind by kind in the order of ``ALL_KINDS``, each over the text so far, so overlaps are settled by
    that order. A null text stays null.
    """
    names = docs.columns
    df = docs.withColumn("__t", F.col(text_col).cast("string"))
    for k in ALL_KINDS:
        least = 0.0 if k in BASE_KINDS else THRESHOLD
        df = _gaps_and_matches(df, "__t", (k,))
        parts = (
            f"transform(f_{k.name}, (m, i) -> concat(g_{k.name}[i], "
            f"if(coalesce({_scored(k)}, -1D) >= {least}D, '[{k.name.upper()}]', m)))"
        )
        df = df.withColumn(
            "__t",
            F.expr(f"if(size(f_{k.name}) > 0, array_join({parts}, '') || element_at(g_{k.name}, -1), __t)"),
        ).drop(f"f_{k.name}", f"g_{k.name}")
    return df.select(*(F.col("__t").alias(c) if c == text_col else F.col(f"`{c}`") for c in names))


@query("op4_pii")
def op4_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
