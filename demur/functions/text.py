"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the listing data.
BATHROOM_PATTERN = r"([0-9\.]+)?([- A-Za-z]+)"
ROOM_PREFIX_PATTERN = r"(Private room( in )?)|(Shared room( in )?)|(Entire )|(Room in )"
PROPERTY_SYNONYM = ("casa particular", "home")
PROPERTY_KINDS = ("rental unit", "home", "condo", "loft", "serviced apartment")
RESPONSE_TIMES = ("within an hour", "within a few hours", "within a day", "a few days or more")
MISSING_TOKENS = ("", "NA", "NaN", "null", "N/A", "?")


def parse_money(text: Column) -> Column:
    """``$1,234.00`` -> 1234.0; text that is no number gives NULL."""
    return F.regexp_replace(text, r"[,$]", "").try_cast("double")


def parse_percent(text: Column) -> Column:
    """``95%`` -> 95.0."""
    return F.replace(text, F.lit("%"), F.lit("")).try_cast("double")


def bathroom_count(text: Column) -> Column:
    """Leading number of the text; 0.5 for a half bath."""
    number = F.nullif(F.regexp_extract(text, BATHROOM_PATTERN, 1), F.lit("")).try_cast("double")
    return F.when(_bathroom_words(text).rlike("half"), F.lit(0.5)).otherwise(number)


def bathroom_type(text: Column) -> Column:
    """Kind of bath in lower case; a plain bath is a ``regular bath``."""
    words = _bathroom_words(text)
    words = F.when(words.rlike("half"), F.replace(words, F.lit("half-"), F.lit(""))).otherwise(words)
    return F.when(words == "bath", F.lit("regular bath")).otherwise(words)


def _bathroom_words(text: Column) -> Column:
    raw = F.nullif(F.regexp_extract(text, BATHROOM_PATTERN, 2), F.lit(""))
    return F.replace(F.lower(F.trim(raw)), F.lit("baths"), F.lit("bath"))


def bucket_property(text: Column) -> Column:
    """Property kind without its room prefix: one of the kept kinds or ``other``."""
    kind = F.lower(F.regexp_replace(text, ROOM_PREFIX_PATTERN, ""))
    kind = F.when(kind == PROPERTY_SYNONYM[0], F.lit(PROPERTY_SYNONYM[1])).otherwise(kind)
    return F.when(kind.isin(*PROPERTY_KINDS), kind).otherwise(F.lit("other"))


def missing_to_null(text: Column) -> Column:
    """Tokens that stand for a missing value -> NULL, after trimming."""
    return F.when(F.trim(text).isin(*MISSING_TOKENS), None).otherwise(text)
