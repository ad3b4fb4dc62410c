"""Tolerant casts and clean-up of raw fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.keys import BLANKS

#: Tombstones of authors and texts, and ways to write a missing value.
TOMBSTONES = ("[deleted]", "[removed]")
MISSING = ("", "none", "null", "nan")
#: Accounts that post automatically.
BOTS = ("AutoModerator", "RemindMeBot", "QualityVote", "Bot_Metric", "haikusbot", "WikiTextBot", "vredditDownloader", "image_linker_bot", "TrollaBot", "bot", "Bot")
#: White space as Python's str.strip and str.split see it, for Java and RE2 alike.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_space(c: Column) -> Column:
    """``c`` without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS + "\x1c\x1d\x1e\x1f"))


def missing_to_null(c: Column) -> Column:
    """Stripped; null where what is left is a way to write a missing value."""
    s = strip_space(c)
    return F.when(~F.lower(s).isin(*MISSING), s)


def null_to_word(c: Column) -> Column:
    """``None`` as a word in place of null."""
    return F.coalesce(c, F.lit("None"))


def falsy_to_word(c: Column) -> Column:
    """``None`` as a word in place of null and the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("None"))


def broken_font(title: Column) -> Column:
    """True for a title that is missing or holds the replacement character."""
    return title.isNull() | F.contains(title, F.lit("�"))


def epoch_date(epoch: Column) -> Column:
    """UTC date (YYYY-MM-DD) of whole epoch seconds given as number or text; null if they are none."""
    seconds = epoch.try_cast("bigint")
    return F.date_format(F.timestamp_seconds(F.when(seconds.between(-62135596800, 253402300799), seconds)), "yyyy-MM-dd")


def strict_date(c: Column) -> Column:
    """True for a calendar date written YYYY-MM-DD and nothing else."""
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull(), F.lit(False))


def json_type(v: Column) -> Column:
    """STRING, BIGINT, DOUBLE, ... of a variant; null where it is absent."""
    return F.schema_of_variant(v)


def json_long(record: Column, field: str, default: int = 0) -> Column:
    """A field as whole number: numbers lose their fraction, texts must be whole, true is 1; else ``default``."""
    text = F.try_variant_get(record, f"$.{field}", "string")
    v = F.try_variant_get(record, f"$.{field}", "variant")
    whole = F.when(strip_space(text).rlike(r"^[+-]?[0-9]+$"), strip_space(text).try_cast("bigint"))
    number = F.try_variant_get(record, f"$.{field}", "double").cast("decimal(38,6)").try_cast("bigint")
    kind = json_type(v)
    return F.coalesce(F.when(kind == "STRING", whole).when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0)).otherwise(F.coalesce(whole, number)), F.lit(default)).cast("bigint")


def json_double(record: Column, field: str, default: float) -> Column:
    """A field as double, from a number or a text; else ``default``."""
    return F.coalesce(F.try_variant_get(record, f"$.{field}", "string").try_cast("double"), F.lit(default))
