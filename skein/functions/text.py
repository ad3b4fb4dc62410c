"""Text preparation for embedding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.cleaning import SPACE


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which Spark has no function for; ASCII is passed through."""
    for t in texts:
        yield t.map(lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s), na_action="ignore")


def tidy(c: Column) -> Column:
    """Tabs and line ends to blanks, other control and format characters out, blanks collapsed and stripped."""
    seen = F.regexp_replace(F.regexp_replace(c, r"[\t\n\r]", " "), r"\p{C}", "")
    return F.regexp_replace(F.regexp_replace(seen, f"{SPACE}+", " "), "^ | $", "")


def normalize_title(c: Column) -> Column:
    """Compatibility composition, then :func:`tidy`; null stays null."""
    return tidy(nfkc(c))


def _right_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def soft_truncate(c: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at the last blank if that lies in the second half."""
    cut = _right_strip(F.substring(c, 1, most))
    back = F.locate(" ", F.reverse(cut))
    last = F.when(back == 0, -1).otherwise(F.length(cut) - back)
    return F.when(F.length(c) <= most, c).when(last <= most // 2, cut).otherwise(_right_strip(F.substring(cut, F.lit(1), last)))


def token_count(c: Column) -> Column:
    """Runs of word characters and runs of other visible characters."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0)))


def _pictograph(char: str) -> bool:
    return unicodedata.category(char) == "So" or 0x1F000 <= ord(char) <= 0x1FAFF


#: Two letters of a flag, or a sign with what joins it: variation selector, skin tone, keycap, further signs after a joiner.
_SEQUENCE = re.compile("[\U0001f1e6-\U0001f1ff]{2}|[^\x00-\xa8](?:[\ufe0f\u20e3\U0001f3fb-\U0001f3ff]|\u200d[^\x00-\xa8])*")


def _emoji_name(found: re.Match) -> str:
    """A sequence's name between blanks: ``flag_`` and its letters, or the Unicode names of its signs."""
    s = found[0]
    if not _pictograph(s[0]):
        return s
    if len(s) == 2 and all("\U0001f1e6" <= c <= "\U0001f1ff" for c in s):
        return f" flag_{''.join(chr(ord(c) - 0x1F1E6 + 97) for c in s)} "
    names = [unicodedata.name(c, "") for c in s if c not in "\u200d\ufe0f\u20e3"]
    return f" {'_'.join(n.lower().replace(' ', '_').replace('-', '_') for n in names)} " if all(names) else s


@F.pandas_udf(StringType())
def demojize(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Pictographs replaced by their Unicode names between blanks, joined sequences, skin tones and flags as one; null stays null."""
    for t in texts:
        yield t.map(lambda s: s if s.isascii() else _SEQUENCE.sub(_emoji_name, s), na_action="ignore")
