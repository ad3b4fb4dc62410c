"""One spelling for the keys of the domain: authors, communities, posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Unicode calls White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the sources write an author who is gone, and a reference that is none.
NO_AUTHOR = ("", "[deleted]", "[removed]")
NO_REFERENCE = ("", "none", "null", "nan")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """``c`` without blanks of any kind at both ends."""
    return F.btrim(_col(c), F.lit(BLANKS))


def folded(c: Column | str) -> Column:
    """Lower case without blanks around; null stays null."""
    return F.lower(strip(c))


def author_key(c: Column | str) -> Column:
    """The author's key, or null for a missing author or a tombstone."""
    k = folded(c)
    return F.when(~k.isin(*NO_AUTHOR), k)


def community_key(c: Column | str) -> Column:
    return folded(c)


def post_key(c: Column | str) -> Column:
    """Full lower-case post key; a key without its kind gets ``t3_``, one of another kind keeps it."""
    k = folded(c)
    return F.when(k.rlike("^t[0-9]_"), k).when(k != "", F.concat(F.lit("t3_"), k))


def reference_key(c: Column | str) -> Column:
    """The post a reference names, or null where it names none."""
    k = folded(c)
    return F.when(~k.isin(*NO_REFERENCE), post_key(c))
