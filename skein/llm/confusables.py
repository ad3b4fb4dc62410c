"""Texts that look the same but are stored as different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.keys import post_key
from skein.operators.skew import skew_join
from skein.session import read, stage

#: Letters of other scripts, each beside the Latin letter it looks like.
LETTERS = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    # Greek
    "α": "a", "ι": "i", "ϳ": "j", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "γ": "y", "ϲ": "c",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian
    "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u", "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U",
    # Latin beyond the alphabet
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Signs, each beside the ASCII sign it looks like.
SIGNS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "˗": "-", "⁃": "-",
    "‘": "'", "’": "'", "ʼ": "'", "ʹ": "'", "′": "'", "“": '"', "”": '"', "″": '"',
    "‚": ",", "⁄": "/", "∕": "/", "∶": ":", "ː": ":", "꞉": ":", ";": ";", "ǃ": "!", "∗": "*", "∼": "~", "∣": "|", "ǀ": "|",
}
#: Signs that leave a blank though Unicode doesn't call them white space.
BLANK_SIGNS = "⠀ㅤﾠ"
#: Ranges of code points that show nothing though they aren't of category Cf.
UNSEEN = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0xFE00, 0xFE0F), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
#: Compatibility forms that differ from their letters in width or style only, not in place or size.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Its compatibility form, s, looks otherwise.
NOT_ALIKE = "ſ"


class _Prototypes(dict):
    """Code point -> what it looks like, by table and rule; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        self[code] = shown = self._shown(chr(code))
        return shown

    def _shown(self, c: str) -> str:
        if " " < c <= "~":
            return c
        kind = unicodedata.category(c)
        if c in BLANK_SIGNS or kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
            return " "
        if kind in ("Cc", "Cf") or any(a <= ord(c) <= b for a, b in UNSEEN):
            return ""
        if near := LETTERS.get(c) or SIGNS.get(c):
            return near
        form = unicodedata.decomposition(c).split(" ")
        if form[0] in SAME_LOOK and form[1] != "0020" and c not in NOT_ALIKE:
            return "".join(self[int(x, 16)] for x in form[1:])
        return c


_PROTOTYPES = _Prototypes()
_BLANKS = re.compile("  +")


def skeleton(text: str) -> str:
    """What ``text`` looks like: two texts look the same if and only if their skeletons are equal.

    Canonical decomposition, every character replaced by its prototype (wide, styled and
    contextual forms, ligatures, look-alike letters and signs; what doesn't show goes), canonical
    decomposition again; runs of blanks become one and go at the ends. Case and accents stay,
    and no two ASCII letters, digits or signs meet.
    """
    shown = text if text.isascii() and text.isprintable() else unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_PROTOTYPES))
    return _BLANKS.sub(" ", shown).strip(" ")


@F.pandas_udf(StringType())
def skeletons(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`skeleton` of a column; null stays null."""
    for t in texts:
        yield t.map(skeleton, na_action="ignore")


#: Names in a block; a pair of blocks is the unit in which pairs are written out.
BLOCK = 256


def lookalike_pairs(df: DataFrame, scope: str, name: str, text: str, block: int = BLOCK) -> DataFrame:
    """Each two names of one ``scope`` whose texts look the same but are not the same string.

    Gives scope, name_a, name_b (name_a < name_b), each pair once. Rows with a null scope, name
    or text don't count; repeated rows count once; a name with several texts has each of them;
    a text of which nothing shows looks like any other such text.

    Texts are grouped by skeleton. Only groups of two strings or more go on, so a text repeated
    without change, however often, forms no pair. Strings of a group meet in pairs; the names of
    a string are cut into blocks, and each two blocks meet under a key of their own, by which
    they are moved before their pairs are written out. Only a name with several texts can bring
    a pair twice: only pairs of such names are compared once more.
    """
    rows = df.select(F.col(scope).alias("scope"), F.col(name).alias("name"), F.col(text).alias("text")).dropna().distinct()
    rows = stage(rows.select("scope", "name", F.md5(skeletons("text").cast("binary")).alias("look"), F.md5(F.col("text").cast("binary")).alias("string")), "confusables-looks")
    groups = rows.groupBy("scope", "look").agg(F.min("string").alias("_a"), F.max("string").alias("_b")).where("_a < _b").select("scope", "look")
    mixed = stage(skew_join(rows, groups, ["scope", "look"], "left_semi"), "confusables-mixed")
    several = mixed.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("scope", "name", F.lit(True).alias("several"))
    strings = stage(mixed.groupBy("scope", "look", "string").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks")), "confusables-strings")
    cut = skew_join(mixed, strings, ["scope", "look", "string"])
    cut = skew_join(stage(cut, "confusables-cut"), several, ["scope", "name"], "left")
    item = F.struct(F.coalesce("several", F.lit(False)).alias("several"), "name")
    blocks = stage(cut.groupBy("scope", "look", "string", F.pmod(F.xxhash64("name"), "n_blocks").alias("block")).agg(F.collect_list(item).alias("names")), "confusables-blocks")

    def side(s: str, names: str) -> DataFrame:
        return blocks.select("scope", "look", F.col("string").alias(f"string_{s}"), F.col("block").alias(f"block_{s}"), F.col("names").alias(names))

    def half(s: str) -> DataFrame:
        return strings.select("scope", "look", F.col("string").alias(f"string_{s}"), F.col("n_blocks").alias(f"n_{s}"))

    met = half("a").join(half("b"), ["scope", "look"]).where("string_a < string_b")
    for s in "ab":
        met = met.withColumn(f"block_{s}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{s}") - 1)))
    met = stage(met.drop("n_a", "n_b"), "confusables-pairs")
    met = skew_join(met, side("a", "x"), ["scope", "look", "string_a", "block_a"])
    met = skew_join(stage(met, "confusables-half"), side("b", "y"), ["scope", "look", "string_b", "block_b"])
    met = stage(met.repartition("scope", "look", "string_a", "block_a", "string_b", "block_b").select("scope", "x", "y"), "confusables-met")

    def product(x: Column, y: Column) -> DataFrame:
        return met.select("scope", F.explode(x).alias("p"), y.alias("y")).select("scope", F.col("p.name").alias("p"), F.explode("y").alias("q")).select("scope", "p", F.col("q.name").alias("q"))

    one, more = (lambda n: ~n["several"]), (lambda n: n["several"])
    again = product(F.filter("x", more), F.col("y")).unionByName(product(F.filter("x", one), F.filter("y", more))).where("p <> q")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select("scope", F.least("p", "q").alias("name_a"), F.greatest("p", "q").alias("name_b"))

    return ordered(product(F.filter("x", one), F.filter("y", one))).unionByName(ordered(again).distinct())


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "title_embedding_input", "name", "title", "title_for_embedding")
    both = F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("t")) for c in ("title", "title_for_embedding")))
    return rows.select(post_key("name").alias("name"), F.explode(both).alias("_t")).select("name", F.col("_t.f").alias("field_name"), F.col("_t.t").alias("text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose titles look the same but differ: field_name, name_a, name_b."""
    return lookalike_pairs(_titles(spark, sf_dir), "field_name", "name", "text").withColumnRenamed("scope", "field_name")


def p7_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post's texts in their one consistent form: name, field_name, text, skeleton."""
    return _titles(spark, sf_dir).withColumn("skeleton", skeletons("text"))


QUERIES = {"p7_found": p7_found, "p7_skeletons": p7_skeletons}
ORACLE: dict[str, str] = {}
