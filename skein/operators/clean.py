"""Cleaning of raw records and filters for quality and automation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import cleaning as c


def parse_objects(lines: DataFrame, column: str = "value") -> DataFrame:
    """``record`` (variant) of each line that is a JSON object; blank, broken and other lines are dropped."""
    return lines.where(F.col(column).rlike(r"^\s*\{")).withColumn("record", F.try_parse_json(column)).where(F.col("record").isNotNull())


def _text(field: str) -> Column:
    return F.try_variant_get("record", f"$.{field}", "string")


def _kind(field: str) -> Column:
    return c.json_type(F.try_variant_get("record", f"$.{field}", "variant"))


def clean_submissions(records: DataFrame) -> DataFrame:
    """Submissions of the canonical 14 columns from ``record`` variants.

    Dropped: author missing or a tombstone, name missing, title that is no string or holds the
    replacement character, body a tombstone. Empty authors and titles stay. Numbers default to
    0, the ratio to 1.0, absent texts to the word None.
    """
    r = F.col("record")
    kept = records.where(_text("author").isNotNull() & ~_text("author").isin(*c.TOMBSTONES) & _text("name").isNotNull())
    kept = kept.where((_kind("title") == "STRING") & ~c.broken_font(_text("title")) & ~F.coalesce(_text("selftext").isin(*c.TOMBSTONES), F.lit(False)))
    long = lambda f: c.json_long(r, f).alias(f)
    return kept.select(
        _text("author").alias("author"), c.epoch_date(_text("created_utc")).alias("created_utc"), c.null_to_word(_text("crosspost_parent")).alias("crosspost_parent"),
        c.null_to_word(_text("domain")).alias("domain"), long("num_comments"), long("num_crossposts"), long("score"), _text("name").alias("name"), _text("subreddit").alias("subreddit"),
        _text("subreddit_id").alias("subreddit_id"), long("subreddit_subscribers"), _text("title").alias("title"), c.falsy_to_word(_text("selftext")).alias("selftext"),
        c.json_double(r, "upvote_ratio", 1.0).alias("upvote_ratio"),
    )


def clean_comments(records: DataFrame) -> DataFrame:
    """Comments of the canonical 10 columns from ``record`` variants.

    Dropped: author or body missing or a tombstone, link_id, name or parent_id missing. A
    parent_id that is no string is replaced by link_id, which becomes text. Empty bodies stay.
    """
    r = F.col("record")
    kept = records.where(_text("author").isNotNull() & ~_text("author").isin(*c.TOMBSTONES) & _text("body").isNotNull() & ~_text("body").isin(*c.TOMBSTONES))
    kept = kept.where(_text("link_id").isNotNull() & _text("name").isNotNull() & _text("parent_id").isNotNull())
    return kept.select(
        _text("author").alias("author"), _text("body").alias("body"), c.epoch_date(_text("created_utc")).alias("created_utc"), c.json_long(r, "controversiality").alias("controversiality"),
        c.json_long(r, "score").alias("score"), _text("name").alias("name"), F.when(_kind("parent_id") == "STRING", _text("parent_id")).otherwise(_text("link_id")).alias("parent_id"),
        _text("subreddit").alias("subreddit"), _text("subreddit_id").alias("subreddit_id"), _text("link_id").alias("link_id"),
    )


def without_bots(df: DataFrame, author: str = "author", community: str = "subreddit", names: tuple[str, ...] = c.BOTS) -> DataFrame:
    """Rows of people: author not listed and without "bot" in any case, author and community there."""
    a = F.col(author)
    return df.where(~a.isin(*names) & ~a.rlike("(?i)bot") & a.isNotNull() & F.col(community).isNotNull())


def human_author(author: Column) -> Column:
    """True for an author that is no missing word, tombstone, moderator or bot; null for null."""
    a = F.lower(author)
    return ~a.isin(*c.MISSING, *c.TOMBSTONES, "deleted", "removed") & (a != "automoderator") & ~F.contains(a, F.lit("bot"))


def quality_posts(df: DataFrame, score: int = 10, comments: int = 3, ratio: float = 0.8, title: int = 15) -> DataFrame:
    """Posts by people with a valid date that reach all four thresholds (inclusive).

    Text fields are stripped, missing words become null, measures are cast; rows that lack any
    of the required fields are dropped.
    """
    texts = ["subreddit", "author", "title", "created_utc"]
    numbers = ["score", "num_comments", "upvote_ratio"]
    df = df.withColumns({f: c.missing_to_null(F.col(f)) for f in texts} | {f: F.col(f).try_cast("double") for f in numbers}).dropna(subset=[*texts, *numbers])
    df = df.where(human_author(F.col("author")) & c.strict_date(F.col("created_utc")))
    return df.where((F.col("score") >= score) & (F.col("num_comments") >= comments) & (F.col("upvote_ratio") >= ratio) & (F.length("title") >= title))


def valid_titles(df: DataFrame, title: str = "title", least: int = 15) -> DataFrame:
    """Rows whose title is there, is no missing word or ``[deleted]``, and has ``least`` characters."""
    t = F.col(title)
    return df.where(t.isNotNull() & ~F.lower(t).isin(*c.MISSING, "[deleted]") & (F.length(t) >= least))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """step_no, step, n_in, n_kept, n_dropped: what each condition, in order, drops of what the ones before kept.

    One pass that moves one row of counters per task. A null condition drops; an empty table
    gives every step with zeros.
    """
    out = F.lit(len(steps) + 1)
    for i, condition in reversed(list(enumerate(steps.values(), 1))):
        out = F.when(~F.coalesce(condition, F.lit(False)), F.lit(i)).otherwise(out)
    counters = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), *(F.count_if(test).alias(n) for n, test in (("n_in", F.col("_out") >= i), ("n_kept", F.col("_out") > i), ("n_dropped", F.col("_out") == i)))) for i, name in enumerate(steps, 1)]
    return df.select(out.alias("_out")).agg(F.array(*counters).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
