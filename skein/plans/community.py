"""Queries on the community tables: cleaning, ranking, graphs, migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import cleaning as c
from skein.functions import text as t
from skein.operators import checks, clean, graph, manifest, migration, rank
from skein.session import read


def _subs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read(spark, sf, "submissions", *columns)


def _activity(spark: SparkSession, sf: str) -> DataFrame:
    """Authors and communities of submissions and comments, people only."""
    both = _subs(spark, sf, "author", "subreddit").unionByName(read(spark, sf, "comments", "author", "subreddit"))
    return clean.without_bots(both)


def co_author_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The co-author graph of submissions and comments."""
    return graph.co_membership(_activity(spark, sf), "author", "subreddit")


def co_author_top20(spark: SparkSession, sf: str) -> DataFrame:
    return co_author_edges(spark, sf).orderBy(F.desc("weight"), "source", "target").limit(20)


def co_member_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that share customers."""
    o, i = read(spark, sf, "orders", "o_orderkey", "o_custkey"), read(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    return graph.co_membership(o.join(i, o.o_orderkey == i.l_orderkey), "o_custkey", "l_suppkey")


def jaccard_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return graph.jaccard(_activity(spark, sf), "author", "subreddit")


def communities_per_author(spark: SparkSession, sf: str) -> DataFrame:
    return graph.communities_per_entity(_activity(spark, sf), "author", "subreddit")


def crosspost_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The directed crosspost graph, keys as delivered."""
    posts = _subs(spark, sf, "name", "crosspost_parent", "subreddit").where(F.col("name").startswith("t3_"))
    return graph.cross_reference(posts, "name", "crosspost_parent", "subreddit")


def crosspost_top20(spark: SparkSession, sf: str) -> DataFrame:
    return crosspost_edges(spark, sf).orderBy(F.desc("weight"), F.asc_nulls_first("source"), F.asc_nulls_first("target")).limit(20)


def bot_filter(spark: SparkSession, sf: str) -> DataFrame:
    return clean.without_bots(_subs(spark, sf, "name", "author", "subreddit", "ingested_at"))


def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["name", "subreddit", "author", "title", "score", "num_comments", "upvote_ratio", "created_utc"]
    return clean.quality_posts(_subs(spark, sf, *cols))


def missing_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """crosspost_parent and selftext with every way to write nothing made null, then the word None."""
    s = _subs(spark, sf, "name", "crosspost_parent", "selftext", "domain")
    parent, body = c.missing_to_null(F.col("crosspost_parent")), c.missing_to_null(F.col("selftext"))
    return s.select("name", parent.alias("parent"), c.null_to_word(parent).alias("parent_word"), body.alias("body"), c.falsy_to_word(F.col("domain")).alias("domain_word"))


def date_clean(spark: SparkSession, sf: str) -> DataFrame:
    """created_utc as delivered, its date if it is epoch seconds, and whether it is a strict date."""
    d = F.col("created_utc")
    return _subs(spark, sf, "name", "created_utc").select("name", "created_utc", c.epoch_date(d).alias("from_epoch"), c.strict_date(d).alias("is_date")).distinct()


def clean_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Raw JSON lines as canonical submissions."""
    return clean.clean_submissions(clean.parse_objects(read(spark, sf, "raw_submissions", "payload"), "payload"))


def clean_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments through JSON and back as canonical comments, dated by the epoch seconds of their arrival, as raw files have them."""
    own = read(spark, sf, "comments")
    epoch = F.unix_seconds(F.col("ingested_at").cast("timestamp"))
    lines = own.withColumn("created_utc", F.coalesce(epoch.cast("string"), F.col("created_utc"))).drop("ingested_at").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    return clean.clean_comments(clean.parse_objects(lines))


def json_events(spark: SparkSession, sf: str) -> DataFrame:
    """The whole number k in the properties of events."""
    e = read(spark, sf, "events", "event_id", "props")
    return e.select("event_id", c.json_long(F.try_parse_json("props"), "k", -1).alias("k"))


def _order() -> list:
    return [F.desc("score"), F.desc("num_comments"), F.desc("upvote_ratio"), F.asc("title"), F.asc("created_utc"), F.asc("author"), F.asc("name"), F.asc("ingested_at")]



def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The 1000 best posts of each community, people only."""
    cols = ["subreddit", "title", "score", "subreddit_subscribers", "domain", "num_comments", "upvote_ratio", "created_utc", "author", "name", "ingested_at"]
    top = rank.top_k(clean.without_bots(_subs(spark, sf, *cols)), "subreddit", _order(), 1000)
    return top.select("subreddit", "title", "score", "subreddit_subscribers", "domain")


def top_quality_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of quality with their rank in the community."""
    cols = ["name", "subreddit", "author", "title", "score", "num_comments", "upvote_ratio", "created_utc", "ingested_at"]
    top = rank.top_k(clean.quality_posts(_subs(spark, sf, *cols)), "subreddit", _order(), 1000, "rank_in_subreddit")
    return top.select("subreddit", "rank_in_subreddit", "author", "title", "score", "num_comments", "upvote_ratio", "created_utc")


def rank_check(spark: SparkSession, sf: str) -> DataFrame:
    """Communities whose delivered ranks are broken."""
    return rank.rank_violations(read(spark, sf, "top_posts_per_subreddit", "subreddit", "rank_in_subreddit").where("rank_in_subreddit is not null"), "subreddit", "rank_in_subreddit", 1000)


def embedding_input_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.embedding_input(read(spark, sf, "title_embedding_input", "title_for_embedding", "name", "rank_in_subreddit"))


_KEYS = ["subreddit", "author", "title", "score", "num_comments", "upvote_ratio", "created_utc"]


def recover_key(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked posts with the key of the submission that agrees in all other fields."""
    ranked = read(spark, sf, "top_posts_per_subreddit", "rank_in_subreddit", *_KEYS)
    return rank.recover_key(ranked, _subs(spark, sf, "name", *_KEYS), _KEYS, "name")


def recover_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rank.recover_stats(recover_key(spark, sf), "name")


def title_prepare_tidied(spark: SparkSession, sf: str) -> DataFrame:
    """The steps after composition alone, which SQL can follow: tidied, sifted, cut and counted."""
    return _prepared(_subs(spark, sf, "name", "title").distinct().select("name", t.tidy(F.col("title")).alias("title")))


def title_prepare(spark: SparkSession, sf: str) -> DataFrame:
    """The whole preparation: titles composed and tidied, sifted, cut to 200 characters and counted."""
    return _prepared(_subs(spark, sf, "name", "title").distinct().select("name", t.normalize_title(F.col("title")).alias("title")))


def _prepared(s: DataFrame) -> DataFrame:
    s = clean.valid_titles(s).withColumn("title_for_embedding", t.soft_truncate(F.col("title")))
    n = t.token_count(F.col("title_for_embedding"))
    return s.select("name", "title_for_embedding", n.alias("token_len"), (F.length("title") > 200).alias("truncated_by_chars"), (n > 64).alias("truncated_by_tokens"))


def title_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _subs(spark, sf, "name", "title").select("name", t.normalize_title(F.col("title")).alias("title"))


def title_demojize(spark: SparkSession, sf: str) -> DataFrame:
    return _subs(spark, sf, "name", "title").select("name", t.demojize("title").alias("title"))


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the community tables."""
    names = ["submissions", "comments", "top_posts_per_subreddit"]
    parts = [read(spark, sf, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Count, least, largest and mean figures of each community."""
    return _subs(spark, sf, "subreddit", "author", "score").groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_posts"), F.count_distinct("author").alias("n_authors"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("n_scored")
    )


_CUT = "2022-06-01"


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    s = clean.without_bots(_subs(spark, sf, "author", "subreddit", "created_utc")).where(c.strict_date(F.col("created_utc")))
    return s.withColumn("period", migration.period(F.col("created_utc"), _CUT))


def pre_post_activity(spark: SparkSession, sf: str) -> DataFrame:
    return migration.activity(_dated(spark, sf), "author", "period")


def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return migration.transitions(_dated(spark, sf), "author", "subreddit", "period")


def period_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return migration.overlap(_dated(spark, sf), "author", "subreddit", "period")


def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and hour."""
    from skein.streaming.ingest import windowed_counts

    return windowed_counts(read(spark, sf, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def quality_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How many posts each step of the quality filter takes in, keeps and drops."""
    texts = {f: c.missing_to_null(F.col(f)) for f in ("subreddit", "author", "title", "created_utc")}
    s = _subs(spark, sf, *texts, "score", "num_comments", "upvote_ratio").withColumns(texts)
    steps = {
        "complete": reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in s.columns)),
        "human": clean.human_author(F.col("author")),
        "dated": c.strict_date(F.col("created_utc")),
        "scored": F.col("score") >= 10,
        "discussed": F.col("num_comments") >= 3,
        "liked": F.col("upvote_ratio") >= 0.8,
        "titled": F.length("title") >= 15,
    }
    return clean.funnel(s, steps)


def community_files(spark: SparkSession, sf: str) -> DataFrame:
    """The file of each community in the embedding input, spelled in any way, with its rows; null where there is none."""
    asked = read(spark, sf, "title_embedding_input", "subreddit")
    stored = _subs(spark, sf, "subreddit").dropna().select(F.lower("subreddit").alias("s")).distinct().select("s", F.concat(F.lit("subreddit="), F.col("s")).alias("path"))
    return manifest.map_files(asked, "subreddit", stored.where("s < 'm'"), "s")


def community_file_misses(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.map_misses(community_files(spark, sf))


QUERIES = {f.__name__: f for f in (
    quality_funnel, community_files, community_file_misses,
    co_author_edges, co_author_top20, co_member_edges, jaccard_overlap, communities_per_author, crosspost_edges, crosspost_top20, bot_filter, quality_filter, missing_normalize, date_clean,
    clean_submissions, clean_comments, json_events, topk_per_group, top_quality_posts, rank_check, embedding_input_check, recover_key, recover_stats, title_prepare, title_prepare_tidied, title_normalize, title_demojize,
    table_counts, group_stats, pre_post_activity, transition_matrix, period_overlap, windowed_events,
)}

_SP = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BOTS = ", ".join(f"'{b}'" for b in c.BOTS)
_HUMAN = f"author NOT IN ({_BOTS}) AND NOT regexp_matches(author, '(?i)bot') AND subreddit IS NOT NULL"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _known(x: str) -> str:
    return f"CASE WHEN lower({_strip(x)}) NOT IN ('', 'none', 'null', 'nan') THEN {_strip(x)} END"


_CO = f"""
WITH a AS (SELECT DISTINCT author, subreddit FROM (SELECT author, subreddit FROM submissions UNION ALL SELECT author, subreddit FROM comments) WHERE {_HUMAN}),
k AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY author) < 50),
e AS (SELECT x.subreddit AS source, y.subreddit AS target, count(*) AS weight FROM k x JOIN k y ON x.author = y.author AND x.subreddit < y.subreddit GROUP BY ALL HAVING count(*) >= 5)
"""
_CROSS = """
WITH p AS (SELECT name, subreddit, crosspost_parent FROM submissions WHERE starts_with(name, 't3_')),
e AS (SELECT a.subreddit AS source, b.subreddit AS target, count(*) AS weight FROM p a JOIN p b ON a.name = b.crosspost_parent WHERE b.crosspost_parent NOT IN ('None', '') GROUP BY ALL)
"""
_STRICT = "regexp_full_match(created_utc, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(created_utc AS DATE) IS NOT NULL"
_QUALITY = f"""
WITH s AS (SELECT name, {_known("subreddit")} AS subreddit, {_known("author")} AS author, {_known("title")} AS title, {_known("created_utc")} AS created_utc,
                  CAST(score AS DOUBLE) AS score, CAST(num_comments AS DOUBLE) AS num_comments, upvote_ratio, ingested_at FROM submissions),
q AS (SELECT * FROM s WHERE subreddit IS NOT NULL AND author IS NOT NULL AND title IS NOT NULL AND {_STRICT}
      AND lower(author) NOT IN ('[deleted]', '[removed]', 'deleted', 'removed', 'automoderator') AND NOT contains(lower(author), 'bot')
      AND score >= 10 AND num_comments >= 3 AND upvote_ratio >= 0.8 AND length(title) >= 15)
"""
_ORD = "score DESC NULLS LAST, num_comments DESC NULLS LAST, upvote_ratio DESC NULLS LAST, title ASC NULLS FIRST, created_utc ASC NULLS FIRST, author ASC NULLS FIRST, name ASC NULLS FIRST, ingested_at ASC NULLS FIRST"
_DATED = f"WITH d AS (SELECT author, subreddit, CASE WHEN created_utc < '{_CUT}' THEN 'pre' ELSE 'post' END AS period FROM submissions WHERE {_HUMAN} AND {_STRICT})"
_W = r"[\p{L}\p{N}\p{M}\p{Pc}\x{200C}\x{200D}]+|[^\p{L}\p{N}\p{M}\p{Pc}\x{200C}\x{200D}\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_KEYS_SQL = " AND ".join(f"r.{k} IS NOT DISTINCT FROM l.{k}" for k in _KEYS)
_RECOVER = f"""WITH l AS (SELECT {", ".join(_KEYS)}, min(name) AS name FROM submissions GROUP BY ALL),
j AS (SELECT r.rank_in_subreddit, {", ".join("r." + k for k in _KEYS)}, l.name FROM top_posts_per_subreddit r LEFT JOIN l ON {_KEYS_SQL})
"""



def _long(f: str) -> str:
    """A JSON field as whole number: numbers lose their fraction, texts must be whole, true is 1; else 0."""
    x = f"j->>'$.{f}'"
    return f"coalesce(CASE json_type(j, '$.{f}') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN try_cast(trim({x}) AS BIGINT) END WHEN 'BOOLEAN' THEN CASE WHEN {x} = 'true' THEN 1 ELSE 0 END ELSE CAST(trunc(try_cast({x} AS DOUBLE)) AS BIGINT) END, 0) AS {f}"


_FILES = """
WITH t AS (SELECT lower(trim(subreddit)) AS community, count(*) AS n_rows FROM title_embedding_input WHERE subreddit IS NOT NULL GROUP BY 1),
f AS (SELECT DISTINCT lower(subreddit) AS s FROM submissions WHERE lower(subreddit) < 'm'),
j AS (SELECT community, n_rows, 'subreddit=' || s AS path FROM t LEFT JOIN f ON s = community)
"""
_STEPS = {"complete": "subreddit IS NOT NULL AND author IS NOT NULL AND title IS NOT NULL AND created_utc IS NOT NULL AND score IS NOT NULL AND num_comments IS NOT NULL AND upvote_ratio IS NOT NULL",
          "human": "lower(author) NOT IN ('', 'none', 'null', 'nan', '[deleted]', '[removed]', 'deleted', 'removed', 'automoderator') AND NOT contains(lower(author), 'bot')", "dated": _STRICT, "scored": "score >= 10", "discussed": "num_comments >= 3", "liked": "upvote_ratio >= 0.8", "titled": "length(title) >= 15"}
_FUNNEL = "WITH s AS (SELECT " + ", ".join(f"{_known(f)} AS {f}" for f in ("subreddit", "author", "title", "created_utc")) + ", score, num_comments, upvote_ratio FROM submissions), p AS (SELECT *, CASE " + " ".join(f"WHEN NOT coalesce({x}, false) THEN {i}" for i, x in enumerate(_STEPS.values(), 1)) + " ELSE 99 END AS out FROM s) " + " UNION ALL ".join(
    f"SELECT {i} AS step_no, '{n}' AS step, count(*) FILTER (out >= {i}) AS n_in, count(*) FILTER (out > {i}) AS n_kept, count(*) FILTER (out = {i}) AS n_dropped FROM p" for i, n in enumerate(_STEPS, 1))

ORACLE = {
    "quality_funnel": _FUNNEL,
    "community_files": _FILES + "SELECT * FROM j",
    "community_file_misses": _FILES + "SELECT count(*) AS n_communities, count(*) FILTER (path IS NULL) AS n_missing, coalesce(CAST(sum(n_rows) FILTER (path IS NULL) AS BIGINT), 0) AS n_rows_missing FROM j",
    "co_author_edges": _CO + "SELECT * FROM e",
    "co_author_top20": _CO + "SELECT * FROM e ORDER BY weight DESC, source, target LIMIT 20",
    "co_member_edges": """
WITH a AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey), k AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY c) < 50)
SELECT x.s AS source, y.s AS target, count(*) AS weight FROM k x JOIN k y ON x.c = y.c AND x.s < y.s GROUP BY ALL HAVING count(*) >= 5""",
    "jaccard_overlap": _CO + ", n AS (SELECT subreddit, count(*) AS n FROM k GROUP BY 1) SELECT source, target, weight, weight / CAST(p.n + q.n - weight AS DOUBLE) AS jaccard FROM e JOIN n p ON p.subreddit = source JOIN n q ON q.subreddit = target",
    "communities_per_author": _CO + "SELECT author, count(*) AS n_communities FROM a GROUP BY author",
    "crosspost_edges": _CROSS + "SELECT * FROM e",
    "crosspost_top20": _CROSS + "SELECT * FROM e ORDER BY weight DESC, source NULLS FIRST, target NULLS FIRST LIMIT 20",
    "bot_filter": f"SELECT name, author, subreddit, ingested_at FROM submissions WHERE {_HUMAN}",
    "quality_filter": _QUALITY + "SELECT * EXCLUDE (ingested_at) FROM q",
    "missing_normalize": f"""SELECT name, {_known("crosspost_parent")} AS parent, coalesce({_known("crosspost_parent")}, 'None') AS parent_word, {_known("selftext")} AS body, coalesce(nullif(domain, ''), 'None') AS domain_word FROM submissions""",
    "date_clean": rf"""SELECT DISTINCT name, created_utc, CASE WHEN regexp_full_match(trim(created_utc), '[+-]?[0-9]+') THEN strftime(make_timestamp(CAST(trim(created_utc) AS BIGINT) * 1000000), '%Y-%m-%d') END AS from_epoch,
  coalesce({_STRICT}, false) AS is_date FROM submissions""",
    "clean_submissions": f"""
WITH p AS (SELECT CAST(payload AS JSON) AS j FROM raw_submissions WHERE regexp_matches(payload, '^\\s*\\{{') AND json_valid(payload)),
t AS (SELECT j, j->>'$.author' AS author, j->>'$.name' AS name, j->>'$.title' AS title, j->>'$.selftext' AS selftext, j->>'$.created_utc' AS epoch FROM p),
k AS (SELECT * FROM t WHERE author NOT IN ('[deleted]', '[removed]') AND name IS NOT NULL AND json_type(j, '$.title') = 'VARCHAR' AND NOT contains(title, chr(65533)) AND coalesce(selftext, '') NOT IN ('[deleted]', '[removed]'))
SELECT author, CASE WHEN regexp_full_match(trim(epoch), '[+-]?[0-9]+') THEN strftime(make_timestamp(CAST(trim(epoch) AS BIGINT) * 1000000), '%Y-%m-%d') END AS created_utc,
  coalesce(j->>'$.crosspost_parent', 'None') AS crosspost_parent, coalesce(j->>'$.domain', 'None') AS domain, {_long("num_comments")}, {_long("num_crossposts")}, {_long("score")}, name,
  j->>'$.subreddit' AS subreddit, j->>'$.subreddit_id' AS subreddit_id, {_long("subreddit_subscribers")}, title, coalesce(nullif(selftext, ''), 'None') AS selftext, coalesce(try_cast(j->>'$.upvote_ratio' AS DOUBLE), 1.0) AS upvote_ratio FROM k""",
    "clean_comments": """SELECT author, body, strftime(ingested_at, '%Y-%m-%d') AS created_utc, controversiality, score, name, parent_id, subreddit, subreddit_id, link_id FROM (SELECT * REPLACE (coalesce(controversiality, 0) AS controversiality, coalesce(score, 0) AS score) FROM comments)
WHERE author NOT IN ('[deleted]', '[removed]') AND body NOT IN ('[deleted]', '[removed]') AND link_id IS NOT NULL AND name IS NOT NULL AND parent_id IS NOT NULL""",
    "json_events": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events",
    "topk_per_group": f"SELECT subreddit, title, score, subreddit_subscribers, domain FROM submissions WHERE {_HUMAN} QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY {_ORD}) <= 1000",
    "top_quality_posts": _QUALITY + f"SELECT subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY {_ORD}) AS rank_in_subreddit, author, title, score, num_comments, upvote_ratio, created_utc FROM q QUALIFY rank_in_subreddit <= 1000",
    "rank_check": """SELECT subreddit, min(rank_in_subreddit) AS first, max(rank_in_subreddit) AS last, count(*) AS n, count(DISTINCT rank_in_subreddit) AS n_ranks FROM top_posts_per_subreddit
WHERE rank_in_subreddit IS NOT NULL GROUP BY subreddit HAVING first <> 1 OR last <> n OR n_ranks <> n OR last > 1000""",
    "embedding_input_check": """SELECT 'text' AS "check", count(*) FILTER (title_for_embedding IS NULL) AS n_violations FROM title_embedding_input UNION ALL
SELECT 'name', count(*) FILTER (name IS NULL) FROM title_embedding_input UNION ALL SELECT 'rank', count(*) FILTER (rank_in_subreddit IS NULL OR rank_in_subreddit < 1) FROM title_embedding_input""",
    "recover_key": _RECOVER + "SELECT * FROM j",
    "recover_stats": _RECOVER + "SELECT count(*) AS n_rows, count(name) AS n_found, count(*) - count(name) AS n_missed FROM j",
    "title_prepare_tidied": rf"""
WITH s AS (SELECT DISTINCT name, title FROM submissions WHERE title IS NOT NULL),
t AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[\t\n\r]', ' ', 'g'), '[\p{{C}}]', '', 'g'), '{_SP}+', ' ', 'g'), '^ | $', '', 'g') AS title FROM s),
v AS (SELECT name, title, regexp_replace(substring(title, 1, 200), '{_SP}+$', '') AS cut FROM t WHERE lower(title) NOT IN ('', 'none', 'null', 'nan', '[deleted]') AND length(title) >= 15),
b AS (SELECT *, CASE WHEN instr(reverse(cut), ' ') = 0 THEN -1 ELSE length(cut) - instr(reverse(cut), ' ') END AS last FROM v),
f AS (SELECT name, length(title) > 200 AS truncated_by_chars, CASE WHEN length(title) <= 200 THEN title WHEN last <= 100 THEN cut ELSE regexp_replace(substring(cut, 1, last), '{_SP}+$', '') END AS title_for_embedding FROM b)
SELECT name, title_for_embedding, CAST(len(regexp_extract_all(title_for_embedding, '{_W}')) AS INTEGER) AS token_len, truncated_by_chars, token_len > 64 AS truncated_by_tokens FROM f""",
    "table_counts": "SELECT 'submissions' AS table_name, count(*) AS n_rows FROM submissions UNION ALL SELECT 'comments', count(*) FROM comments UNION ALL SELECT 'top_posts_per_subreddit', count(*) FROM top_posts_per_subreddit",
    "group_stats": "SELECT subreddit, count(*) AS n_posts, count(DISTINCT author) AS n_authors, min(score) AS min_score, max(score) AS max_score, CAST(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_scored FROM submissions GROUP BY subreddit",
    "pre_post_activity": _DATED + "SELECT author, period, count(*) AS n FROM d GROUP BY ALL",
    "transition_matrix": _DATED + """, n AS (SELECT author, period, subreddit, count(*) AS c FROM d GROUP BY ALL), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY author, period ORDER BY c DESC, subreddit) = 1),
m AS (SELECT p.subreddit AS source, q.subreddit AS target, count(*) AS n FROM b p JOIN b q ON p.author = q.author AND p.period = 'pre' AND q.period = 'post' GROUP BY ALL)
SELECT source, target, n, n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS share FROM m""",
    "period_overlap": _DATED + """, s AS (SELECT subreddit, author, max((period = 'pre')::INT) AS a, max((period = 'post')::INT) AS b FROM d GROUP BY ALL)
SELECT subreddit, CAST(sum(a) AS BIGINT) AS n_pre, CAST(sum(b) AS BIGINT) AS n_post, CAST(sum(a * b) AS BIGINT) AS n_both, sum(a * b) / CAST(sum(a) + sum(b) - sum(a * b) AS DOUBLE) AS jaccard FROM s GROUP BY subreddit""",
    "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
