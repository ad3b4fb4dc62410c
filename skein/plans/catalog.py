"""Queries on a catalogue of files; the articles stand in for files of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import manifest as m
from skein.operators.sequence import running
from skein.session import read

#: Words of the tests that a catalogue is sifted by.
KEYWORDS = ["mirror", "press", "dump", "south"]
QUOTA = 200_000


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """idx, path, size, owner: a dump file for each article, of submissions or comments by turns."""
    d = read(spark, sf, "documents", "doc_id", "source", "n_chars")
    kind = F.when(F.col("doc_id") % 2 == 0, "submissions").otherwise("comments")
    name = F.concat(F.lit("dumps/"), F.initcap(F.coalesce("source", F.lit("none"))), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), kind, F.lit(".zst"))
    return d.select(F.col("doc_id").alias("idx"), name.alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.coalesce("source", F.lit("none")).alias("owner"))


def _trash(files: DataFrame) -> DataFrame:
    return files.where("owner = 'mirror-2'").select(m.base_name(F.col("path")).alias("name"))


def _stored(files: DataFrame) -> DataFrame:
    """Cleaned files of some owners, in numbered folders."""
    clean = F.regexp_replace(m.base_name(F.col("path")), r"\.zst$", "_cleaned.parquet")
    return files.where("owner >= 'q'").select(F.concat(F.lit("hub/folder_"), (F.col("idx") % 7).cast("string"), F.lit("/"), clean).alias("path"), "size")


def _stored_names(files: DataFrame) -> DataFrame:
    return _stored(files).select(F.regexp_replace(m.base_name(F.col("path")), r"_cleaned\.parquet$", "").alias("name"))


def _triaged(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    banned = files.where("owner = 'lab-dump-b'").select(F.regexp_replace(m.base_name(F.col("path")), r"_(submissions|comments)\.zst$", "").alias("name"))
    return m.triage(files, _trash(files), banned, _stored_names(files), KEYWORDS, 1000)


def file_triage(spark: SparkSession, sf: str) -> DataFrame:
    return _triaged(spark, sf)


def triage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return m.reason_totals(_triaged(spark, sf))


def keyword_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    return f.where(m.sensitive(m.base_name(F.col("path")), KEYWORDS)).select("idx", "path")


def quota_small_first(spark: SparkSession, sf: str) -> DataFrame:
    return m.pick_small_first(_files(spark, sf), QUOTA, "idx").select("idx", "size")


def quota_large_first(spark: SparkSession, sf: str) -> DataFrame:
    """The descending pick over the whole catalogue."""
    return m.pick_large_first(_files(spark, sf), QUOTA, "idx").select("idx", "size")


def owner_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each owner and their size in bytes, MB and GB."""
    n = _files(spark, sf).groupBy("owner").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    return n.select("*", m.in_units(F.col("bytes"), "MB").alias("mb"), m.in_units(F.col("bytes"), "GB").alias("gb"))


def batch_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The first batch: files in order until they reach the target."""
    return m.next_batch(_files(spark, sf), QUOTA, "idx").select("idx", "size")


def folder_rollover(spark: SparkSession, sf: str) -> DataFrame:
    return m.folders(_files(spark, sf), "idx", start=3, filled=95, most=100).select("idx", "folder")


def folder_state(spark: SparkSession, sf: str) -> DataFrame:
    return m.folder_state(_stored(_files(spark, sf)))


def priority_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return m.chunks(_files(spark, sf).select("idx"), "idx", 500)


def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Position and bytes before each file, over the whole catalogue."""
    return running(_files(spark, sf).select("idx", "size"), [F.asc("idx")], "size")


def trash_sibling_delete(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    return m.siblings_of_trash(_siblings(f), _trash(f)).select("path")


def _siblings(files: DataFrame) -> DataFrame:
    return files.select(F.concat(F.lit("hub/folder_1/"), m.sibling(m.base_name(F.col("path")))).alias("path"))


def delete_set(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    wanted = _siblings(f.where("owner < 'd'")).select(F.col("path").alias("name"))
    return m.deletions(_siblings(f), _trash(f), wanted, KEYWORDS[:1], 100)


def file_states(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf).select("idx", "size", "owner", ((F.col("idx") % 4) / 3.0).alias("progress"), (F.col("idx") % 2).alias("priority"))
    return m.states(f, f.where("owner = 'mirror-2'").select("idx"), f.where("owner <> 'conf-south'").select("idx")).select("idx", "state")


def folder_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = _stored(_files(spark, sf))
    return s.where(m.in_folder(F.col("path"), "hub/folder_2/")).select("path", "size")


QUERIES = {f.__name__: f for f in (
    file_triage, triage_totals, keyword_sensitive, quota_small_first, quota_large_first, owner_sizes, batch_pack, folder_rollover, folder_state, priority_chunks, running_totals, trash_sibling_delete, delete_set, file_states, folder_filter,
)}

_F = """WITH RECURSIVE d AS (SELECT doc_id AS idx, coalesce(source, 'none') AS s, coalesce(n_chars, 0) AS size FROM documents),
b AS (SELECT idx, size, s AS owner, upper(substr(s, 1, 1)) || lower(substr(s, 2)) || '_' || idx AS stem, CASE WHEN idx % 2 = 0 THEN 'submissions' ELSE 'comments' END AS kind, CASE WHEN idx % 2 = 0 THEN 'comments' ELSE 'submissions' END AS other FROM d),
f AS (SELECT *, stem || '_' || kind || '.zst' AS name, 'dumps/' || stem || '_' || kind || '.zst' AS path FROM b)
"""


def _hit(words: list[str]) -> str:
    return "(" + " OR ".join(f"(contains(lower(name), '{w}') AND (contains(name, '{w.capitalize()}') OR regexp_matches(lower(name), '(^|[^a-zA-Z]){w}')))" for w in words) + ")"


_TRIAGE = _F + f""", t AS (SELECT idx, path, size, owner, CASE WHEN size < 1000 THEN 'too_small' WHEN owner = 'mirror-2' THEN 'trash' WHEN owner = 'lab-dump-b' THEN 'banned'
  WHEN owner >= 'q' THEN 'present' WHEN {_hit(KEYWORDS)} THEN 'sensitive' ELSE 'keep' END AS reason FROM f)
"""
ORACLE = {
    "file_triage": _TRIAGE + "SELECT * FROM t",
    "triage_totals": _TRIAGE + "SELECT reason, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY reason",
    "keyword_sensitive": _F + f"SELECT idx, path FROM f WHERE {_hit(KEYWORDS)}",
    "quota_small_first": _F + f"SELECT idx, size FROM f QUALIFY sum(size) OVER (ORDER BY size, idx ROWS UNBOUNDED PRECEDING) <= {QUOTA}",
    "quota_large_first": _F + f""", o AS MATERIALIZED (SELECT idx, size, row_number() OVER (ORDER BY size DESC, idx) AS rn FROM f),
g AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS idx, 0::BIGINT AS size, 0::BIGINT AS total, false AS taken UNION ALL
  SELECT o.rn, o.idx, o.size, CASE WHEN g.total + o.size <= {QUOTA} THEN g.total + o.size ELSE g.total END, g.total + o.size <= {QUOTA} FROM g JOIN o ON o.rn = g.rn + 1)
SELECT idx, size FROM g WHERE taken""",
    "owner_sizes": _F + "SELECT owner, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) / 1048576, 2) AS mb, round(sum(size) / 1073741824, 2) AS gb FROM f GROUP BY owner",
    "batch_pack": _F + f"SELECT idx, size FROM f QUALIFY coalesce(sum(size) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {QUOTA}",
    "folder_rollover": _F + "SELECT idx, 3 + (row_number() OVER (ORDER BY idx) - 1 + 95) // 100 AS folder FROM f",
    "folder_state": _F + "SELECT idx % 7 AS folder, count(*) AS n_files FROM f WHERE owner >= 'q' GROUP BY 1",
    "priority_chunks": _F + "SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 500 AS chunk FROM f",
    "running_totals": _F + "SELECT idx, size, row_number() OVER (ORDER BY idx) AS position, CAST(coalesce(sum(size) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM f",
    "trash_sibling_delete": _F + "SELECT 'hub/folder_1/' || stem || '_' || other || '_cleaned.parquet' AS path FROM f WHERE owner = 'mirror-2'",
    "delete_set": _F + f""", g AS (SELECT owner, 'hub/folder_1/' || stem || '_' || other || '_cleaned.parquet' AS path, stem || '_' || other || '_cleaned.parquet' AS name FROM f),
h AS (SELECT DISTINCT path FROM g WHERE (owner = 'mirror-2' OR {_hit(KEYWORDS[:1])}) AND owner >= 'd') SELECT path, (row_number() OVER (ORDER BY path) - 1) // 100 AS batch_no FROM h""",
    "file_states": _F + "SELECT idx, CASE WHEN idx % 4 = 3 AND owner NOT IN ('mirror-2', 'conf-south') THEN 'ready' WHEN idx % 4 < 3 AND idx % 2 > 0 THEN 'active' WHEN idx % 4 < 3 AND idx % 2 = 0 AND owner NOT IN ('mirror-2', 'conf-south') THEN 'candidate' ELSE 'idle' END AS state FROM f",
    "folder_filter": _F + "SELECT 'hub/folder_' || (idx % 7) || '/' || stem || '_' || kind || '_cleaned.parquet' AS path, size FROM f WHERE owner >= 'q' AND idx % 7 = 2 AND kind = 'submissions'",
}
