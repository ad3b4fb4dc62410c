import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from skein.functions.embed import embed, hashing_embedder, mean_pool
from skein.operators import checks, clean, manifest, similarity
from skein.session import shared_dir, stage, sweep
from skein.sources import files, sinks
from skein.streaming import ingest

from .conftest import tuples


def _record(i, **more):
    return json.dumps({"author": f"a{i}", "name": f"t3_{i}", "title": f"title {i}", "score": i, "created_utc": 1388534399 + i, **more})


def test_zst_lines(spark, tmp_path):
    body = "\n".join([_record(1), "", "{broken", "[1]", _record(2)])
    path = tmp_path / "cats_submissions.zst"
    path.write_bytes(zstandard.ZstdCompressor().compress(body.encode()))
    df = files.cleaned(spark, str(path), partitions=3)
    assert tuples(df, "name", "score", "created_utc") == [("t3_1", 1, "2014-01-01"), ("t3_2", 2, "2014-01-01")]
    assert files.file_kind("X_Comments.zst") == "comments"
    with pytest.raises(ValueError):
        files.file_kind("x.zst")


def test_parquet_sets(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/b.parquet")
    good, lacking = files.compatible_files(spark, [f"{tmp_path}/b.parquet", f"{tmp_path}/a.parquet"], ["id", "x"])
    assert [p[-9:] for p in good] == ["b.parquet"] and list(lacking.values()) == [["x"]]
    with pytest.raises(FileNotFoundError):
        files.compatible_files(spark, [f"{tmp_path}/a.parquet"], ["y"])
    (tmp_path / "b.parquet" / "part-bad.parquet").write_bytes(b"nothing")
    assert files.parquet_set(spark, f"{tmp_path}/b.parquet", "id", skip_corrupt=True).count() == 2
    found = files.probe_footers(files.manifest(spark, f"{tmp_path}/b.parquet", "*.parquet"))
    status = [r.status for r in found.collect()]
    assert status.count("corrupted") == 1 and "ok" in status
    assert files.total_bytes(files.manifest(spark, f"{tmp_path}/a.parquet", "*.parquet")).first().bytes > 0


def test_lists_and_edges(spark, tmp_path):
    (tmp_path / "words.txt").write_text("﻿Porn \n\n gore\n", encoding="utf-8")
    assert tuples(files.word_list(spark, f"{tmp_path}/words.txt")) == [("gore",), ("porn",)]
    assert files.word_list(spark, f"{tmp_path}/none.txt").isEmpty()
    (tmp_path / "e.csv").write_text("a,b,w\nx,y,0.5\n")
    assert tuples(files.edge_list(spark, f"{tmp_path}/e.csv", "a", "b", "w", "csv")) == [("x", "y", 0.5)]
    with pytest.raises(ValueError, match="zzz"):
        files.edge_list(spark, f"{tmp_path}/e.csv", "a", "zzz", "w", "csv")
    with pytest.raises(FileNotFoundError):
        files.edge_list(spark, f"{tmp_path}/none", "a", "b", "w")
    stored = spark.createDataFrame([("h/folder_1/Ab_cleaned.parquet",), ("h/other/c.parquet",), ("h/folder_2/d.txt",)], "path string")
    assert tuples(files.stored_names(stored)) == [("ab",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, g string")
    assert sinks.cleaned_name("x_submissions.zst") == "x_submissions_cleaned.parquet"
    assert not sinks.write_parquet(df.limit(0), f"{tmp_path}/none") and not (tmp_path / "none").exists()
    assert sinks.write_parquet(df, f"{tmp_path}/p", partition_by=["g"])
    assert tuples(spark.read.parquet(f"{tmp_path}/p"), "i", "g") == [(1, "a"), (2, "b")]
    sinks.write_single(df, f"{tmp_path}/c", "csv")
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    for _ in range(2):
        sinks.append_lines(df, "g", f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 4
    assert [r.i for r in sinks.preview(df, F.desc("i"), n=1).collect()] == [2]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n in range(3):
        (source / f"c{n}_submissions").write_text("\n".join(_record(n * 10 + i) for i in range(4)))
    (source / "c_comments").write_text('{"author":"x"}')
    run = lambda: ingest.run_available(ingest.dump_stream(spark, str(source), "submissions", max_files=1), str(tmp_path / "cp"), ingest.parquet_sink(out))
    run()
    assert spark.read.parquet(out).count() == 12
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    (source / "c9_submissions").write_text(_record(99))
    run()
    assert spark.read.parquet(out).count() == 13


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in ingest.windowed_counts(df, "ts", "k").collect()) == [1, 2]


def test_embedding(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(embed(F.col("t"), lambda: hashing_embedder(8), batch=1).alias("v"))
    v = [r.v for r in df.collect()]
    assert len(v[0]) == 8 and v[1] is None and v[2] == [0.0] * 8
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>").select(mean_pool(F.col("v"), F.col("m"))).first()[0]
    assert pooled == [2.0, 3.0]


def test_checks(spark):
    df = spark.createDataFrame([("t", "n", 1), (None, "n", 0), ("t", None, None)], "title_for_embedding string, name string, rank_in_subreddit int")
    assert tuples(checks.embedding_input(df)) == [("name", 1), ("rank", 2), ("text", 1)]
    edges = spark.createDataFrame([("a", "b", 1.0)], "source string, target string, weight double")
    assert {r.n_violations for r in checks.graph_sizes(edges, 1, 2).collect()} == {0}


def test_stage_and_sweep(spark):
    df = stage(spark.range(5))
    assert df.count() == 5 and shared_dir(spark)
    assert sweep(spark) >= 1 and sweep(spark) == 0


def test_stream_until_stopped(spark, tmp_path):
    """A stream that is told to stop takes what is there first; a later run goes on."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a_submissions").write_text(_record(1))
    sink = ingest.parquet_sink(out)
    stream = lambda: ingest.dump_stream(spark, str(source), "submissions")
    asked = []
    ingest.run_until(stream(), str(tmp_path / "cp"), sink, lambda: bool(asked.append(1)) or len(asked) > 1)
    (source / "b_submissions").write_text(_record(2))
    ingest.run_until(stream(), str(tmp_path / "cp"), sink, lambda: True)
    assert tuples(spark.read.parquet(out), "name") == [("t3_1",), ("t3_2",)]


def test_funnel_and_files(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (5, "c")], "x int, y string")
    steps = {"there": F.col("y").isNotNull(), "small": F.col("x") < 3}
    assert tuples(clean.funnel(df, steps)) == [(1, "there", 4, 3, 1), (2, "small", 3, 1, 2)]
    assert tuples(clean.funnel(df.limit(0), steps)) == [(1, "there", 0, 0, 0), (2, "small", 0, 0, 0)]
    asked = spark.createDataFrame([(" Cats",), ("cats",), ("dogs",), (None,)], "s string")
    mapped = manifest.map_files(asked, "s", spark.createDataFrame([("cats", "p/cats")], "n string, path string"), "n")
    assert tuples(mapped) == [("cats", 2, "p/cats"), ("dogs", 1, None)] and tuples(manifest.map_misses(mapped)) == [(2, 1, 1)]
    assert spark.range(1).select(manifest.in_units(F.lit(3 << 19), "MB")).first()[0] == 1.5


def test_percentile_edges(spark):
    rng = np.random.default_rng(7)
    v = [rng.normal(size=6) for _ in range(60)]
    v[3] = v[4]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "k bigint, v array<double>")
    s = {(i, j): float(v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j])) for i in range(60) for j in range(i + 1, 60)}
    for q in (0.0, 0.5, 0.97, 1.0):
        least = np.percentile(list(s.values()), 100 * q)
        got = {(r.source, r.target) for r in similarity.pairs_above_percentile(df, "k", "v", q, block=16).collect()}
        assert got >= {p for p, x in s.items() if x > least + 1e-9} and got <= {p for p, x in s.items() if x >= least - 1e-9}
    assert similarity.pairs_above_percentile(df.limit(0), "k", "v").isEmpty()
    assert similarity.pairs_above_percentile(df.where("k < 2"), "k", "v").count() == 1
