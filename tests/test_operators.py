import math
import random
import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from skein.functions import cleaning as c
from skein.functions import keys as k
from skein.functions import text as t
from skein.operators import clean, drift, graph, manifest, migration, rank, references, similarity
from skein.operators.selection import key_quantiles
from skein.operators.sequence import running
from skein.operators.skew import hot_keys, skew_join
from skein.plans import catalog, community
from skein.plans import similarity as plans

from .conftest import tuples


def test_keys(spark):
    df = spark.createDataFrame([(" Ab ",), ("[Deleted]",), ("",), (None,), ("　T3_X ",), ("x1",), ("NaN ",), ("t1_q",)], "v string")
    rows = df.select(k.author_key("v"), k.post_key("v"), k.reference_key("v")).collect()
    assert [r[0] for r in rows] == ["ab", None, None, None, "t3_x", "x1", "nan", "t1_q"]
    assert [r[1] for r in rows][4:] == ["t3_x", "t3_x1", "t3_nan", "t1_q"]
    assert [r[2] for r in rows] == ["t3_ab", "t3_[deleted]", None, None, "t3_x", "t3_x1", None, "t1_q"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, how):
    left = [("hot", i) for i in range(200)] + [(f"k{i % 30}", i) for i in range(100)] + [(None, 1), (None, 2)]
    right = [("hot", "h"), *((f"k{i}", str(i)) for i in range(0, 40, 2))]
    a, b = spark.createDataFrame(left, "k string, v int"), spark.createDataFrame(right, "k string, w string")
    assert hot_keys(a, ["k"], 0.1, 10) == [("hot",)]
    for most_bytes in (1 << 20, 0):
        assert tuples(skew_join(a, b, ["k"], how, 0.1, 10, most_bytes)) == tuples(a.join(b, ["k"], how))


def _brute(refs, parents, match):
    out = []
    for r in refs:
        known = [(i, v) for i, v in enumerate(r) if v is not None]
        met = any(all(p[i] == v for i, v in known) for p in parents)
        mask = sum(1 << i for i, v in enumerate(r) if v is None)
        full = (1 << len(r)) - 1
        if match == "simple":
            bad = mask == 0 and not met
        elif match == "partial":
            bad = mask != full and not met
        else:
            bad = mask not in (0, full) or (mask == 0 and not met)
        if bad:
            out.append((*r, mask))
    return sorted(out, key=repr)


@pytest.mark.parametrize("match", references.MATCH)
def test_orphans_by_null_mask(spark, match):
    rng = random.Random(match)
    value = lambda: rng.choice([None, "a", "b", "c", "d"])
    refs = [(value(), value(), value()) for _ in range(80)]
    parents = [(value(), value(), value()) for _ in range(25)]
    r = spark.createDataFrame(refs, "a string, b string, c string").withColumn("null_mask", F.lit("x"))
    p = spark.createDataFrame(parents, "x string, y string, z string")
    found = references.orphans(r, p, {"a": "x", "b": "y", "c": "z"}, match)
    assert tuples(found, "a", "b", "c", "null_mask") == _brute(refs, parents, match)
    assert references.orphans(r.limit(0), p, {"a": "x"}, match).isEmpty()


def test_orphans_rejects_unknown_match(spark):
    with pytest.raises(ValueError):
        references.orphans(spark.range(1), spark.range(1), {"id": "id"}, "loose")


def test_reference_states(spark):
    refs = spark.createDataFrame([("r1", "a", 5, "o"), ("r2", "b", 5, "o"), ("r3", "c", 5, "o"), ("r4", "d", 5, "o"), ("r5", "e", None, "o"), ("r6", None, 5, "o")], "name string, ref_key string, first_at int, ref_state string")
    parents = spark.createDataFrame([("a", 4), ("b", 6), ("e", 9), ("f", None)], "ref_key string, first_at int")
    removed = spark.createDataFrame([("c",), ("c",), ("b",), (None,)], "ref_key string")
    assert tuples(references.reference_cases(refs, parents, removed), "name", "ref_state") == [("r2", "late"), ("r3", "deleted"), ("r4", "missing")]


def _rank(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(kind)
    rows = [("one", rng.randrange(-5, 5)) for _ in range(60)] + [("wide", rng.randrange(-(2**63), 2**63)) for _ in range(200)]
    rows += [("close", 2**60 + rng.randrange(40)) for _ in range(90)] + [("same", 7)] * 30 + [("none", None)] * 3 + [(None, 1)]
    if kind == "double":
        rows = [(key, None if v is None else float(v)) for key, v in rows]
        rows += [("odd", x) for x in (float("inf"), -float("inf"), float("nan"), 5e-324, 0.0, 1.7e308, -1.7e308, 1.5)]
    df = spark.createDataFrame(rows, f"n_values string, v {kind}")
    got = {r[0]: r for r in key_quantiles(df, ["n_values"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}, buckets=4).toDF("key", "n", "m", "a", "b", "c").collect()}
    assert set(got) == {key for key, _ in rows if key}
    for key, r in got.items():
        values = [v for x, v in rows if x == key and v is not None and v == v]
        assert (r["n"], r["m"]) == (sum(x == key for x, _ in rows), len(values))
        assert [r["a"], r["b"], r["c"]] == ([_rank(values, p) for p in (0.1, 0.5, 1.0)] if values else [None] * 3)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert key_quantiles(df, ["k"], "v", {"m": 0.5}).columns == ["k", "n_rows", "n_values", "m"]
    assert key_quantiles(df, ["k"], "v", {"m": 0.5}).isEmpty()


def _drift(spark, lines):
    raw = spark.createDataFrame(lines, "series string, file_no int, payload string")
    fields = drift.catalogue(drift.records(raw))
    return raw, fields, drift.changes(drift.lifespans(fields))


def test_drift_changes(spark):
    one = '{"name":"t3_%d","created_utc":15900000%02d,"upvote_ratio":0.5%d,"crosspost_parent":null,"stray":1}'
    two = '{"name":"t3_%d","created":"15900000%02d","upvote_ratio":"5%d%%","crosspost_parent":null,"gallery":[]}'
    three = '{"name":"t3_%d","created":15900000%02d,"Upvote_Ratio":0.%d1,"xpost_parent":{"id":"t3_abc"},"gallery":["a","b"]}'
    lines = [("s", 1, one % (i, i, i)) for i in range(9)] + [("s", 3, two % (i, i, i)) for i in range(9)] + [("s", 4, three % (i, i, i)) for i in range(9)]
    lines += [("s", 1, x) for x in ("", None, "[1]", '"x"', "null", '{"broken":', "{'a':1}")] + [("s", 2, "oops"), (None, 1, "{}"), ("t", 1, '{"a":1}')]
    lines += [("s", 3, '{"rare":1}')]
    _, _, changes = _drift(spark, lines)
    assert tuples(changes) == sorted([
        ("s", 3, "renamed", "created_utc", "created"), ("s", 3, "retyped", "created_utc", "created"), ("s", 3, "retyped", "upvote_ratio", "upvote_ratio"), ("s", 3, "removed", "stray", ""),
        ("s", 3, "added", "", "gallery"), ("s", 4, "retyped", "created", "created"), ("s", 4, "renamed", "upvote_ratio", "Upvote_Ratio"), ("s", 4, "retyped", "upvote_ratio", "Upvote_Ratio"),
        ("s", 4, "renamed", "crosspost_parent", "xpost_parent"),
    ], key=repr)


def test_drift_unknown_names_by_content(spark):
    lines = [("s", 1, f'{{"place":"t5_a{i}","n":{i}}}') for i in range(5)] + [("s", 2, f'{{"zone":"t5_b{i}","flag":true}}') for i in range(5)]
    _, _, changes = _drift(spark, lines)
    assert tuples(changes, "change_kind", "old_field", "new_field") == [("added", "", "flag"), ("removed", "n", ""), ("renamed", "place", "zone")]


def test_drift_table(spark):
    lines = [("s", 1, '{"name":"t3_1","created_utc":1590000000,"upvote_ratio":"73%","score":"12"}'), ("s", 2, '{"name":"t3_2","createdUtc":"2020-05-20T01:00:00Z","ratio":0.5,"xpost_parent":["t3_9"],"score":3.9,"it\'s":1}')]
    raw, fields, changes = _drift(spark, lines)
    table = drift.unified(drift.records(raw), fields, changes)
    assert tuples(table, "name", "created_utc", "upvote_ratio", "crosspost_parent", "score") == [("t3_1", "2020-05-20", 0.73, None, 12), ("t3_2", "2020-05-20", 0.5, "t3_9", 3)]
    _, none, no_changes = _drift(spark, [("s", 1, "x")])
    assert no_changes.isEmpty() and none.isEmpty()


def test_drift_table_keeps_added_fields(spark):
    """Fields outside the alias table that belong to a file are in the table, strays are not."""
    lines = [("s", 1, '{"name":"t3_1","seen_at":"2020-05-20","Kind":"a"}')]
    lines += [("s", 2, f'{{"name":"t3_{i}","is_video":{v},"noted_time":"2020-05-21","kind":"b","it\'s \\"x":[1,2]{stray}}}') for i, v, stray in ((2, "true", ""), (3, "null", ""), (4, "false", ""), (5, "true", ""), (6, "true", ""), (7, "true", ',"stray":1'))]
    lines += [("t", 1, '{"name":"t3_8","up":1,"Up":2}')]
    raw, fields, changes = _drift(spark, lines)
    assert ("s", 2, "renamed", "seen_at", "noted_time") in tuples(changes)
    got = {r["name"]: r.other_fields for r in drift.unified(drift.records(raw), fields, changes).collect()}
    both = {"noted_time": "2020-05-21", "kind": "b", "it's \"x": "[1,2]"}
    assert got["t3_1"] == {"noted_time": "2020-05-20", "kind": "a"} and got["t3_8"] == {"up": "1", "Up": "2"}
    assert got["t3_2"] == got["t3_7"] == both | {"is_video": "true"} and got["t3_3"] == both and got["t3_4"] == both | {"is_video": "false"}
    raw, fields, changes = _drift(spark, [("s", 1, '{"name":"t3_1"}')])
    assert [r.other_fields for r in drift.unified(drift.records(raw), fields, changes).collect()] == [{}]


def _records(spark, *lines):
    return clean.parse_objects(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_clean_submissions(spark):
    base = '"author":"a","name":"t3_1","title":""'
    got = clean.clean_submissions(_records(spark, f'{{{base},"selftext":null}}')).first()
    assert (got.selftext, got.score, got.upvote_ratio, got.created_utc, got.crosspost_parent) == ("None", 0, 1.0, None, "None")
    dropped = ['{"author":"[deleted]","name":"x","title":"t"}', '{"name":"x","title":"t"}', '{"author":"a","title":"t"}', '{"author":"a","name":"x","title":5}', '{"author":"a","name":"x","title":"�"}', '{"author":"a","name":"x","title":"t","selftext":"[removed]"}', "", "[1]", "{bad"]
    assert clean.clean_submissions(_records(spark, *dropped)).isEmpty()
    assert clean.clean_submissions(_records(spark, '{"author":"deleted","name":"x","title":"t"}')).count() == 1
    odd = clean.clean_submissions(_records(spark, f'{{{base},"score":3.7,"num_comments":"3.7","num_crossposts":true,"created_utc":"1388534399","upvote_ratio":"0.5","subreddit_subscribers":" 12 "}}')).first()
    assert (odd.score, odd.num_comments, odd.num_crossposts, odd.created_utc, odd.upvote_ratio, odd.subreddit_subscribers) == (3, 0, 1, "2013-12-31", 0.5, 12)


def test_clean_comments(spark):
    row = '{"author":"a","body":"","name":"t1_1","link_id":%s,"parent_id":%s}'
    got = clean.clean_comments(_records(spark, row % ('"t3_9"', "5"), row % ("9", '"t1_2"'), row % ('"t3_9"', "null")))
    assert tuples(got, "link_id", "parent_id") == [("9", "t1_2"), ("t3_9", "t3_9")]


def test_filters(spark):
    df = spark.createDataFrame([("Abbott", "c"), ("robotics", "c"), (None, "c"), ("ann", None), ("ann", "c"), ("AutoModerator", "c")], "author string, subreddit string")
    assert tuples(clean.without_bots(df)) == [("ann", "c")]
    dates = spark.createDataFrame([("2024-02-30",), ("2024-2-3",), ("2024-02-29",), (None,)], "d string").select(c.strict_date(F.col("d")))
    assert [r[0] for r in dates.collect()] == [False, False, True, False]
    blanks = spark.createDataFrame([("  x\t",), (" NaN ",), (None,)], "d string").select(c.missing_to_null(F.col("d")))
    assert [r[0] for r in blanks.collect()] == ["x", None, None]


def test_titles(spark):
    texts = ["a" * 250, "b" * 100 + " " + "c" * 200, "b" * 101 + " " + "c" * 200, "d" * 200]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(t.soft_truncate(F.col("t"))).collect()]
    assert got == ["a" * 200, "b" * 100 + " " + "c" * 99, "b" * 101, "d" * 200]
    df = spark.createDataFrame([("it's", 3), ("a—b", 3), ("日本語 テスト", 2), ("", 0)], "t string, n int")
    assert df.where(t.token_count(F.col("t")) != F.col("n")).isEmpty()
    df = spark.createDataFrame([("ﬁ\ta​  b ", "fi a b"), (None, None)], "t string, n string")
    assert df.where(~t.normalize_title(F.col("t")).eqNullSafe(F.col("n"))).isEmpty()
    shown = {"x🚲y": "x bicycle y", "🇫🇷!": " flag_fr !", "👩🏽\u200d🔧": " woman_emoji_modifier_fitzpatrick_type_4_wrench ", "☕\ufe0f": " hot_beverage ", "漢字é": "漢字é"}
    df = spark.createDataFrame([(x,) for x in shown], "t string")
    assert [r[0] for r in df.select(t.demojize("t")).collect()] == list(shown.values())


def test_rank(spark):
    rows = [(g, random.Random(g + str(i)).randrange(5), i) for g in "abc" for i in range(20)]
    df = spark.createDataFrame(rows, "g string, s int, i int")
    top = rank.top_k(df, "g", [F.desc("s"), F.asc("i")], 4, "r")
    assert tuples(top) == sorted([(*x, n + 1) for g in "abc" for n, x in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:4])], key=repr)
    assert rank.rank_violations(top, "g", "r", 4).isEmpty()
    assert rank.rank_violations(top, "g", "r", 3).count() == 3
    found = rank.recover_key(spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string"), spark.createDataFrame([(1, None, "k2"), (1, None, "k1"), (2, "x", "k3")], "a int, b string, k string"), ["a", "b"], "k")
    assert tuples(found) == [(1, None, "k1"), (2, "x", "k3"), (3, "y", None)]


def test_running_over_partitions(spark):
    rows = [(i, (i * 7919) % 101) for i in range(500)]
    got = tuples(running(spark.createDataFrame(rows, "i int, v bigint").repartition(7), [F.asc("i")], "v"), "i", "position", "before")
    assert sorted(got) == [(i, i + 1, sum(v for _, v in rows[:i])) for i, _ in rows]


def test_quotas_and_batches(spark):
    files = spark.createDataFrame([(i, s) for i, s in enumerate([5, 4, 3, 2])], "idx int, size bigint")
    assert tuples(manifest.pick_small_first(files, 8, "idx"), "size") == [(2,), (3,)]
    assert tuples(manifest.pick_large_first(files, 8, "idx"), "size") == [(3,), (5,)]
    assert manifest.pick_large_first(files, 1, "idx").isEmpty()
    batch = spark.createDataFrame([(i, s) for i, s in enumerate([4, 5, 3, 9])], "idx int, size bigint")
    assert tuples(manifest.next_batch(batch, 10, "idx"), "size") == [(3,), (4,), (5,)]
    assert tuples(manifest.folders(batch.limit(2), "idx", 1, 8999), "folder") == [(1,), (2,)]


def test_large_first_is_greedy(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 400) for _ in range(120)]
    left, want = 3000, []
    for s, i in sorted(((s, i) for i, s in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
        if s <= left:
            want.append((i, s))
            left -= s
    got = manifest.pick_large_first(spark.createDataFrame(list(enumerate(sizes)), "idx int, size bigint"), 3000, "idx")
    assert sorted(tuples(got, "idx", "size")) == sorted(want)


def test_large_first_over_the_catalogue(spark, sf):
    files = [(r.idx, r.size) for r in catalog._files(spark, sf).collect()]
    left, want = catalog.QUOTA, []
    for i, s in sorted(files, key=lambda x: (-x[1], x[0])):
        if s <= left:
            want.append((i, s))
            left -= s
    assert sorted(tuples(catalog.QUERIES["quota_large_first"](spark, sf), "idx", "size")) == sorted(want) and want


def test_triage(spark):
    names = ["AskPorn_x_comments.zst", "ask_porn_submissions.zst", "askporn_submissions.zst", "Bad_comments.zst", "Old_comments.zst", "T_comments.zst"]
    files = spark.createDataFrame([(f"d/{n}", 1 << 21) for n in names] + [("d/Bad_submissions.zst", 9)], "path string, size bigint")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "name string")
    got = manifest.triage(files, one("T_comments.zst"), one("BAD"), one("OLD_comments"), ["porn"])
    assert {r.path[2:]: r.reason for r in got.collect()} == dict(zip([*names, "Bad_submissions.zst"], ["sensitive", "sensitive", "keep", "banned", "present", "trash", "too_small"], strict=True))
    stored = spark.createDataFrame([("h/X_submissions_cleaned.parquet",), ("h/funnyX_submissions_cleaned.parquet",)], "path string")
    assert tuples(manifest.siblings_of_trash(stored, one("X_comments.zst"))) == [("h/X_submissions_cleaned.parquet",)]


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_graph(spark):
    e = spark.createDataFrame([("A", "B", 1), ("B", "C", 1), ("D", "E", 1)], "source string, target string, weight bigint")
    s = graph.summary(e).first()
    assert (s.nodes, s.edges, round(s.density, 6), s.components, s.largest) == (5, 3, 0.3, 2, 3)
    assert graph.summary(e.limit(0)).first()[:5] == (0, 0, 0.0, 0, 0)
    rng = random.Random(2)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(tuples(graph.components(spark.createDataFrame(edges, "source int, target int"))))
    assert got == _components(edges)
    assert tuples(graph.canonical(spark.createDataFrame([("B", "A", 0.9), ("A", "B", 0.8), ("A", "A", 1.0), ("A", None, 1.0)], "source string, target string, weight double"))) == [("A", "B", 0.9)]


def test_co_membership(spark):
    rows = [("u", x) for x in "ABC"] + [(f"v{i}", x) for i in range(4) for x in "AB"] + [("many", f"c{i}") for i in range(50)] + [("few", f"c{i}") for i in range(49)]
    df = spark.createDataFrame(rows * 2, "u string, c string")
    assert tuples(graph.co_membership(df, "u", "c", min_weight=5)) == [("A", "B", 5)]
    assert graph.co_membership(df, "u", "c", min_weight=1).where("source like 'c%'").count() == 49 * 48 // 2
    refs = spark.createDataFrame([("p", None, "S"), ("p", None, "S"), ("q", "p", "T"), ("r", "p", "S"), ("s", "None", "S")], "name string, parent string, sub string")
    assert tuples(graph.cross_reference(refs, "name", "parent", "sub")) == [("S", "S", 2), ("S", "T", 2)]


def test_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 8))
    m[3] = 0
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(m)], "k int, g int, v array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    want = {(i, j): u[i] @ u[j] for i in range(40) for j in range(i + 1, 40)}
    pairs = similarity.cosine_pairs(df, "k", "v", block=16)
    got = {(a, b): s for a, b, s in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    some = {(a, b) for a, b, _ in similarity.cosine_pairs(df, "k", "v", above=0.4, block=7).collect()}
    assert some == {p for p, s in want.items() if s > 0.4}
    assert abs(similarity.percentile(pairs, "similarity", 0.97) - np.percentile(list(want.values()), 97)) < 1e-12
    assert similarity.percentile(spark.createDataFrame([(x,) for x in (1, 2, 4, 10)], "x bigint"), "x", 0.97) == pytest.approx(9.46)
    c = {g: v for g, _, v in similarity.centroids(df, "g", "v").collect()}
    assert all(np.allclose(c[g], m[g::3].mean(0)) for g in range(3))
    near = [r.neighbour for r in similarity.nearest(df, "k", "v", 5, 4).collect()]
    assert near == sorted((i for i in range(40) if i != 5), key=lambda i: -(u[i] @ u[5]))[:4]


@pytest.mark.parametrize("block", [7, 1024])
def test_nearest_of_each_query(spark, block):
    rng = random.Random(12)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(6)] for i in range(50)} | {50: [0.0] * 6}
    vectors |= {60 + i: vectors[3] for i in range(4)}
    df = spark.createDataFrame([*vectors.items(), (70, None), (None, [1.0] * 6)], "k int, v array<double>")
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(unit(vectors[a]), unit(vectors[b]), strict=True)), 9)
    want = [(q, n, p + 1) for q in range(0, 71, 5) if q in vectors for p, n in enumerate(sorted((i for i in vectors if i != q), key=lambda i: (-cosine(q, i), i))[:4])]
    got = similarity.nearest_each(df, "k", "v", F.col("k") % 5 == 0, 4, block)
    assert sorted(tuples(got, "query", "neighbour", "position")) == sorted(want)
    assert similarity.nearest_each(df, "k", "v", F.lit(False), 4).isEmpty()


def test_knn_of_every_hundredth(spark, sf):
    """Every vector whose id is divisible by 100 has its ten."""
    got = tuples(plans.QUERIES["knn_top10"](spark, sf), "query", "position")
    asked = [r[0] for r in plans._vectors(spark, sf).where("vec_id % 100 = 0").select("vec_id").collect()]
    assert got == sorted(((q, p) for q in asked for p in range(1, 11)), key=repr) and asked


def _prepare(title):
    """The preparation in plain Python: title, tokens, cut by characters, cut by tokens; None where it is left out."""
    seen = "".join(" " if ch in "\t\n\r" else ch for ch in unicodedata.normalize("NFKC", title) if ch in "\t\n\r" or not unicodedata.category(ch).startswith("C"))
    seen = re.sub(r"\s+", " ", seen).strip()
    if seen.lower() in ("", "none", "null", "nan", "[deleted]") or len(seen) < 15:
        return None
    cut = seen
    if len(seen) > 200:
        cut = seen[:200].rstrip()
        last = cut.rfind(" ")
        cut = cut if last <= 100 else cut[:last].rstrip()
    word = r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d"  # what the reference's tokenizer takes for one, marks included
    n = len(regex.findall(rf"[{word}]+|[^{word}\s]+", cut))
    return cut, n, len(seen) > 200, n > 64


def test_title_preparation_is_whole(spark, tmp_path):
    """Composition comes first, so that length, cut and token count follow from the composed title."""
    titles = ["Ｆｕｌｌ ｗｉｄｔｈ ｔｉｔｌｅ ｈｅｒｅ", "ﬃﬃﬃﬃﬃ", "Ａ short one", "e\u0301" * 10, "ｱｲｳ ㎏ ½ and … the rest", "wait… " * 33, "x" * 99 + " " + "ﬁ" * 60, "x" * 101 + " " + "ﬁ" * 60, "a. " * 50, "ａ． " * 50, "a\tb\u200b  c\u3000d and so on ok", "looking \ufe0efor thre\ufe0fad ☕️ today", "none", "[ｄｅｌｅｔｅｄ]", "an ordinary title of a post"]
    rows = [(f"t3_{i}", x) for i, x in enumerate(titles)]
    spark.createDataFrame([*rows, rows[0], ("t3_null", None)], "name string, title string").write.parquet(f"{tmp_path}/submissions.parquet")
    want = {n: _prepare(x) for n, x in rows}
    got = {r["name"]: tuple(r)[1:] for r in community.QUERIES["title_prepare"](spark, str(tmp_path)).collect()}
    assert got == {n: w for n, w in want.items() if w} and want["t3_1"] and not want["t3_3"]


def test_migration(spark):
    rows = [("u", "A", "pre"), ("u", "A", "pre"), ("u", "B", "pre"), ("u", "B", "post"), ("v", "A", "pre"), ("v", "A", "post"), ("w", "C", None)]
    df = spark.createDataFrame(rows, "e string, c string, p string")
    assert tuples(migration.transitions(df, "e", "c", "p")) == [("A", "A", 1, 0.5), ("A", "B", 1, 0.5)]
    assert tuples(migration.overlap(df, "e", "c", "p"), "c", "n_pre", "n_post", "n_both") == [("A", 2, 1, 1), ("B", 1, 1, 1)]
