import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import cooccurrence
from skein.llm.confusables import lookalike_pairs, skeleton, skeletons
from skein.llm.cooccurrence import associations, pair_weights
from skein.llm.encoding import RANKS, _encoder, _splitter, decode, encode, stitched
from skein.llm.leakage import SPAN, passages, seeds, sieve, sifted
from skein.llm.markup import running_text, sentences
from skein.llm.overlap import common, overlaps
from skein.llm.subjects import _IDS, ORDERS, _terms, _through, propagate, similar, subjects
from skein.llm.topn import best_rows, top_n

from skein.operators.skew import hot_keys, skew_join

from ..conftest import tuples


def test_top_n_across_partitions(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(8), rng.choice([None, 1, 2]), f"i{i:04}") for i in range(3000)] + [(f"g{i % 40}", rng.randrange(3), None, f"j{i}") for i in range(130)] + [(None, 9, 9, "n")]
    df = spark.createDataFrame(rows, "g string, s int, c int, i string").withColumn("rank", F.lit("old"))
    order = [F.desc("s"), F.desc_nulls_last("c"), F.asc("i")]
    key = lambda r: (-r[1], r[2] is None, -(r[2] or 0), r[3])
    want = [(*r, n + 1) for g in {r[0] for r in rows if r[0]} for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=key)[:10])]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tuples(top_n(df, "g", order, 10), "g", "s", "c", "i", "rank") == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tuples(top_n(df, "g", order, 10), "g", "s", "c", "i", "rank") == sorted(want, key=repr)
    assert top_n(df.limit(0), "g", order, 10).isEmpty()


def test_best_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 0), ("a", 0, 9), ("b", 2, None)], "k string, s int, c int")
    assert tuples(best_rows(df, ["k"], ["s", "c"])) == [("a", 1, 0), ("b", 2, None)]


def _baskets():
    rng = random.Random(3)
    rows = [(f"b{i}", f"x{rng.randrange(12)}") for i in range(60) for _ in range(rng.randrange(6))] + [("huge", f"x{i}") for i in range(90)]
    return rows + rows[:20] + [(None, "x1"), ("b1", None)]


def _weights(rows, below=None):
    by = {}
    for b, x in rows:
        if b is not None and x is not None:
            by.setdefault(b, set()).add(x)
    by = {b: s for b, s in by.items() if below is None or len(s) < below}
    w = {}
    for s in by.values():
        for p in combinations(sorted(s), 2):
            w[p] = w.get(p, 0) + 1
    return by, w


@pytest.mark.parametrize("block", [4, 7, 64, 1000])
def test_pair_weights_in_blocks(spark, block):
    by, want = _weights(_baskets())
    members = spark.createDataFrame([(b, x, len(s)) for b, s in by.items() for x in s], "basket string, item string, size bigint")
    assert {(a, b): n for a, b, n in pair_weights(members, block).collect()} == want


def test_associations(spark):
    by, w = _weights(_baskets(), below=50)
    n, count = len(by), {}
    for s in by.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    want = {(a, b, v) for (a, b), v in w.items() if v >= 3 and v * n >= 1.2 * count[a] * count[b]}
    df = spark.createDataFrame(_baskets(), "basket string, item string").withColumn("size", F.lit("x"))
    got = associations(df, "basket", "item", 3, 1.2, below=50, block=4)
    assert {(r.source, r.target, r.weight) for r in got.collect()} == want and want
    assert associations(df.limit(0), "basket", "item", 3, 1.2).isEmpty()


def test_subreddit_pairs_meet_in_blocks(spark, tmp_path, monkeypatch):
    """Authors below the limit of 50 subreddits are large enough to be cut, with the same pairs."""
    rows = [(f"a{i}", f"s{j:02}") for i in range(12) for j in range(40)] + [(f"b{i}", f"t{i % 30}") for i in range(300)]
    spark.createDataFrame(rows, "author string, subreddit string").write.parquet(f"{tmp_path}/submissions.parquet")
    cut, blocks = [], cooccurrence._blocks
    monkeypatch.setattr(cooccurrence, "_blocks", lambda m, n: cut.append(blocks(m, n).agg(F.max("n_blocks")).first()[0]) or blocks(m, n))
    got = tuples(cooccurrence.p3_edges(spark, str(tmp_path)), "source", "target", "weight")
    assert cut == [5]
    assert got == [(f"s{i:02}", f"s{j:02}", 12) for i, j in combinations(range(40), 2)]


def test_block_pairs_of_the_real_table(spark, sf, monkeypatch):
    met, pairs = [], cooccurrence._block_pairs
    monkeypatch.setattr(cooccurrence, "_block_pairs", lambda b: met.append(pairs(b).count()) or pairs(b))
    cooccurrence.p3_edges(spark, sf.replace("sf0.001", "sf0.01")).collect()
    assert met[0] > 100


def test_skeletons(spark):
    same = [("Ｆｕｌｌ ｗｉｄｔｈ", "Full width"), ("ﬁne​", "fine"), ("über", "über"), (" a  b ", "a b"), ("Ме", "Me"), ("ј­o", "jo"), ("𝐀𝐁", "AB"), ("non‑stop", "non-stop"), ("☕️", "☕"), ("wait…", "wait..."), ("͏x", "x")]
    assert all(skeleton(a) == skeleton(b) for a, b in same)
    other = [("é", "e"), ("A", "a"), ("ø", "o"), ("I", "l"), ("1", "l"), ("0", "O"), ("m", "rn"), ("x²", "x2"), ("a b", "ab"), ("ſ", "s")]
    assert all(skeleton(a) != skeleton(b) for a, b in other)
    ascii_ = [chr(i) for i in range(33, 127)]
    assert len({skeleton(x) for x in ascii_}) == len(ascii_)
    odd = [skeleton(x) for x in ("", "  ", "​", "x" * 100_000, "́" * 1000)]
    assert odd[:3] == ["", "", ""]
    assert all(skeleton(skeleton(x)) == skeleton(x) for x in ("ﬁ ё", "a\tb", "Ｘ̣́"))
    df = spark.createDataFrame([("ﬁ",), (None,)], "t string").select(skeletons("t"))
    assert [r[0] for r in df.collect()] == ["fi", None]


@pytest.mark.parametrize("block", [2, 256])
def test_lookalike_pairs(spark, block):
    rows = [("t", f"n{i}", "same") for i in range(9)] + [("t", f"m{i}", "sаme") for i in range(5)] + [("t", "m0", "same"), ("t", "k", "ｓａｍｅ"), ("u", "z1", "same"), ("u", "z2", "same"), ("t", None, "sаme"), ("t", "q", None), (None, "q", "same")]
    want = set()
    for a, b in combinations([r for r in rows if None not in r], 2):
        if a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and skeleton(a[2]) == skeleton(b[2]):
            want.add((a[0], *sorted((a[1], b[1]))))
    df = spark.createDataFrame(rows * 2, "string string, look string, names string")
    got = tuples(lookalike_pairs(df, "string", "look", "names", block))
    assert got == sorted(want, key=repr)
    assert lookalike_pairs(df.limit(0), "string", "look", "names").isEmpty()


def _texts():
    rng = random.Random(3)
    parts = ["a" * 900, " " * 700 + "x", "\n\n   \n" * 50, "it's we're they'll 'r e", "12345" * 100, "!!??" * 200, "é漢字 " * 300, "<|endoftext|>", "\n\n\\section{x}", "word and\r\n\r\nword ", "\x1c\x85　y"]
    return [(i, "".join(rng.choice(parts)[: rng.randrange(1, 900)] for _ in range(rng.randrange(1, 14)))) for i in range(120)] + [(1000, None), (1001, ""), (1002, " " * 5000), (1003, "b" * 5000)]


@pytest.mark.parametrize("chunk,overlap,spread,reach", [(20, 8, 200, 20), (100, 30, 500, 100), (1 << 10, 1 << 7, 1 << 16, 1 << 11)])
def test_chunked_encoding_is_exact(spark, chunk, overlap, spread, reach):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("k", F.lit(2))
    coded = encode(df, "doc_id", "text", chunk=chunk, overlap=overlap, spread=spread, reach=reach).cache()
    whole = _encoder(RANKS).encode_ordinary
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: whole(x or "") for i, x in rows}
    assert {r.doc_id: r.text for r in decode(coded, "doc_id").collect()} == {i: x or "" for i, x in rows}
    assert encode(df.limit(0), "doc_id", "text").isEmpty()


@pytest.mark.parametrize("chunk,overlap", [(7, 6), (16, 8), (50, 12), (200, 40), (1 << 10, 1 << 7)])
def test_chunks_meet(chunk, overlap):
    """Stitched pre-tokens are those of the whole text, whatever the chunks, one pre-token of a megabyte included."""
    for text in [x or "" for _, x in _texts()] + ["x" * 300 + " y" * 40, "a'rea 're" * 30]:
        assert [t for piece in stitched(text, chunk, overlap) for t in piece] == _splitter().findall(text)


def test_long_texts_are_cut(spark):
    """Texts beyond the limit go through spread chunks, a pre-token of a megabyte too; their ids are those of the whole text."""
    rng = random.Random(13)
    words = ["it's", "\\section{x}\n\n", "word ", "  and", "12345", "é漢字 ", "\r\n"]
    rows = [(i, "".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((90_000, 20_000, 20))] + [(3, None), (4, "-" * 1_000_000)]
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == {i: _encoder(RANKS).encode_ordinary(x or "") for i, x in rows}


def test_most_articles_have_several_chunks(spark, sf):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert sum(len(list(stitched(x))) > 1 for x in texts) > len(texts) / 2


def _words(text):
    return re.findall(r"[^\W_]+", re.sub(r"\\[A-Za-z]+", " ", (text or "").lower()))


def test_leakage_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(15)] + [(90, None), (91, "  "), (92, "w1 w2")]
    docs = [(100, None), (101, ""), (102, "\\emph{" + items[3][1].replace(" ", "}, \\textit{") + "}"), (103, items[2][1].upper().replace(" ", "\r\n% "))]
    for d in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        it = _words(items[rng.randrange(15)][1])
        n = rng.randrange(0, len(it) + 1)
        at = rng.randrange(0, len(it) - n + 1)
        docs.append((d, " ".join(words[:50] + it[at : at + n] + words[50:])))
    want = {}
    for d, x in docs:
        for i, y in items:
            a, b = _words(x), _words(y)
            best = 0
            for p in range(len(a)):
                for q in range(len(b)):
                    k = 0
                    while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k]:
                        k += 1
                    best = max(best, k)
            if best >= SPAN:
                want[d, i] = best
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("hash", F.lit(0))
    got = passages(df, spark.createDataFrame(items, "item_id bigint, text string"), "doc_id", "item_id")
    assert {(r.doc_id, r.item_id): r.longest_run for r in got.collect() if r.longest_run >= SPAN} == want and want
    assert passages(df, spark.createDataFrame([(1, None)], "item_id bigint, text string"), "doc_id", "item_id").isEmpty()
    assert passages(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string"), "doc_id", "item_id").isEmpty()


def test_seeds_bear_one_substitution():
    a = np.arange(1, 13, dtype=np.uint64)
    for i in range(SPAN):
        b = a.copy()
        b[i] = 99
        assert (seeds(a) == seeds(b)).any()
    assert seeds(a[:11]).shape == (3, 0)


@pytest.mark.parametrize("name,value", [("SHARD_SEEDS", 2), ("PLACES", 1)])
def test_seeds_in_shards_and_places_in_parts(spark, monkeypatch, name, value):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(14))), (2, "no")], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{i}" for i in range(13))) for i in (7, 8, 9)], "item_id bigint, text string")
    monkeypatch.setattr(f"skein.llm.leakage.{name}", value)
    assert tuples(passages(docs, items, "doc_id", "item_id")) == [(1, i, 13, 13, 13) for i in (7, 8, 9)]


def test_sieve(spark):
    h = np.random.default_rng(5).integers(0, 1 << 63, 60_000, dtype=np.uint64)
    known = sieve(spark.createDataFrame([(int(x),) for x in h[:20_000]], "hash bigint"), 20_000)
    assert known.nbytes <= 20_000 * 8
    passed = sifted(known, h)
    assert (passed[:20_000] == np.arange(20_000)).all() and len(passed) < 20_020
    assert not len(sifted(sieve(spark.createDataFrame([], "hash bigint"), 0), h))


def test_recall_by_substitutions(spark):
    """Windows with up to one word substituted always come out; of more, those that a mask ignores together."""
    rng = random.Random(21)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(SPAN))) for i in range(200)]
    for n in (0, 1, 2):
        docs = []
        for i, x in items:
            words = x.split()
            for j in rng.sample(range(SPAN), n):
                words[j] = "other"
            docs.append((i, " ".join(words)))
        got = passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), "doc_id", "item_id")
        found = sum(r.doc_id == r.item_id and r.n_equal == SPAN - n for r in got.collect())
        assert found == 200 if n < 2 else found > 20


def test_common_members():
    rng = random.Random(6)
    for _ in range(200):
        size = rng.randrange(1, 300)
        a, b = (sorted(rng.sample(range(size), rng.randrange(size + 1))) for _ in "ab")
        assert common(np.array(a, np.int64), np.array(b, np.int64), size) == len(set(a) & set(b))


def test_overlaps_against_brute_force(spark):
    rng = random.Random(7)
    sets = {f"s{i}": {f"u{rng.randrange(60)}" for _ in range(rng.randrange(1, 50))} for i in range(25)}
    sets |= {f"t{i}": set(rng.sample([f"v{j}" for j in range(30)], 24)) for i in range(6)}
    for s in list(sets.values())[:20]:
        s.add("everywhere")
    rows = [(g, m) for g, s in sets.items() for m in s] + [(None, "u1"), ("s1", None)]
    want = {}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a]) >= 5 and len(sets[b]) >= 5:
            n, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if n >= 0.4 * u:
                want[a, b] = (len(sets[a]), len(sets[b]), n)
    df = spark.createDataFrame(rows * 2, "code string, n string").withColumn("item", F.lit(1))
    got = {(r.source, r.target): (r.n_source, r.n_target, r.n_common) for r in overlaps(df, "code", "n", 5, 0.4).collect()}
    assert got == want and want
    assert overlaps(df.limit(0), "code", "n", 5, 0.4).isEmpty()


def test_running_text():
    text = "\\documentclass{x}\\newcommand{\\kw}{dust lane}\n% no\n\\begin{document}\\title{No}\n\\section{No}\nThe \\kw{} and \\emph{stars} \\cite{no} cost \\$5. $no$ % no\n\\begin{equation}no\\end{equation}\n\\begin{quote}Yes it is.\\end{quote}\n\\begin{thebibliography}{1} no\\end{thebibliography}\\end{document} no"
    assert sentences(running_text(text)) == [["the", "dust", "lane", "and", "star", "cost"], ["yes", "it", "is"]]
    for odd in ("", "\\", "$", "$$", "\\[" * 50_000, "\\begin{equation}", "%", "\\title[" * 20_000, "\n" * 100_000):
        assert isinstance(sentences(running_text(odd)), list)


def test_subjects(spark):
    rng = random.Random(8)
    vocab = {s: [f"{s}{chr(97 + i)}" for i in range(12)] for s in ("law", "sport", "film", "food", "music", "ships")}
    say = lambda s: f"we study the {rng.choice(vocab[s])} and then the {rng.choice(vocab[s])} once more."
    docs, truth = [], set()
    for i in range(240):
        about = rng.sample(sorted(vocab), 1 + (i % 5 == 0))
        body = [say(s) for s in about for _ in range(8)] + ["this is all we have to say here."] + ([say("film")] if i % 10 == 1 else [])
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        truth |= {(i, s) for s in about}
    seeds_ = [(i, s) for i, s in truth if i < 120] + [(3, None), (121, "sport"), (1, "law"), (1, "law"), (None, "law")]
    docs += [(900, None), (901, ""), (902, "  "), (903, "nothing of any kind"), (904, "% law")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit(1)).withColumn("s0", F.lit(2))
    got = {(r.doc_id, r.subject) for r in subjects(d, spark.createDataFrame(seeds_, "doc_id bigint, subject string"), "doc_id", "text", "subject").collect()}
    assert len(got ^ truth) <= 6 and not any(i >= 900 for i, _ in got)
    none = spark.createDataFrame([(1, None)], "doc_id bigint, subject string")
    assert subjects(d, none, "doc_id", "text", "subject").isEmpty()
    assert subjects(d.limit(0), spark.createDataFrame(seeds_, "doc_id bigint, subject string"), "doc_id", "text", "subject").isEmpty()


def test_neighbours_are_verified(spark, monkeypatch):
    """Every edge joins documents alike enough, whichever way the runs are cut; copies meet; edges grow with the documents."""
    rng = random.Random(10)
    docs = {i: frozenset(rng.sample(range(t := 40 * (i % 3), t + 40), 12)) for i in range(120)} | {200: frozenset([7777]), 201: frozenset(range(9000, 9010)), 202: frozenset(range(9000, 9010))}
    links = spark.createDataFrame([(i, x) for i, terms in docs.items() for x in terms], "doc bigint, term bigint")
    for least in (1, 10**9):
        monkeypatch.setattr("skein.llm.subjects.hot_keys", lambda df, keys, least=least: hot_keys(df, keys, 0.001, least))
        edges = {(r.doc, r.other): r.alike for r in similar(links).collect()}
        assert all((b, a) in edges for a, b in edges) and not any(200 in e for e in edges)
        assert len(edges) <= 2 * ORDERS * len(docs)
        for (a, b), alike in edges.items():
            assert len(docs[a] & docs[b]) >= 2 and abs(alike - len(docs[a] & docs[b]) / len(docs[a] | docs[b])) < 1e-6
    assert edges[201, 202] == 1


@pytest.mark.parametrize("most", [10**6, 0])
def test_all_that_share_a_term_are_heard(spark, monkeypatch, most):
    """What a document hears is the sum over all others, pair by pair, by broadcast and by shuffle; who shares nothing hears nothing, not even itself."""
    monkeypatch.setattr("skein.llm.subjects.MOST_TERMS", most)
    monkeypatch.setattr("skein.llm.subjects.skew_join", lambda left, right, keys: skew_join(left, right, keys, least=40))
    rng = random.Random(11)
    docs = {i: set(rng.sample(range(60), 8)) | ({100} if i % 3 else set()) for i in range(150)} | {200: {7777, 7778}, 201: {8888}, 202: {8888}}
    held = {i: (x, 1 - x) for i in docs if i % 2 == 0 or i == 201 for x in [rng.choice([0.0, 0.125, 1.0])]}
    linked = spark.createDataFrame([(i, sorted(t)) for i, t in docs.items()], "doc bigint, terms array<bigint>")
    sent = spark.createDataFrame([(i, *h) for i, h in held.items()], "doc bigint, s0 float, s1 float")
    got = {r.doc: (r.s0, r.s1) for r in _through(linked, sent, ["s0", "s1"]).collect()}
    want = {}
    for a, terms in docs.items():
        for b in held.keys() - {a}:
            alike = sum(1 / sum(t in docs[o] for o in held.keys() - {a}) for t in terms & docs[b])
            if alike:
                want[a] = tuple(x + alike * y for x, y in zip(want.get(a, (0, 0)), held[b], strict=True))
    assert got.keys() == want.keys() and 200 not in got
    assert all(abs(x - y) < 1e-9 for i in want for x, y in zip(got[i], want[i], strict=True))


def test_one_round_reaches_all_alike(spark):
    """Few seeds among many documents alike: each of these is linked to a seed, so one round gives it its subject."""
    rng = random.Random(12)
    vocab = {s: [f"{s}{chr(97 + i)}" for i in range(12)] for s in ("law", "sport", "film", "food")}
    about = {i: sorted(vocab)[i % 4] for i in range(400)}
    docs = [(i, " ".join(f"we saw the {rng.choice(vocab[s])} and then the {rng.choice(vocab[s])} once more." for _ in range(8))) for i, s in about.items()]
    seeds_ = spark.createDataFrame([(i, s) for i, s in about.items() if i < 40], "doc_id bigint, subject string")
    found = subjects(spark.createDataFrame(docs, "doc_id bigint, text string"), seeds_, "doc_id", "text", "subject", rounds=1)
    assert {(r.doc_id, r.subject) for r in found.collect()} == set(about.items())


def test_labels_move_along_edges(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (5, 6), (7, 1), (7, 2), (7, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], "doc bigint, other bigint, alike float")
    label = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 0.0), (7, 0.0, 1.0), (9, 0.0, 1.0)], "doc bigint, s0 double, s1 double")
    got = {r.doc: r for r in propagate(edges, label, ["s0", "s1"], 3).collect()}
    assert sorted(got) == [1, 2, 3, 4, 7, 9]
    assert got[1][1:3] == (1.0, 0.0) and got[4][1:3] == (1.0, 0.0) and got[9][1:3] == (0.0, 1.0)
    assert got[7]._labelled == [False, False] and got[7].s1 < 0.1
    assert got[9]._labelled == [False, True] and got[1]._labelled == [True, False]
    assert propagate(edges, label, ["s0", "s1"], 0).count() == 5


def test_terms():
    terms, places = (x.to_pylist() for x in _terms(["We saw it. We saw it. It saw we it saw.", None, "", "It saw we. x"]))
    said = [[[t[i] for i in s] for s in p] for t, p in zip(terms, places, strict=True)]
    assert said[0][0] == said[0][1] and len(said[0][0]) == 5 and len(said[0][2]) == 6 and said[1] == said[2] == []
    assert all(len(set(t)) == len(t) for t in terms) and len(set(said[0][0]) & set(said[3][0])) == 3
    assert _terms(["We saw the plumless."])[0] != _terms(["We saw the buckeroo."])[0]
    assert len({_IDS[x] for x in ("plumless", "buckeroo")}) == 2 and all(-(1 << 63) <= i < 1 << 63 for i in _IDS.values())
    assert _terms([])[0].to_pylist() == []


@pytest.mark.parametrize("share", [0.1, 0.33, 0.6])
def test_subjects_whatever_their_share(spark, share):
    """Ten subjects, one on a tenth, a third or most of the labels: each links its documents, and ordinary words don't."""
    rng = random.Random(9)
    names = [f"{c}area" for c in "abcdefghij"]
    vocab = {s: [f"{s}{chr(97 + i)}" for i in range(10)] for s in names}
    plain = [f"plain{a}{b}" for a in "klmnopqrst" for b in "klmnopqrst"]
    say = lambda s: f"the {rng.choice(plain)} has a {rng.choice(vocab[s])} and a {rng.choice(vocab[s])} at last."
    docs, truth = [], {}
    for i in range(500):
        first = names[0] if rng.random() < share else rng.choice(names[1:])
        about = {first, rng.choice(names[1:])} if i % 4 == 0 else {first}
        body = [say(s) for s in sorted(about) for _ in range(8)] + [f"we saw {rng.choice(plain)} there."]
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        truth[i] = about
    seeds_ = [(i, rng.choice(names) if rng.random() < 0.05 else s) for i, about in truth.items() if i < 250 for s in sorted(about)]
    found = subjects(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(seeds_, "doc_id bigint, subject string"), "doc_id", "text", "subject").collect()
    got = {i: {r.subject for r in found if r.doc_id == i} for i in truth}
    assert sum(got[i] == truth[i] for i in range(250, 500)) >= 0.95 * 250
