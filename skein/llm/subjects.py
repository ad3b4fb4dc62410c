"""Subject areas of documents, by propagating labels over a graph of similar documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.markup import running_text, sentences
from skein.operators.skew import hot_keys, skew_join
from skein.session import read, stage

#: A term links documents if at least so many labelled ones have it and its labels lean to some
#: subjects: their Kullback-Leibler divergence from the mean is at least this share of what a term
#: of the foremost subject alone would reach, log(1 / its share), or of log(subjects) if that is less.
LEAST_DOCS, LEAST_LEAN = 2, 0.3
#: The same for the terms by which documents are compared.
LINK_LEAN = 0.3
#: Weight of the mean in a term's distribution, in documents.
SMOOTH = 1.0
#: For :func:`similar` alone: each document stands in so many orders of the corpus, by minimum hashes of its
#: linking terms, and is compared with its next neighbours in each.
ORDERS, NEIGHBOURS = 6, 1
#: Neighbours are linked if they share so many linking terms and this share of all they have.
LEAST_COMMON, LEAST_LIKE = 2, 0.1
#: An order's run of one minimum hash is cut into so many parts if it has a thousandth of all rows or more.
HOT_PARTS = 256
#: A seed is trusted if its neighbours give its subjects at least this share.
TRUST = 0.1
#: Propagated share from which on a document is a candidate for a subject.
CANDIDATE = 0.002
#: A sentence counts for its foremost subject if that has at least half of its weight.
FOREMOST = 0.5
#: Share of a document's sentences from which on it deals with a subject (about a third), and for a trusted label.
SHARE, LABEL_SHARE = 0.28, 0.2
#: Linking terms up to this number (about 30 MB) are broadcast, more are joined by shuffle; subjects are columns.
MOST_TERMS, MOST_SUBJECTS = 200_000, 500


class _Ids(dict):
    """Word -> 64-bit id; emptied when large."""

    def __missing__(self, term: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term) - (1 << 63)
        return h


_IDS = _Ids()


_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _terms(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    """For each text the ids of its terms (the words of its running text and each two neighbours of a sentence), each once, and each sentence as places in these."""
    words, sentence_ends, text_ends = [], [0], [0]
    for text in texts:
        for sentence in sentences(running_text(text)) if text else ():
            words.extend(map(_IDS.__getitem__, sentence))
            sentence_ends.append(len(words))
        text_ends.append(len(sentence_ends) - 1)
    ids = np.array(words, np.int64).view(np.uint64)
    sentence = np.repeat(np.arange(len(sentence_ends) - 1), np.diff(sentence_ends))
    inside = np.flatnonzero(sentence[1:] == sentence[:-1])
    pairs = (ids[inside] * _PAIR) ^ (ids[inside + 1] + (ids[inside] >> np.uint64(29)))
    at, term = np.concatenate((sentence, sentence[inside])), np.concatenate((ids, pairs * _PAIR)).view(np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(text_ends))[at]
    order = np.lexsort((at, term, text_of))
    at, term, text_of = at[order], term[order], text_of[order]
    first = np.ones(len(at), bool)
    first[1:] = (text_of[1:] != text_of[:-1]) | (term[1:] != term[:-1])
    own = np.concatenate(([0], np.cumsum(np.bincount(text_of[first], minlength=len(texts)))))
    place = np.cumsum(first) - 1 - own[text_of]
    once = first.copy()
    once[1:] |= at[1:] != at[:-1]
    at, place = at[once], place[once]
    order = np.argsort(at, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(sentence_ends) - 1))))
    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order].astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(term[first])), pa.ListArray.from_arrays(pa.array(text_ends, pa.int32()), places)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), *_terms(b.column(1).to_pylist())], ["doc", "terms", "sentences"])


def subjects(docs: DataFrame, seeds: DataFrame, doc: str, text: str, subject: str, share: float = SHARE, rounds: int = 3) -> DataFrame:
    """``doc``, ``subject``, ``share``, ``n_sentences``: the subjects a document deals with.

    ``seeds`` has (doc, subject) given by hand, several for a document, some of them wrong; null
    subjects and repeated rows don't count. Null, empty and blank texts and texts without
    running text give no row, and neither do documents that no linking term ties to a seed.
    Without seeds there is no subject and no row. Copies are documents of their own; ``doc``
    should be unique; other columns are ignored.

    The graph: linking terms are words and pairs of words whose documents' labels lean to few
    subjects. Any two documents with a linking term in common are linked, the more the more
    terms they share and the fewer others have these. A round of propagation sends the documents'
    distributions over subjects along all these edges, summed term by term (:func:`propagate`):
    no pair is left out and none is listed, so a round grows with the documents' terms, whatever
    a subject's share. Trusted seeds are clamped to their labels; seeds whose neighbours
    contradict them lose their trust, and no subject displaces another. What a
    document keeps from propagation are its candidates. An exact check of the text follows: the
    terms of each sentence, by the propagated distributions of all documents, decide what the
    sentence deals with, and candidates with ``share`` of the sentences come out; the labels of a
    trusted seed do with :data:`LABEL_SHARE`.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    parsed = stage(rows.where("text IS NOT NULL").mapInArrow(_parse, f"doc {kind}, terms array<bigint>, sentences array<array<int>>").where(F.size("sentences") > 0), "subjects-terms")
    marks = seeds.select(F.col(doc).alias("doc"), F.col(subject).alias("subject")).dropna().distinct()
    names = [r[0] for r in marks.select("subject").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    cols = [f"s{i}" for i in range(len(names))]
    if not names:
        return docs.select(F.col(doc), F.lit("").alias(subject), F.lit(0.0).alias("share"), F.lit(0).cast("bigint").alias("n_sentences")).where(F.lit(False))
    label = marks.groupBy("doc").agg(*(F.max(F.when(F.col("subject") == n, 1.0).otherwise(0.0)).alias(c) for n, c in zip(names, cols, strict=True)))
    size = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    label = label.select("doc", *((F.col(c) / size).alias(c) for c in cols))
    own = parsed.select("doc", "terms")

    def votes(of: DataFrame) -> DataFrame:
        return own.join(stage(_floats(of, cols), "subjects-sent"), "doc").select(*cols, F.explode("terms").alias("term"))

    linking = _linking_terms(votes(label), cols, LINK_LEAN).select("term")
    linked = stage(_meet(own.select("doc", F.explode("terms").alias("term")), linking).groupBy("doc").agg(F.collect_list("term").alias("terms")), "subjects-linked")
    believed = propagate(linked, label, cols, rounds)
    terms = _linking_terms(votes(believed), cols)
    said = F.transform("sentences", lambda places: F.transform(places, lambda i: F.col("terms")[i]))
    spoken = parsed.select("doc", F.posexplode(said).alias("at", "said")).select("doc", "at", F.explode("said").alias("term"))
    spoken = _meet(spoken, terms).groupBy("doc", "at").agg(*(F.sum(c).alias(c) for c in cols))
    most = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    about = F.coalesce(*(F.when(F.col(c) == most, F.lit(n)) for n, c in zip(names, cols, strict=True)))
    clear = spoken.where(most >= FOREMOST * size).select("doc", about.alias("subject"))
    counts = clear.groupBy("doc").agg(F.count(F.lit(1)).alias("n_sentences"), *(F.sum(F.when(F.col("subject") == n, 1).otherwise(0)).alias(f"n_{c}") for n, c in zip(names, cols, strict=True)))
    parts = (F.struct(F.lit(n).alias("subject"), (F.col(f"n_{c}") / F.col("n_sentences")).alias("share"), F.col("_held")[i].alias("held"), F.col("_labelled")[i].alias("labelled")) for i, (n, c) in enumerate(zip(names, cols, strict=True)))
    dealt = counts.join(believed, "doc").select("doc", "n_sentences", F.explode(F.array(*parts)).alias("e"))
    least = F.when(F.col("e.labelled"), F.least(F.lit(LABEL_SHARE), F.lit(share))).otherwise(share)
    kept = dealt.where((F.col("e.held") >= CANDIDATE) & (F.col("e.share") >= least))
    return kept.select(F.col("doc").alias(doc), F.col("e.subject").alias(subject), F.col("e.share").alias("share"), "n_sentences")


def _floats(of: DataFrame, cols: list[str]) -> DataFrame:
    return of.select("doc", *(F.col(c).cast("float").alias(c) for c in cols))


def similar(links: DataFrame) -> DataFrame:
    """(doc, other, alike), both ways: documents side by side in one of the orders and alike enough.

    A list of near neighbours, not of all pairs alike, whose number grows with the square of the
    documents. :func:`subjects` doesn't use it: its graph has all pairs.

    ``links``: (doc, term), each once. An order sorts the documents by one minimum hash of their
    terms, then the next; documents with equal ones follow each other. Only runs of one minimum
    hash are windows, and the hottest (by a count) are cut into parts by a hash of the document.
    Copies of one text are linked like any documents that are alike.
    """
    hashes = [F.min(F.xxhash64("term", F.lit(i))).alias(f"m{i}") for i in range(ORDERS)]
    known = stage(links.groupBy("doc").agg(F.collect_list(F.hash("term")).alias("terms"), *hashes), "subjects-vectors")
    places = F.explode(F.array(*(F.struct(F.col(f"m{i}").alias("first"), F.col(f"m{(i + 1) % ORDERS}").alias("then")) for i in range(ORDERS))))
    orders = known.select("doc", "terms", places.alias("p")).select("doc", "terms", "p.first", "p.then")
    hot = [k for (k,) in hot_keys(known.select(F.explode(F.array(*(f"m{i}" for i in range(ORDERS)))).alias("first")), ["first"])]
    part = F.when(F.col("first").isin(hot), F.pmod(F.xxhash64("doc"), F.lit(HOT_PARTS))).otherwise(0) if hot else F.lit(0)
    run = Window.partitionBy("first", "part").orderBy("then", "doc")
    theirs = [F.lead(F.struct(F.col("doc").alias("other"), F.col("terms").alias("theirs")), i + 1).over(run).alias(f"n{i}") for i in range(NEIGHBOURS)]
    pairs = orders.withColumn("part", part).select("doc", "terms", *theirs)
    pairs = pairs.select("doc", "terms", F.explode(F.array(*(f"n{i}" for i in range(NEIGHBOURS)))).alias("n")).where("n IS NOT NULL")
    common = F.size(F.array_intersect("terms", "n.theirs"))
    pairs = pairs.select("doc", F.col("n.other").alias("other"), common.alias("c"), (F.size("terms") + F.size("n.theirs")).alias("all"))
    edges = pairs.where(F.col("c") >= LEAST_COMMON).select("doc", "other", (F.col("c") / (F.col("all") - F.col("c"))).cast("float").alias("alike")).where(F.col("alike") >= LEAST_LIKE)
    both = F.explode(F.array(F.struct("doc", "other"), F.struct(F.col("other").alias("doc"), F.col("doc").alias("other"))))
    return stage(edges.select(both.alias("e"), "alike").select("e.doc", "e.other", "alike"), "subjects-edges")


def _along(edges: DataFrame, sent: DataFrame, cols: list[str]) -> DataFrame:
    """(doc, s0, s1, ...): what its neighbours in ``edges`` send to each document, weighted by their likeness."""
    met = edges.join(sent.withColumnRenamed("doc", "other"), "other")
    return met.groupBy("doc").agg(*(F.sum(F.col(c) * F.col("alike")).alias(c) for c in cols))


def _through(linked: DataFrame, sent: DataFrame, cols: list[str]) -> DataFrame:
    """(doc, s0, s1, ...): what all others that share a term send to each document, over each term the mean of the others that have it.

    The sum over all pairs, by terms: what all send through a term less the document's own, which
    leaves an exact zero where nobody else sends. ``linked``: (doc, terms), staged.
    """
    sums = linked.join(sent, "doc").select(*cols, F.explode("terms").alias("term"))
    sums = stage(sums.groupBy("term").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_{c}") for c in cols)), "subjects-sums")
    told = linked.join(sent, "doc", "left")
    told = stage(told, "subjects-told") if sums.count() > MOST_TERMS else told
    others = F.col("_n") - F.when(F.col(cols[0]).isNotNull(), 1).otherwise(0)
    met = _meet(told.select("doc", *cols, F.explode("terms").alias("term")), sums).where(others > 0)
    return met.groupBy("doc").agg(*(F.sum((F.col(f"_{c}") - F.coalesce(c, F.lit(0.0))) / others).alias(c) for c in cols))


def propagate(graph: DataFrame, label: DataFrame, cols: list[str], rounds: int) -> DataFrame:
    """The distribution over ``cols`` of each document a label reaches in ``rounds`` in ``graph``.

    ``graph`` has edges (doc, other, alike), both ways, or documents with terms (doc, terms), each
    term once, and then all documents that share terms are neighbours: what a document hears from
    another counts 1/n for each term they share, n being the other documents that send and have it.

    Besides doc and ``cols``: ``_held``, the most that each subject was held in any round, by a
    trusted seed its labels and what its neighbours add to them, by another seed only what they
    said last, and ``_labelled``, whether it is the label of a trusted seed.

    A round gives a document the mean of its neighbours', weighted by their likeness; where all
    that share terms are neighbours, its shares are squared, since the many that are hardly alike
    add a little of every subject. From the
    first round on a seed keeps its label if its neighbours give that :data:`TRUST`, or if it has
    none; other seeds take what their neighbours say.
    """
    hear = _through if "terms" in graph.columns else _along
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    given = [f"_{c}" for c in cols]
    now = label.select("*", *(F.col(c).alias(g) for c, g in zip(cols, given, strict=True)), F.array(*cols).alias("_held"), F.array(*(F.col(c) > 0 for c in cols)).alias("_labelled"))
    for _ in range(rounds):
        now = stage(now, "subjects-round")
        heard = hear(graph, stage(_floats(now, cols), "subjects-sent"), cols).where(total > 0)
        if hear is _through:
            heard = heard.select("doc", *((F.col(c) * F.col(c)).alias(c) for c in cols))
        heard = heard.select("doc", *((F.col(c) / total).alias(c) for c in cols))
        both = heard.join(now.select("doc", *given, F.col("_held").alias("_before"), *(F.col(c).alias(f"_own{c}") for c in cols)), "doc", "full")
        said = {c: F.coalesce(c, F.lit(0.0)) for c in cols}
        agree = sum((F.when(F.col(f"_{c}") > 0, said[c]).otherwise(0.0) for c in cols), F.lit(0.0))
        trusted = F.col(given[0]).isNotNull() & (F.col(cols[0]).isNull() | (agree >= TRUST))
        label_of = {c: F.when(trusted, F.col(f"_{c}")) for c in cols}
        held = F.array(*(F.greatest(c, label_of[c], F.when(trusted | F.col(given[0]).isNull(), F.col("_before")[i]), F.lit(0.0)) for i, c in enumerate(cols))).alias("_held")
        labelled = F.array(*(F.coalesce(label_of[c] > 0, F.lit(False)) for c in cols)).alias("_labelled")
        now = both.select("doc", *(F.coalesce(label_of[c], F.col(c), F.col(f"_own{c}")).alias(c) for c in cols), *given, held, labelled)
    return stage(now.drop(*given), "subjects-held")


def _linking_terms(votes: DataFrame, cols: list[str], least_lean: float = LEAST_LEAN) -> DataFrame:
    """(term, s0, s1, ...): how far each linking term's distribution over subjects is above the mean, times how far it leans.

    Both are shares of what is possible for the subject, so that a subject with most of the votes
    can be leant to as well. Its terms occur by chance more easily and need more documents: all
    must give the evidence (documents times divergence) of ``LEAST_DOCS`` that just lean to one
    of even subjects. ``votes``: the distribution of a document, once for each of its terms;
    merged map-side.
    """
    sums = votes.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in cols)).where(F.col("n") >= LEAST_DOCS)
    sums = stage(sums, "subjects-votes")
    total = sums.agg(*(F.sum(c).alias(c) for c in cols)).first()
    whole = sum(total[c] or 0.0 for c in cols) or 1.0
    mean = {c: max((total[c] or 0.0) / whole, 1e-9) for c in cols}
    p = {c: (F.col(c) + SMOOTH * mean[c]) / (F.col("n") + SMOOTH) for c in cols}
    lean = sum((p[c] * F.log(p[c] / mean[c]) for c in cols[1:]), p[cols[0]] * F.log(p[cols[0]] / mean[cols[0]]))
    if len(cols) == 1:
        return stage(sums.select("term", p[cols[0]].cast("float").alias(cols[0])), "subjects-links")
    even = math.log(len(cols))
    most = {c: min(even, max(-math.log(mean[c]), 1e-9)) for c in cols}
    above = {c: F.greatest(p[c] - mean[c], F.lit(0.0)) / max(1 - mean[c], 1e-9) for c in cols}
    foremost = F.greatest(*above.values())
    reach = F.coalesce(*(F.when(above[c] == foremost, F.lit(most[c])) for c in cols))
    scored = sums.select("term", "n", lean.alias("_lean"), reach.alias("_reach"), *(above[c].alias(c) for c in cols))
    leans = (F.col("_lean") > least_lean * F.col("_reach")) & (F.col("n") * F.col("_lean") > LEAST_DOCS * LEAST_LEAN * even)
    weight = F.col("_lean") / F.col("_reach")
    return stage(scored.where(leans).select("term", *((F.col(c) * weight).cast("float").alias(c) for c in cols)), "subjects-links")



def _meet(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with the row of ``terms``, unique by term: by broadcast if these, counted in the written table, are few, else split by hot terms."""
    return rows.join(F.broadcast(terms), "term") if terms.count() <= MOST_TERMS else skew_join(rows, terms, ["term"])


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of every article with their shares of its sentences."""
    docs, seeds = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "doc_subject_labels", "doc_id", "subject")
    areas = read(spark, sf_dir, "subject_areas", "subject")
    return subjects(docs, seeds.join(areas, "subject", "left_semi"), "doc_id", "text", "subject")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas that about a third of the running text or more deals with: doc_id, subject."""
    return p10_shares(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles of each source deal with each area."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source")
    return docs.join(p10_found(spark, sf_dir), "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_composition": p10_composition}
ORACLE: dict[str, str] = {}
