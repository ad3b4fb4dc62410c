"""Schemas that drift between files: lifespans of fields, changes, one consistent table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A field belongs to a file if at least one in so many of its records carries the key.
CARRIED_ONE_IN = 5

#: The names under which sources have delivered a field. A concept's first name is the target's.
ALIASES = {
    "author": ("author", "user", "username", "author_name", "posted_by"),
    "created_utc": ("created_utc", "created", "created_at", "posted_utc", "timestamp", "created_time", "date"),
    "crosspost_parent": ("crosspost_parent", "xpost_parent", "crosspost_parent_id", "crosspost_of", "parent_post"),
    "domain": ("domain", "link_domain", "host"),
    "num_comments": ("num_comments", "comment_count", "comments", "n_comments"),
    "num_crossposts": ("num_crossposts", "crosspost_count", "xpost_count", "n_crossposts"),
    "score": ("score", "points", "ups", "karma"),
    "name": ("name", "fullname", "post_id", "id"),
    "subreddit": ("subreddit", "subreddit_name", "community", "sub"),
    "subreddit_id": ("subreddit_id", "community_id", "sub_id"),
    "subreddit_subscribers": ("subreddit_subscribers", "subscribers", "subscriber_count"),
    "title": ("title", "headline", "post_title"),
    "selftext": ("selftext", "self_text", "body", "text"),
    "upvote_ratio": ("upvote_ratio", "ratio", "up_ratio", "vote_ratio"),
}

#: Kinds of content, from the JSON text of a value once a wrapping of one element is off; the first that fits counts.
CONTENT = (
    ("flag", r"^(true|false)$"),
    ("list", r"^\["),
    ("record", r"^\{"),
    ("time", r'^"?(1[0-9]{9}(\.[0-9]+)?|(19|20)[0-9]{2}-[01][0-9]-[0-3][0-9].*)"?$'),
    ("ratio", r'^"?([01]?\.[0-9]+|[01]\.0|[0-9]{1,3}(\.[0-9]+)?%)"?$'),
    ("digit", r'^"?-?[0-9]"?$'),
    ("count", r'^"?-?[0-9]{2,3}"?$'),
    ("amount", r'^"?-?[0-9]{4,12}"?$'),
    ("post", r'^"(?i:t3)_[0-9a-zA-Z]+"$'),
    ("place", r'^"(?i:t5)_[0-9a-zA-Z]+"$'),
    ("thing", r'^"(?i:t[0-9])_[0-9a-zA-Z]+"$'),
    ("host", r'^"[a-z0-9-]+(\.[a-z0-9-]+)+"$'),
    ("code", r'^"[A-Za-z]{1,3}"$'),
    ("blank", r'^"\s*"$'),
    ("word", r'^"[^\s"]+"$'),
    ("phrase", r'^"[^\s"]+(\s+[^\s"]+){1,2}"$'),
    ("text", r""),
)
#: A single value of more characters is text, of whatever kind it would be.
LONG = 200


#: Kinds that tell a field by themselves; fields of other kinds go on under another name only if the names are akin.
TELLING = {"time", "ratio", "post", "place", "thing", "host"}


def _json_type(text: Column) -> Column:
    """The JSON type of a value's JSON text; null for a JSON null."""
    first = F.substring(text, 1, 1)
    return F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(first.isin("t", "f"), "boolean").when(first != "n", "number")


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def unwrapped(text: Column) -> Column:
    """The JSON text within an array of one element or an object of one key, else ``text``."""
    inner = F.regexp_extract(text, r'^(?:\[|\{"[^"]*":)("(?:[^"\\]|\\.)*"|[^\[\]{},"]+)[\]}]$', 1)
    return F.when(F.substring(text, 1, 1).isin("[", "{"), F.coalesce(F.nullif(inner, F.lit("")), text)).otherwise(text)


def _kind(body: Column) -> Column:
    """The first kind of CONTENT that fits; told by the first character where that is enough."""

    def among(kinds: list[tuple[str, str]]) -> Column:
        found = F.when(body.rlike(kinds[0][1]), kinds[0][0])
        for name, pattern in kinds[1:]:
            found = found.when(body.rlike(pattern), name)
        return found.otherwise(CONTENT[-1][0])

    first, quoted = F.substring(body, 1, 1), [k for k in CONTENT[3:-1] if '"' in k[1]]
    plain = [k for k in quoted if '"?' in k[1]]
    kind = F.when(first == "[", "list").when(first == "{", "record").when(first.isin("t", "f"), "flag")
    return kind.when(F.length(body) > LONG, CONTENT[-1][0]).when(first == '"', among(quoted)).otherwise(among(plain))


def _profile(text: Column) -> Column:
    """``type`` and ``kind`` of a value's JSON text; both null for a JSON null."""
    kind = F.when(F.substring(text, 1, 1) != "n", _bound(unwrapped(text), _kind))
    return F.struct(_json_type(text).alias("type"), kind.alias("kind"))


def records(raw: DataFrame, producer: str = "series", file: str = "file_no", payload: str = "payload") -> DataFrame:
    """producer, file_no and ``record`` (variant) of the lines that are JSON objects.

    Null, blank and broken lines and lines of other JSON types are left out.
    """
    parsed = raw.where(F.col(payload).rlike(r"^\s*\{")).select(F.col(producer).alias("series"), F.col(file).cast("bigint").alias("file_no"), F.try_parse_json(F.col(payload)).alias("record"))
    return parsed.where(F.col("record").isNotNull() & F.col("series").isNotNull() & F.col("file_no").isNotNull())


def catalogue(parsed: DataFrame) -> DataFrame:
    """One row for each field of each file: what a footer would say, and a profile of its content.

    Columns: series, file_no, n_records, field, n_carry (records with the key, null or not),
    json_type (of most non-null values, the alphabetically first at a tie; null without any) and
    ``content`` (map from kind of content to its number of values). Keys are exploded and merged
    map-side, so a producer with most of the records costs no task more than its share.
    """
    spark = parsed.sparkSession
    parsed.createOrReplaceTempView("_drift_records")
    fields = spark.sql("SELECT r.series, r.file_no, e.key AS field, to_json(e.value) AS text FROM _drift_records r, LATERAL variant_explode(r.record) e")
    spark.catalog.dropTempView("_drift_records")
    fields = fields.select("series", "file_no", "field", _bound(F.col("text"), _profile).alias("p"))
    counts = fields.groupBy("series", "file_no", "field", F.col("p.type").alias("json_type"), F.col("p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    typed = counts.groupBy("series", "file_no", "field", "json_type").agg(F.sum("n").alias("n"), F.collect_list(F.struct("kind", "n")).alias("kinds"))
    best = F.min(F.when(F.col("json_type").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("json_type").alias("t"))))
    per_field = typed.groupBy("series", "file_no", "field").agg(F.sum("n").alias("n_carry"), best["t"].alias("json_type"), F.flatten(F.collect_list("kinds")).alias("content"))
    sizes = parsed.groupBy("series", "file_no").agg(F.count(F.lit(1)).alias("n_records"))
    return per_field.join(sizes, ["series", "file_no"])


def lifespans(fields: DataFrame) -> DataFrame:
    """Starts and ends of the fields of each producer: the islands of (series, field, json_type).

    ``fields`` is a catalogue. Gives series, file_no, event (``start`` or ``end``), field,
    json_type, content: a start stands at the first file of an island, an end at the file after
    its last, with the type and content from the last. Nothing starts with the first file of a
    series or ends with the last. Files without any record are not in the catalogue: the file
    before is then the last one with records.
    """
    order = Window.partitionBy("series").orderBy("file_no")
    files = fields.select("series", "file_no").distinct()
    files = files.withColumn("at", F.row_number().over(order)).withColumn("next_no", F.lead("file_no").over(order))
    there = fields.where(F.col("n_carry") * CARRIED_ONE_IN >= F.col("n_records")).join(files, ["series", "file_no"])
    there = there.withColumn("json_type", F.coalesce("json_type", F.lit("")))
    span = Window.partitionBy("series", "field", "json_type").orderBy("at")
    edges = there.withColumn("starts", F.coalesce(F.lag("at").over(span) != F.col("at") - 1, F.lit(True)) & (F.col("at") > 1))
    edges = edges.withColumn("ends", F.coalesce(F.lead("at").over(span) != F.col("at") + 1, F.lit(True)) & F.col("next_no").isNotNull())
    columns = ("field", "json_type", "content")
    starts = edges.where("starts").select("series", "file_no", F.lit("start").alias("event"), *columns)
    ends = edges.where("ends").select("series", F.col("next_no").alias("file_no"), F.lit("end").alias("event"), *columns)
    return starts.unionByName(ends)


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _words(name: str) -> set[str]:
    spaced = "".join("_" + c.lower() if c.isupper() else c if c.isalnum() else "_" for c in name) if not name.isupper() else name.lower()
    return {w for w in spaced.split("_") if w}


#: Least agreement of contents for a rename between names of one concept, akin names, and any names.
LEAST, AKIN, SURE = 0.2, 0.5, 0.9


def name_likeness(a: str, b: str, aliases: dict[str, tuple[str, ...]] = ALIASES) -> float:
    """1 for names of one concept, -1 for those of two known ones, else the share of common words."""
    concept = {_plain(n): c for c, names in aliases.items() for n in names}
    known = concept.get(_plain(a)), concept.get(_plain(b))
    if _plain(a) == _plain(b) or None not in known:
        return 1.0 if _plain(a) == _plain(b) or known[0] == known[1] else -1.0
    x, y = _words(a), _words(b)
    return len(x & y) / max(1, len(x | y))


def content_likeness(a: dict[str, int], b: dict[str, int], kinds: set[str] | None = None) -> float | None:
    """Common share of two content profiles, in all ``kinds`` or some; None where one has no value."""
    n, m = sum(a.values()), sum(b.values())
    if not n or not m:
        return None
    return sum(min(a.get(k, 0) / n, b.get(k, 0) / m) for k in a if kinds is None or k in kinds)


def goes_on(a: str, b: str, old: dict[str, int], new: dict[str, int]) -> float | None:
    """How sure it is that the content of field ``a`` goes on as ``b``; None if it doesn't."""
    names, contents = name_likeness(a, b), content_likeness(old, new)
    if names < 0:
        return None
    if contents is None:
        return names + 0.5 if names >= 0.5 else None
    if names == 1:
        fits = contents >= LEAST
    elif names > 0:
        fits = contents >= AKIN
    else:
        fits = (content_likeness(old, new, TELLING) or 0) >= SURE
    return names + contents if fits else None


def _changes_of_file(events: list[dict]) -> list[tuple[str, str, str]]:
    """The changes of one file of one series, from its lifespan events: kind, old and new name."""
    side: dict[str, dict[str, tuple[str, dict[str, int]]]] = {"start": {}, "end": {}}
    for e in events:
        profile: dict[str, int] = {}
        for c in e["content"]:
            if c["kind"] is not None:
                profile[c["kind"]] = profile.get(c["kind"], 0) + c["n"]
        side[e["event"]][e["field"]] = (e["json_type"], profile)
    new, old = side["start"], side["end"]
    rows = [("retyped", f, f) for f in new.keys() & old.keys() if new[f][0] and old[f][0]]
    gone, come = old.keys() - new.keys(), new.keys() - old.keys()
    scored = []
    for a in gone:
        for b in come:
            sure = goes_on(a, b, old[a][1], new[b][1])
            if sure is not None:
                scored.append((-sure, a, b))
    used: set[tuple[int, str]] = set()
    for _, a, b in sorted(scored):
        if (0, a) in used or (1, b) in used:
            continue
        used |= {(0, a), (1, b)}
        rows.append(("renamed", a, b))
        if old[a][0] and new[b][0] and old[a][0] != new[b][0]:
            rows.append(("retyped", a, b))
    rows += [("removed", a, "") for a in gone if (0, a) not in used] + [("added", "", b) for b in come if (1, b) not in used]
    return sorted(rows)


def _changes_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(s, n, *row) for s, n, e in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in _changes_of_file(e)]
        columns = [pa.array([r[i] for r in found], b.schema.types[i] if i < 2 else pa.string()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(columns, ["series", "file_no", "change_kind", "old_field", "new_field"])


def changes(events: DataFrame) -> DataFrame:
    """Each change of a field from one file of a series to the next.

    A field that ends where another starts is renamed if their contents agree (kinds of content,
    wrappings of one element aside) and their names are akin, or if contents of a telling kind
    agree; fields without any value are judged by their names, and names of two known concepts
    are never one. One that ends and starts under its own
    name is retyped; a field that had no value on one side isn't. Each name goes into one rename at most, the most alike
    first, ties by name. The events of one file are one row: bounded by its number of fields.
    """
    kind = events.schema["series"].dataType.simpleString()
    files = events.groupBy("series", "file_no").agg(F.collect_list(F.struct("event", "field", "json_type", "content")).alias("events"))
    return files.mapInArrow(_changes_of_files, f"series {kind}, file_no bigint, change_kind string, old_field string, new_field string")


def _text(v: Column) -> Column:
    """The plain text of a JSON text: unwrapped and without its quotes."""
    plain = lambda body: F.when(F.substring(body, 1, 1) == '"', F.try_variant_get(F.try_parse_json(body), "$", "string")).when(body != "null", body)
    return _bound(unwrapped(v), plain)


def _time(v: Column) -> Column:
    """UTC date (YYYY-MM-DD) of epoch seconds or an ISO date, in whatever JSON type."""
    epoch = lambda t: F.date_format(F.timestamp_seconds(t.try_cast("double")), "yyyy-MM-dd")
    return _bound(_text(v), lambda t: F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), epoch(t)).otherwise(F.date_format(F.substring(t, 1, 10).try_cast("date"), "yyyy-MM-dd")))


def _ratio(v: Column) -> Column:
    return _bound(_text(v), lambda t: F.when(t.endswith("%"), F.substring_index(t, "%", 1).try_cast("double") / 100).otherwise(t.try_cast("double")))


#: The cast of each field of the target table.
CASTS = {
    **{c: _text for c in ALIASES},
    **{c: lambda v: _text(v).try_cast("double").try_cast("bigint") for c in ("num_comments", "num_crossposts", "score", "subreddit_subscribers")},
    "created_utc": _time,
    "upvote_ratio": _ratio,
}
#: More distinct field names than this can't become columns of casts.
MOST_NAMES = 10_000


def unified(parsed: DataFrame, fields: DataFrame, renames: DataFrame | None = None, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """All records as one table: series, file_no, the fields of ``aliases``, typed, and ``other_fields``.

    ``other_fields`` (map of name to text) has the values of every field outside ``aliases`` that
    belongs to at least one file, by the rule of :func:`lifespans`, wherever a record carries it.
    Spellings of such a name and names joined by a rename go under that with most records, unless
    a file has several of them side by side: then each keeps its own. ``fields`` is the catalogue of ``parsed``. The casts are generated from the alias table,
    widened by the names found in ``renames`` (rows of :func:`changes`). Names that differ only
    in case or signs are one name. A field takes its first name that has a value; an absent,
    null or uncastable value is null (and has no entry in the map); only strays, fields that
    belong to no file, are left out. The driver gets the distinct names of fields that belong to
    a file or are known, and the renames; more than :data:`MOST_NAMES` can't be columns and are an error.
    """
    concept = {_plain(n): c for c, names in aliases.items() for n in names}
    plain = F.regexp_replace(F.lower("field"), r"[^\p{L}\p{N}]", "")
    lasting = fields.where((F.col("n_carry") * CARRIED_ONE_IN >= F.col("n_records")) | plain.isin(*concept))
    seen = [r[0] for r in lasting.select("field").distinct().orderBy("field").limit(MOST_NAMES + 1).collect()]
    pairs = renames.where("change_kind = 'renamed'").select("old_field", "new_field").distinct().limit(MOST_NAMES + 1).collect() if renames is not None else []
    if max(len(seen), len(pairs)) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} distinct field names or renames")
    grown = True
    while grown:
        before = len(concept)
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if _plain(x) in concept:
                    concept.setdefault(_plain(y), concept[_plain(x)])
        grown = len(concept) > before
    wanted = {c: sorted((n for n in seen if concept.get(_plain(n)) == c), key=lambda n: (n != c, n)) for c in aliases}
    whole = F.try_variant_get("record", "$", "map<string,variant>")
    # A path can't hold every name.
    at = lambda n: F.try_variant_get("record", F.lit(f"$['{n}']"), "variant") if re.fullmatch(r"[^'\"\\?]+", n) else F.try_element_at(whole, F.lit(n))
    value = lambda n: _bound(F.to_json(at(n)), lambda v: F.when(v != "null", v))
    texts = {c: F.coalesce(*map(value, names), F.lit(None).cast("string")) for c, names in wanted.items()}
    others = [(F.lit(c), _bound(F.coalesce(*map(value, names)), _text)) for c, names in _others(fields, concept, pairs).items()]
    entries = F.map_from_entries(F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in others))) if others else F.create_map().cast("map<string,string>")
    return parsed.select("series", "file_no", *(_bound(t, CASTS[c]).alias(c) for c, t in texts.items()), F.map_filter(entries, lambda _, v: v.isNotNull()).alias("other_fields"))


def _others(fields: DataFrame, concept: dict[str, str], pairs: list) -> dict[str, list[str]]:
    """The fields that belong to a file and to no concept: the name each goes under, with its names in the order they count."""
    there = fields.where(F.col("n_carry") * CARRIED_ONE_IN >= F.col("n_records"))
    n = {r["field"]: r["n"] for r in there.groupBy("field").agg(F.sum("n_carry").alias("n")).collect() if _plain(r["field"]) not in concept or not _plain(r["field"])}
    root = {name: name for name in n}

    def top(name: str) -> str:
        while root[name] != name:
            name = root[name]
        return name

    spelled: dict[str, str] = {}
    for name in sorted(n):
        if _plain(name):
            root[top(name)] = top(spelled.setdefault(_plain(name), name))
    for a, b in pairs:
        if a in n and b in n:
            root[top(a)] = top(b)
    groups: dict[str, list[str]] = {}
    for name in sorted(n, key=lambda x: (-n[x], x)):
        groups.setdefault(top(name), []).append(name)
    several = [(name, g) for g, names in groups.items() if len(names) > 1 for name in names]
    if several:
        of = F.broadcast(fields.sparkSession.createDataFrame(several, "field string, _group string"))
        beside = there.join(of, "field").groupBy("series", "file_no", "_group").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        for r in beside.select("_group").distinct().collect():
            groups |= {f"{r[0]}/{name}": [name] for name in groups.pop(r[0])}
    return {names[0]: names for names in groups.values()}
