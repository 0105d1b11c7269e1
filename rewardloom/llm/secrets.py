"""Secret scans with multipart credential linking (operator 8).

Three kinds are reported wherever they stand: assignments, access identifiers and
hex runs. Weaker parts (identifiers, short or unnamed secrets, endpoints) are
reported only if a part of a complementary class lies in the same scope: within
``SCOPE`` code points. A secret needs an identifier or an endpoint, and each of these a secret.

Spans come from Spark's own regex functions: the lengths of what a pattern splits
off and of what it matches add up to positions. The link is an interval join:
parts fall into bins as wide as a scope, bins keep the least start and the
greatest end per class, and a weak part meets the few bins its scope touches. So
nothing pairs all parts with each other, in however long a text.

Only DataFrame functions are used. Defined results: NULL and empty texts have no spans; rows are judged each, repeated ones and NULL
identifiers too; texts are scanned whole; an empty table gives an empty result;
other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm.common import column, named, table
from rewardloom.scratch import materialize

#: Patterns of the base kinds, in their order; least length and the group it is of: fixed values.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Weak kinds: pattern, group whose length counts, its least length, and a cheap pattern without which there is no match.
WEAK = {
    "identifier": (r"""(?i:\b(?:user(?:name|_?id)?|login|client_?id|account_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 1, 3),
    "short_access": (r"AKIA[A-Z0-9]+", 0, 8),
    "short_assign": (BASE["assign"][0], 2, 6),
    "short_hex": (r"\b[0-9a-f]{12,15}\b", 0, 12),
    "endpoint": (r"""(?i:\bhttps?://[A-Za-z0-9.-]+(?::[0-9]+)?|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})""", 0, 8),
}
#: Class of every kind.
CLASSES = {
    "assign": "secret", "access": "id", "hex": "secret",
    "identifier": "id", "short_access": "id", "short_assign": "secret", "short_hex": "secret", "endpoint": "endpoint",
}
KINDS = list(CLASSES)
#: Code points between linked parts.
SCOPE = 200

SPAN = "struct<start:int,end:int,rank:int>"


def _found(text: Column, kind: str, pattern: str, group: int, least: int, below: int | None = None) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose group has ``least`` characters or more, and under ``below``."""
    regex = F.lit(pattern)
    rest = F.split(text, pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    part = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
    none = F.array().cast(f"array<{SPAN}>")

    def step(state, x):
        start = state.at + F.length(x.rest)
        end = start + F.length(x.whole)
        size = F.length(x.part)
        keep = size >= least
        if below:
            keep = keep & (size < below)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans"))

    parts = F.arrays_zip(rest.alias("rest"), whole.alias("whole"), part.alias("part"))
    # One more piece than matches: the last has no match.
    steps = F.filter(parts, lambda x: x.whole.isNotNull())
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda s: s.spans)).otherwise(none)


def scanned(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """(rid, row, base, weak): ``row`` holds the columns ``keep`` or all, the others sorted spans. Written, so that ``rid`` stays."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.coalesce(column(docs, text_col, "string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    base = F.concat(*[_found(text, kind, p, g, n) for kind, (p, g, n) in BASE.items()])
    limits = {"short_access": BASE["access"][2], "short_assign": BASE["assign"][2]}
    weak = F.concat(*[_found(text, kind, p, g, n, limits.get(kind)) for kind, (p, g, n) in WEAK.items()])
    return materialize(
        rows.select(F.monotonically_increasing_id().alias("rid"), "row", F.sort_array(base).alias("base"), F.sort_array(weak).alias("weak")),
        "spans",
    )


def linked(scan: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, added): the weak spans of each row that have a complement within ``scope``."""
    classes = F.array(*[F.lit(CLASSES[k]) for k in KINDS])
    several = scan.where("size(weak) > 0 AND size(weak) + size(base) > 1")
    parts = several.select("rid", F.explode(F.concat(F.transform("base", lambda x: F.struct(x.alias("s"), F.lit(False).alias("weak"))), F.transform("weak", lambda x: F.struct(x.alias("s"), F.lit(True).alias("weak"))))).alias("x"))
    parts = parts.select("rid", "x.s", "x.weak", "x.s.start", "x.s.end", F.get(classes, F.col("x.s.rank")).alias("class"))
    bins = (
        parts.select("rid", "class", "start", "end", F.explode(F.expr(f"sequence(start div {scope}, end div {scope})")).alias("bin"))
        .groupBy("rid", "bin", F.when(F.col("class") == "secret", "secret").otherwise("other").alias("side"))
        .agg(F.min("start").alias("least"), F.max("end").alias("most"))
    )
    asks = parts.where("weak").select(
        "rid", "s", "start", "end",
        F.when(F.col("class") == "secret", "other").otherwise("secret").alias("side"),
        F.explode(F.expr(f"sequence(greatest(start - {scope}, 0) div {scope}, (end + {scope}) div {scope})")).alias("bin"),
    )
    met = asks.join(bins, ["rid", "bin", "side"]).where(f"most >= start - {scope} AND least <= end + {scope}")
    return met.select("rid", "s").distinct().groupBy("rid").agg(F.collect_list("s").alias("added"))


def scan(docs: DataFrame, *keep: str, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(row, base, spans): the base spans and all spans, as sorted arrays of (start, end, rank); ``KINDS[rank]`` is the kind."""
    rows = scanned(docs, *keep, text_col=text_col)
    none = F.array().cast(f"array<{SPAN}>")
    found = rows.select("rid", "row", "base").join(linked(rows, scope), "rid", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("added", none)))
    return found.select("row", "base", F.transform(spans, lambda x: x).alias("spans"))


def _order(spans: Column) -> Column:
    """By start, then kind."""
    return F.transform(
        F.sort_array(F.transform(spans, lambda x: F.struct(x.start, x.rank, x.end))), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x["rank"].alias("rank"))
    )


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(_order(spans), lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x.start, x.end)), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced by ``mark``; overlapping spans by one."""
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))

    def step(state, x):
        before = F.when(x.start >= state.at, F.concat(F.substr(text, state.at + 1, x.start - state.at), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state.at, x.end).alias("at"), F.concat(state.text, before).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    new = F.aggregate("spans", start, step, lambda s: F.concat(s.text, F.substr(text, s.at + 1)))
    changed = F.when(F.size("spans") > 0, new).otherwise(F.col(f"row.`{text_col}`"))
    return scan(docs, text_col=text_col, scope=scope).select(
        *[(changed if c == named(docs, text_col) else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: counts and spans of every document."""
    found = scan(table(spark, sf_dir, "documents"), "doc_id")
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == KINDS.index(kind))).cast("long")
    return found.select(
        "row.doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


QUERIES = {"op8_secret_scans": secret_scans}


def _oracle() -> str:
    finds = []
    limits = {"short_access": BASE["access"][2], "short_assign": BASE["assign"][2]}
    for rank, (kind, (pattern, group, least)) in enumerate([*BASE.items(), *WEAK.items()]):
        p = pattern.replace("'", "''")
        below = f" AND length(g) < {limits[kind]}" if kind in limits else ""
        finds.append(
            f"SELECT rid, before + rest AS s, before + rest + length(m) AS e, {rank} AS rank, {str(kind in WEAK).lower()} AS weak, '{CLASSES[kind]}' = 'secret' AS secret FROM ("
            "SELECT *, coalesce(sum(rest + length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ("
            "SELECT rid, i, length(rests[i]) AS rest, ms[i] AS m, gs[i] AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT rid, string_split_regex(text, '{p}') AS rests, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS gs FROM d)))) WHERE length(g) >= {least}{below}"
        )
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    written = f"string_agg(([{kinds}])[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(finds)}),
base AS (SELECT rid, {', '.join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k}" for i, k in enumerate(BASE))}, {written} AS w FROM f WHERE NOT weak GROUP BY rid),
found AS (SELECT rid, {written} AS w FROM f WHERE NOT weak OR EXISTS (SELECT 1 FROM f o WHERE o.rid = f.rid AND o.secret <> f.secret
    AND greatest(o.s - f.e, f.s - o.e) <= {SCOPE}) GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base.w, '')) AS base_sha256, coalesce(found.w, '') AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""


ORACLES = {"op8_secret_scans": _oracle()}
