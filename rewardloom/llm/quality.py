"""Quality rules with adaptive thresholds (operator 3).

Every document gets measures of its words and lines. Per language and source a
quantile sketch of each measure is kept: counts per log-linear bucket (the value's
six leading bits), so a quantile is at most 1/32 too low, sketches merge by adding
counts, and the result doesn't depend on order or partitioning. Cutoffs come from
the sketches: the 90th percentile plus a multiple of its distance to the median.
A (language, source) of n documents takes its own cutoffs with weight n / (n + ``prior``) and its language's for the rest, which
takes over from all in the same way: small groups follow larger ones, and no size flips a cutoff. Documents are then joined with the
cutoffs of their group and filtered.

Only DataFrame functions are used. Defined results: NULL and empty texts have no words and fail the base
rules; NULL languages and sources are groups of their own; repeated rows are judged
each; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm.common import SPACE, column, let, table
from rewardloom.scratch import materialize

#: Characters that count as symbols, words per repeated window: fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Base rules: fewest words, and largest share of words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Measure -> (which tail is cut, least distance of the cutoff from the 90th (10th) percentile). Shares are per mille,
#: lengths thousandths of a character.
MEASURES = {
    "symbols": ("high", 40),
    "dup_lines": ("high", 300),
    "repeats": ("high", 200),
    "word_length": ("both", 1500),
}


@dataclass(frozen=True)
class Rules:
    """spread: how often the distance from the median to the 90th percentile is added to that; prior: how many documents the wider group's cutoffs count as."""

    spread: int = 3
    prior: int = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _repeated(words: Column) -> Column:
    """Words that lie in a window found twice or more."""
    # Without a second equal hash the sort is not needed.
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def same(s, x, i):
        other = F.get(s, i)
        return (x.h == other.h) & (F.slice(words, x.p + 1, WINDOW) == F.slice(words, other.p + 1, WINDOW))

    def positions(s):
        found = F.filter(s, lambda x, i: F.coalesce((i > 0) & same(s, x, i - 1), F.lit(False)) | F.coalesce(same(s, x, i + 1), F.lit(False)))
        return F.sort_array(F.transform(found, lambda x: x.p))

    def covered(p):
        parts = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1), x + WINDOW) - x))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(pairs, positions), covered)
        )

    return let(hashes, count).cast("long")


def measured(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` as ``row``, the group as ``lang`` and ``source``, and the measures."""
    text = F.coalesce(column(docs, text_col, "string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        column(docs, "lang", "string", needed=False).alias("lang"),
        column(docs, "source", "string", needed=False).alias("source"),
        text.alias("text"),
        words_of(text).alias("words"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "row",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^" + SYMBOLS + "]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )

    def share(part, whole):
        return F.expr(f"CASE WHEN {whole} > 0 THEN (1000 * {part}) div {whole} ELSE 0 END")

    return rows.select(
        "row", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.struct(
            share("n_symbols", "word_chars").alias("symbols"),
            share("CAST(lines.dup AS BIGINT)", "CAST(lines.n AS BIGINT)").alias("dup_lines"),
            share("n_repeat_words", "n_words").alias("repeats"),
            share("word_chars", "n_words").alias("word_length"),
        ).alias("measures"),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the quantile sketches of documents that pass the base rules.

    At most one row per task and bucket is shuffled, so a source that holds a third of all rows costs as much as any.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"measures.{m}").alias("v")) for m in MEASURES]))
    return (
        rows.where("NOT base_failed")
        .select("lang", "source", values.alias("x"))
        .select("lang", "source", "x.measure", F.expr("greatest(length(bin(x.v)) - 6, 0)").alias("low"), "x.v")
        .groupBy("lang", "source", "measure", F.expr("shiftleft(shiftright(v, low), low)").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def cutoffs(sketch: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, one struct lo, hi per measure), with what small groups take over."""
    groups = {"source": ["lang", "source"], "lang": ["lang"], "all": []}
    bounds = {}
    for level, keys in groups.items():
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        names = ", ".join([*keys, "measure"])
        ranked = merged.selectExpr(
            "*",
            f"sum(n) OVER (PARTITION BY {names} ORDER BY bucket) AS upto",
            f"sum(n) OVER (PARTITION BY {names}) AS total",
        )
        at = {q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket"))) for q in (10, 50, 90)}
        quantiles = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *[x.alias(f"q{q}") for q, x in at.items()])
        fences = []
        for name, (tail, least) in MEASURES.items():
            high = F.expr(f"q90 + greatest({rules.spread} * (q90 - q50), {least})")
            # No measure is below 0.
            low = F.expr(f"greatest(q10 - greatest({rules.spread} * (q50 - q10), {least}), 0)")
            of = lambda x: F.max(F.when(F.col("measure") == name, x))  # noqa: B023, E731
            fences += [of(high).alias(f"{name}_hi"), (of(low) if tail == "both" else F.lit(None).cast("long")).alias(f"{name}_lo")]
        bounds[level] = quantiles.groupBy(*keys).agg(F.max("total").alias("rows"), *fences)
    own, lang, all_ = (bounds[k].alias(k) for k in groups)
    joined = own.join(lang, F.col("source.lang").eqNullSafe(F.col("lang.lang")), "left").join(all_, F.lit(True), "left")
    limits = []
    for name in MEASURES:
        for side in ("hi", "lo"):
            c = f"{name}_{side}"
            wider = f"(lang.rows * lang.{c} + {rules.prior} * all.{c}) div (lang.rows + {rules.prior})"
            limits.append(F.expr(f"(source.rows * source.{c} + {rules.prior} * ({wider})) div (source.rows + {rules.prior})").alias(c))
    return joined.select(F.col("source.lang").alias("g_lang"), F.col("source.source").alias("g_source"), *limits)


def judged(docs: DataFrame, rules: Rules = Rules(), *keep: str, text_col: str = "text") -> DataFrame:
    """``row`` (the columns ``keep``, or all), the measures, ``base_failed`` and ``kept``."""
    rows = materialize(measured(docs, *keep, text_col=text_col), "measures")
    limits = cutoffs(materialize(sketches(rows), "sketches"), rules)
    match = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    inside = F.lit(True)
    for name in MEASURES:
        value = F.col(f"measures.{name}")
        inside &= F.coalesce(value <= F.col(f"{name}_hi"), F.lit(True)) & F.coalesce(value >= F.col(f"{name}_lo"), F.lit(True))
    return rows.join(limits, match, "left").withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the measures and the verdict of every document."""
    found = judged(table(spark, sf_dir, "documents"), Rules(), "doc_id")
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents the rules keep, with their columns."""
    return judged(docs, rules).where("kept").select("row.*")


def _oracle() -> str:
    blank = r"[\x20\x09-\x0D]"
    levels, picks = [], []
    for level, keys in (("own", "lang, source, "), ("lang", "lang, "), ("all", "")):
        fences = []
        for name, (tail, least) in MEASURES.items():
            fences.append(f"max(CASE WHEN measure = '{name}' THEN q90 + greatest(3 * (q90 - q50), {least}) END) AS {name}_hi")
            low = f"max(CASE WHEN measure = '{name}' THEN greatest(q10 - greatest(3 * (q50 - q10), {least}), 0) END)" if tail == "both" else "NULL::BIGINT"
            fences.append(f"{low} AS {name}_lo")
        tidy = keys.rstrip(", ")
        levels.append(f"""
l_{level} AS (SELECT {keys}max(total) AS n_rows, {', '.join(fences)} FROM (
  SELECT {keys}measure, max(total) AS total, {', '.join(f'min(CASE WHEN 100 * upto >= {q} * total THEN bucket END) AS q{q}' for q in (10, 50, 90))} FROM (
    SELECT {keys}measure, bucket, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
    FROM (SELECT {keys}measure, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}measure) {f'GROUP BY {tidy}' if tidy else ''})""")
    tests = []
    for name in MEASURES:
        for side, op in (("hi", "<="), ("lo", ">=")):
            c = f"{name}_{side}"
            pick = f"(o.n_rows * o.{c} + 50 * ((l.n_rows * l.{c} + 50 * a.{c}) // (l.n_rows + 50))) // (o.n_rows + 50)"
            tests.append(f"coalesce(m.{name} {op} ({pick}), true)")
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed" for m in MEASURES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM w) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt, i + 8) - i))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
ln AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT d.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(ln.n, 0)::BIGINT AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length FROM b),
sketch AS (SELECT lang, source, measure, (v >> k) << k AS bucket, count(*) AS n FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS k FROM ({values})) GROUP BY ALL),{','.join(levels)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept
FROM m LEFT JOIN l_own o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
LEFT JOIN l_lang l ON m.lang IS NOT DISTINCT FROM l.lang LEFT JOIN l_all a ON true"""


QUERIES = {"op3_quality_rules": quality_rules}
ORACLES = {"op3_quality_rules": _oracle()}
