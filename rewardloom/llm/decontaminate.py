"""Benchmark decontamination by SimHash (operator 9).

A document's words slide past in windows as long as each benchmark item; a document
shorter than an item is one window itself. Windows
that share no shingle with an item can't be alike and are left out first, which
loses nothing. The SimHash over weighted shingles of the others is looked up among
the items': the 64 bits fall into four blocks, and fingerprints within ``RADIUS`` bits
differ in at most a fourth of them in some block, so the indexes over
each block's neighbourhood find every fingerprint within the radius. What is found is verified by the
exact weighted Jaccard similarity. A shingle has five words and weighs its count times its letters.

The benchmark is read in slices of at most ``SLICE_CHARS`` characters, each broadcast
by itself, and documents pass once per slice: memory stays bounded for any
benchmark. Documents are never shuffled.

Words are runs of letters and digits, lower-cased. Defined results: NULL and empty
texts and items have no words and match nothing; items of fewer than five words
have one shingle of all their words; repeated rows are judged each; of equally
similar windows the first is reported; empty tables give an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rewardloom.llm.common import table

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of the fingerprint, its blocks, and the distance within which every fingerprint is found. Shingles that are 0.8
#: alike differ in 10 bits on average, with a deviation of 3.
BITS, BLOCKS, RADIUS = 64, 4, 19
SLICE_CHARS = 1_000_000

WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingles_of(words: list[str], size: int = SHINGLE) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def weight(shingle: tuple[str, ...]) -> int:
    return sum(map(len, shingle))


def similarity(one: Counter, other: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum(weight(s) * min(n, other[s]) for s, n in one.items() if s in other)
    either = sum(weight(s) * n for s, n in one.items()) + sum(weight(s) * n for s, n in other.items()) - both
    return both / either if either else 0.0


class Items:
    """A slice of the benchmark with its indexes."""

    def __init__(self, items: list[tuple[int, str]]):
        import numpy as np

        self.ids, self.sizes, self.bags = [], [], []
        #: Shingle -> items that have it.
        self.having: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, text in items:
            if words := words_of(text):
                bag = Counter(shingles_of(words))
                for shingle in bag:
                    self.having[shingle].append(len(self.ids))
                self.ids.append(item)
                self.sizes.append(len(words))
                self.bags.append(bag)
        self.firsts, self.lasts = {s[0] for s in self.having}, {s[-1] for s in self.having}
        self.lengths = sorted({len(s) for s in self.having}, reverse=True)
        bags = [list(b.elements()) for b in self.bags]
        self.prints = np.array([self.fingerprints(b, len(b))[0] for b in bags], dtype=np.uint64)
        self.width = BITS // BLOCKS
        masks = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(self.width), k)]
        self.index = []
        for block in range(BLOCKS):
            values = self.prints >> np.uint64(block * self.width) & np.uint64((1 << self.width) - 1)
            near = (values[:, None] ^ np.array(masks, dtype=np.uint64)[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            starts = np.searchsorted(near[order], np.arange((1 << self.width) + 1, dtype=np.uint64))
            self.index.append((starts, (order // len(masks)).astype(np.int32)))

    @staticmethod
    def fingerprints(shingles: list[tuple[str, ...]], size: int):
        """The SimHash of every run of ``size`` shingles."""
        import numpy as np
        import xxhash

        bits = np.array([xxhash.xxh64_intdigest("\x1f".join(s)) for s in shingles], dtype=np.uint64)
        signs = (bits[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.zeros((len(shingles) + 1, BITS), dtype=np.int64)
        np.cumsum(signs * np.array([weight(s) for s in shingles])[:, None], axis=0, out=sums[1:])
        ones = sums[size:] - sums[:-size] > 0
        return (ones.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def near(self, fingerprint: int) -> set[int]:
        """Every item whose fingerprint is within the radius."""
        import numpy as np

        found = set()
        for block, (starts, items) in enumerate(self.index):
            value = fingerprint >> block * self.width & (1 << self.width) - 1
            found.update(items[starts[value] : starts[value + 1]].tolist())
        return {i for i in found if (int(self.prints[i]) ^ fingerprint).bit_count() <= RADIUS} if found else found

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window per item, by item id."""
        words = words_of(text)
        # Places of shingles that some item has.
        places: dict[int, list[int]] = defaultdict(list)
        for length in self.lengths:
            ends = words[length - 1 :]
            for i, (first, last) in enumerate(zip(words, ends, strict=False)):
                if first in self.firsts and last in self.lasts:
                    for item in self.having.get(tuple(words[i : i + length]), ()):
                        places[item].append(i)
        # Starts of windows that hold such a place, by the windows' size.
        starts: dict[int, set[int]] = defaultdict(set)
        for item, at in places.items():
            size = min(self.sizes[item], len(words))
            length = min(SHINGLE, size)
            last = len(words) - size
            for i in at:
                starts[size].update(range(max(0, i - size + length), min(i, last) + 1))
        best: dict[int, tuple[float, int]] = {}
        for size, at in starts.items():
            ordered = sorted(at)
            runs, begin = [], 0
            for k in range(1, len(ordered) + 1):
                if k == len(ordered) or ordered[k] != ordered[k - 1] + 1:
                    runs.append((ordered[begin], ordered[k - 1]))
                    begin = k
            count = max(1, size - SHINGLE + 1)
            for low, high in runs:
                shingles = shingles_of(words[low : high + size], min(SHINGLE, size))
                for k, fingerprint in enumerate(self.fingerprints(shingles, count).tolist()):
                    for item in self.near(fingerprint):
                        if min(self.sizes[item], len(words)) == size:
                            alike = similarity(self.bags[item], Counter(shingles[k : k + count]))
                            if alike >= SIMILARITY and (-alike, low + k) < best.get(item, (0.0, 0)):
                                best[item] = (-alike, low + k)
        found = [(self.ids[i], -alike, start, min(self.sizes[i], len(words))) for i, (alike, start) in best.items()]
        return sorted(found)


_SLICES: dict[int, Items] = {}


def _items(broadcast) -> Items:
    """The indexes of a slice, built once per worker; only the last slice's are kept."""
    if broadcast.id not in _SLICES:
        _SLICES.clear()
        _SLICES[broadcast.id] = Items(broadcast.value)
    return _SLICES[broadcast.id]


class _Slice:
    """A broadcast slice that knows its own number in the workers."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], number: str):
        self.broadcast, self.id = spark.sparkContext.broadcast(items), number

    @property
    def value(self):
        return self.broadcast.value


def read_slices(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[_Slice]:
    """The benchmark's items, a bounded slice at a time."""
    import uuid

    rows, chars = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        text = row[1] or ""
        if rows and chars + len(text) > SLICE_CHARS:
            yield _Slice(benchmark.sparkSession, rows, uuid.uuid4().hex)
            rows, chars = [], 0
        rows.append((row[0], text))
        chars += len(text)
    if rows:
        yield _Slice(benchmark.sparkSession, rows, uuid.uuid4().hex)


#: What a match adds to a document's columns.
MATCH = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)


def leaks(docs: DataFrame, benchmark: DataFrame, *keep: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, item_id, similarity, first_word, n_words): documents with a passage like a benchmark item; ``row`` has the columns ``keep``."""
    from pyspark.sql import functions as F

    found = None
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([source.schema["row"], *MATCH.fields])
    for piece in read_slices(benchmark, item_col, item_text):

        def run(batches, piece=piece):
            import pyarrow as pa

            items = _items(piece)
            for batch in batches:
                found = [(k, *m) for k, t in enumerate(batch.column(1).to_pylist()) for m in items.matches(t)]
                if found:
                    at, *rest = zip(*found, strict=True)
                    kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32())
                    columns = [batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]]
                    yield pa.RecordBatch.from_arrays(columns, ["row", *MATCH.names])

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a passage like a benchmark item."""
    at = docs.columns.index(text_col)
    for piece in read_slices(benchmark, item_col, item_text):

        def run(batches, piece=piece):
            import pyarrow as pa

            items = _items(piece)
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document and benchmark item that it has a passage of."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return found.select("row.doc_id", "item_id", "similarity", "first_word", "n_words")


QUERIES = {"op9_benchmark_leaks": benchmark_leaks}
#: Every window of an item's size, or the whole of a shorter document, that shares a shingle with it, by brute force.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT bid, len(w) AS size, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS x FROM b),
bag AS (SELECT bid, size, x, count(*) AS n, length(replace(any_value(x), ' ', '')) AS wt FROM bs GROUP BY bid, size, x),
bw AS (SELECT bid, sum(n * wt) AS total FROM bag GROUP BY bid),
ds AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
hit AS (SELECT DISTINCT ds.rid, bag.bid, bag.size, ds.i FROM ds JOIN bag USING (x) WHERE bag.size >= 5),
win AS (SELECT DISTINCT rid, bid, least(size, len(w)) AS size, unnest(range(greatest(1, i - size + 5), greatest(1, least(i, len(w) - size + 1)) + 1)) AS s FROM hit JOIN d USING (rid)),
ws AS (SELECT rid, bid, s, x, count(*) AS n, length(replace(any_value(x), ' ', '')) AS wt FROM (
    SELECT win.rid, bid, s, array_to_string(w[s + o:s + o + 4], ' ') AS x FROM (SELECT *, unnest(range(0, size - 4)) AS o FROM win) win JOIN d ON d.rid = win.rid) GROUP BY rid, bid, s, x),
sim AS (SELECT rid, ws.bid, s, sum(ws.wt * least(ws.n, coalesce(bag.n, 0))) AS same, sum(ws.wt * ws.n) AS total FROM ws LEFT JOIN bag ON bag.bid = ws.bid AND bag.x = ws.x GROUP BY rid, ws.bid, s),
best AS (SELECT rid, bid, s, same::DOUBLE / (sim.total + bw.total - same)::DOUBLE AS similarity FROM sim JOIN bw USING (bid)
    QUALIFY row_number() OVER (PARTITION BY rid, bid ORDER BY same::DOUBLE / (sim.total + bw.total - same)::DOUBLE DESC, s) = 1)
SELECT doc_id, item_id, similarity, (s - 1)::INTEGER AS first_word, least(len(b.w), len(d.w))::INTEGER AS n_words FROM best JOIN d USING (rid) JOIN b USING (bid) WHERE similarity >= 0.8"""

ORACLES = {"op9_benchmark_leaks": ORACLE}
