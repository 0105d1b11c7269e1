"""N-gram Jaccard join by signature trees (operator 4).

Two documents link when the Jaccard similarity of their sets of shingles of ``words``
words is ``percent`` or more (three words and 90 unless the caller names others). No component loses a link that it needs:

1. Equal sets are one class from here on, however many documents share it.
2. Linked sets share a shingle of their prefixes: the first n - ceil(n percent / 100) + 1
   shingles in a global order. The order puts a fifth of all hashes first (a fourth below 90 percent), rare ones
   before frequent ones, so a prefix is mostly shingles of no other document, which are dropped at once.
3. Each (shingle, size band) cell verifies its classes against one centre, the class with most copies, and verified
   links are merged to components. A family of near copies is settled here with one check per member.
4. Cells that still hold several components go through signature trees. Cells that share a component are one family; a family of a bounded number of
   classes and shingles is one task, so that a class in very many cells is looked at once. Larger families go cell by cell: a cell's classes are dealt to blocks of
   the same bounds, and blocks are paired unless their sizes or a common component rule links out. A task numbers the shingles that two of its
   classes share, and so has bitmaps without collisions, however large the sets. A tree's node has the OR of its members'
   bitmaps, their range of sizes and their components; two trees are traversed together, and pairs of nodes are dropped by
   size, by maximum possible overlap, or because all is one component.
5. The first traversal has bitmaps of these first hashes only: the others can add no more than the smaller set has. It says which classes
   have a partner left, no more than one row a class; a pair counts in one of the cells it shares only, the largest, as far as a bounded list tells. The second has these classes' texts: at its leaves the bitmaps give the intersection
   itself, so pairs are verified where they are found and merged there. A task returns
   at most one link per class, never its candidates. Components are merged once more.

Blocks hold a bounded number of classes, so no group meets in one task.

``components`` and ``one_of_each`` verify no pair that is in one component already. ``links`` returns every
link between different sets with the rows of each set: steps 3 and the pruning by component in 4 and 5 are left out. ``link_counts``
adds their number per row.

Words are runs without white space, A-Z lower-cased; a text of fewer words than a shingle
has one shingle. Defined results: NULL and empty texts have no shingles and
link with nothing; equal texts link with each other; repeated rows get the same
component; a NULL doc_id never names a component unless all its documents have none; an
empty table gives an empty result; other columns are ignored or, in ``one_of_each``, pass through.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import WORDS_SQL, smallest_labels, table
from rewardloom.scratch import discard, materialize

#: Words of a shingle and the similarity in percent, where the caller names no others.
WORDS, PERCENT = 3, 90
#: One in so many hashes comes first in the order of shingles: ``percent`` from which this holds -> number. Prefixes of 80 percent are a fifth of all hashes; of a
#: fourth they leave out the most frequent ones, so that passages of many documents make no cells.
FIRST = {90: 5, 0: 4}
#: Most classes and shingles of a block, about; classes of a leaf; children of a tree's node.
BLOCK, BLOCK_SHINGLES, LEAF, FANOUT = 512, 1_000_000, 16, 8
#: Rows of blocks that a task traverses.
ROWS_PER_TASK = 2_000
#: How often all texts, or all their first hashes, may be shuffled at once: a class in many cells is needed in many tasks, and more of them than that go
#: in rounds, whose shuffles are deleted.
TEXTS_PER_ROUND, FIRSTS_PER_ROUND = 1, 4
#: Cells that a class's row of a cell names, of those that come before it in the order of cells.
BEFORE = 32
#: Rows that a round has at least.
ROUND_ROWS = 200_000
#: Bits of a bitmap of keys for each key, most bits of one, and bits of Spark's own bitmaps, of which it is made.
KEY_BITS, MOST_BITS, PIECE_BITS = 16, 1 << 26, 1 << 15


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes_of(words: list[bytes], size: int = WORDS):
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words."""
    import numpy as np
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    x = h[:n].copy()
    for k in range(1, size):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += h[k : k + n]
    # Mixed so that every bit depends on all words.
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def first_of(percent: int = PERCENT) -> int:
    """One in so many hashes comes first."""
    return next(k for least, k in sorted(FIRST.items(), reverse=True) if percent >= least)


SETS = "n long, digest binary, first array<long>, rest array<long>"


def shingle_sets(docs: DataFrame, doc_id: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, a hash of the text, the set's size and digest, and the prefix's possible shingles."""
    one_in = first_of(percent)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                x = hashes_of(words_of(t), words)
                n = len(x)
                early = x % np.uint64(one_in) == 0
                first, need = x[early], prefix_length(n, percent) if n else 0
                rest = x[~early][: max(0, need - len(first))]
                out.append((n, xxhash.xxh3_128_digest(x.tobytes()), first.view(np.int64), rest.view(np.int64)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_hash", "n", "digest", "first", "rest"])

    rows = docs.select(*_row_key(doc_id, text), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, row_hash long, {SETS}")


def _row_key(doc_id: str, text: str):
    """What tells rows apart: identifier and text."""
    return F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("row_hash")


def near_texts(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(cid, n, first, words) of ``classes`` (cid, n, rep, digest): the hashes that come first, as 32 bits of each, and the words of their smallest doc_id's text, compressed.

    Compressed words take a third of the bytes of their hashes, and these are made again where they are compared.
    """
    one_in = first_of(percent)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out = []
            for cid, n, digest, t in zip(*[batch.column(c).to_pylist() for c in ("cid", "n", "digest", "text")], strict=True):
                found = words_of(t)
                x = hashes_of(found, words)
                # Rows of one identifier may have different texts.
                if xxhash.xxh3_128_digest(x.tobytes()) == digest:
                    # Hashes of one set with the same 32 bits count among the others.
                    first = np.unique((x[x % np.uint64(one_in) == 0] // np.uint64(one_in)).astype(np.uint32))
                    out.append((cid, n, first.tobytes(), packed(found)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cid", "n", "first", "words"])

    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = texts.alias("t").join(classes.alias("c"), F.expr("t.rep <=> c.rep")).select("c.cid", "c.n", "c.digest", "t.text")
    return wanted.mapInArrow(run, "cid long, n long, first binary, words binary")


def packed(words: list[bytes]) -> bytes:
    import pyarrow as pa

    joined = b" ".join(words)
    return len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[bytes]:
    import pyarrow as pa

    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).split()


def prefixes(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cid, n, copies, token): the shingles of each class's prefix that another class has in its own."""
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    # Only what the joins on shingles need is shuffled with them.
    rows = classes.select("cid", F.explode(F.concat(F.transform("first", lambda x: F.struct(x.alias("token"), F.lit(False).alias("late"))), F.transform("rest", lambda x: F.struct(x.alias("token"), F.lit(True).alias("late"))))).alias("x"))
    rows = rows.select("cid", "x.token", "x.late")
    common = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    hits = rows.join(common, "token").join(classes.select("cid", "n", "copies", F.size("first").alias("ns"), length.alias("p")), "cid")
    ranked = hits.selectExpr(
        "*",
        "ns - count_if(NOT late) OVER (PARTITION BY cid) AS alone",
        "row_number() OVER (PARTITION BY cid ORDER BY late, df, token) AS place",
    )
    # Shingles of no other class come before all these.
    found = ranked.where("late OR ns < p OR place <= p - alone").select("cid", "n", "copies", "token")
    shared = found.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    return found.join(shared, "token")


def _band(n: str = "n", percent: int = PERCENT):
    """Sizes whose sets can link lie in the same or in neighbouring bands."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9)).cast("int")


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection. Texts are joined, so a frequent class is split like any skewed join."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, right = None, None
        for batch in batches:
            found = []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "wa", "wb")], strict=True):
                if b != last:
                    last, right = b, hashes_of(unpacked(y), words)
                left = hashes_of(unpacked(x), words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    found.append((a, b))
            columns = list(zip(*found, strict=True)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    left = texts.select(F.col("cid").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("cid").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long").distinct()


def star_pairs(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every class of a (token, band) with the band's centre, and centres of neighbouring bands: pairs grow with the rows.

    The centre has most copies: near copies are mostly made from a text that is copied as it is too.
    """
    most = F.max(F.struct("copies", (-F.col("n")).alias("less"), (-F.col("cid")).alias("first")))
    centres = cells.groupBy("token", "band").agg(most.alias("c")).select("token", "band", F.struct((-F.col("c.less")).alias("n"), (-F.col("c.first")).alias("cid")).alias("c"))
    centres = materialize(centres, "centres")
    own = cells.join(centres, ["token", "band"]).select(F.col("cid").alias("a"), F.col("c.cid").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb"))
    up = centres.select("token", (F.col("band") + 1).alias("band"), F.col("c").alias("d"))
    across = centres.join(up, ["token", "band"]).select(F.col("c.cid").alias("a"), F.col("d.cid").alias("b"), F.col("c.n").alias("na"), F.col("d.n").alias("nb"))
    pairs = own.unionByName(across).where(f"a <> b AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_cells(cells: DataFrame) -> DataFrame:
    """Members of the cells (a token and two neighbouring bands) with several components, each set of members once."""
    wide = cells.withColumn("cell", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    summary = wide.groupBy("token", "cell").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("members"),
        F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(xxhash64(cid, 1))").alias("x"),
    ).where("c0 <> c1")
    once = summary.groupBy("members", "s", "x").agg(F.min(F.struct("token", "cell", "c0")).alias("k")).select("k.token", "k.cell", "k.c0", F.col("members").alias("size"))
    # Written, so that a large cell's rows are split in the join.
    return wide.join(materialize(once, "open"), ["token", "cell"]).select(F.struct("token", "cell").alias("cell"), "size", "c0", "cid", "comp", "n")


def families(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (task, side, cid, comp) of families that fit a task, and ``members`` of the others' cells.

    Components are of one family where a chain of cells connects them.
    """
    labels = smallest_labels(members.select(F.col("c0").alias("a"), F.col("comp").alias("b")))
    labels = materialize(labels.select(F.col("node").alias("comp"), F.col("label").alias("family")), "families")
    # A class is in as many cells as it has prefix shingles; here it counts once.
    classes = members.select("cid", "comp", "n").distinct().join(labels, "comp")
    classes = materialize(classes, "classes")
    sizes = classes.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    sizes = materialize(sizes.select("family", F.expr(f"k <= {BLOCK} AND shingles <= {BLOCK_SHINGLES}").alias("fits")), "sizes")
    small = classes.join(sizes.where("fits"), "family").select(F.xxhash64(F.lit("family"), "family").alias("task"), F.lit(0).alias("side"), "cid", "comp")
    large = labels.join(sizes.where("NOT fits"), "family").select("comp")
    return small, members.join(materialize(large, "large"), "comp", "left_semi").select("cell", "size", "cid", "comp", "n")


def blocks(members: DataFrame) -> DataFrame:
    """``members`` with their block: large components have blocks of their own, the others share some.

    ``before`` names cells of the class that come before this one, large cells first. A pair that meets in one of these is not looked at here; the first
    cell that two classes share has none, so no pair is lost.
    """
    sizes = members.groupBy("cell", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("own", F.when((F.col("k") >= BLOCK) | (F.col("shingles") >= BLOCK_SHINGLES), F.col("comp")).otherwise(-1))
    shares = sizes.groupBy("cell", "own").agg(F.expr(f"greatest((sum(k) + {BLOCK - 1}) div {BLOCK}, (sum(shingles) + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES})").alias("shares"))
    # Written, so that a cell with very many components is split in the join.
    sizes, shares = materialize(sizes, "sizes"), materialize(shares, "shares")
    dealt = materialize(sizes.join(shares, ["cell", "own"]).select("cell", "comp", "own", "shares"), "dealt")
    block = F.struct("own", F.expr("pmod(xxhash64(cid), shares)").alias("i"))
    earlier = Window.partitionBy("cid").orderBy(F.desc("size"), "cell").rowsBetween(-BEFORE, -1)
    members = members.withColumn("before", F.collect_list(F.xxhash64("cell")).over(earlier))
    return members.join(dealt, ["cell", "comp"]).select("cell", "cid", "comp", "n", "before", block.alias("block"))


def node_pairs(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cell, one, two): pairs of blocks whose sizes and components allow a link between components."""
    nodes = members.groupBy("cell", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    one, two = nodes.alias("p"), nodes.alias("q")
    return one.join(two, F.expr("p.cell = q.cell AND p.block <= q.block")).where(
        f"NOT (p.c0 = q.c1 AND p.c1 = q.c0 AND p.c0 = p.c1) AND 100 * p.n1 >= {percent} * q.n0 AND 100 * q.n1 >= {percent} * p.n0"
    ).selectExpr("p.cell", "p.block AS one", "q.block AS two")


def bitmaps(sets):
    """Exact bitmaps of sets of hashes, one bit for each hash that at least two of them have."""
    import numpy as np

    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    width = int(shared.sum()) // 64 + 1
    bits = np.zeros((len(sets), width), np.uint64)
    at = place[inverse[keep]]
    np.bitwise_or.at(bits, (owner[keep], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


class Node:
    """A node of a signature tree over rows ``at`` of a block's arrays."""

    __slots__ = ("at", "bits", "children", "comps", "high", "low", "rest")

    def __init__(self, at, bits, n, rest, comp, children=()):
        import numpy as np

        self.at, self.children = at, children
        self.bits = np.bitwise_or.reduce([c.bits for c in children]) if children else np.bitwise_or.reduce(bits[at])
        self.low, self.high = int(n[at].min()), int(n[at].max())
        self.rest = int(rest[at].max())
        self.comps = int(comp[at].min()), int(comp[at].max())


def tree(at, bits, n, rest, comp) -> Node:
    """A tree over the rows ``at`` in order of component, size and bitmap, so that near ones share nodes.

    ``n``: sizes; ``rest``: how many of a set's shingles the bitmaps leave out.
    """
    import numpy as np

    # Where every class is a component of its own, these say nothing of nearness.
    alone = len(np.unique(comp[at])) == len(at)
    order = at[np.lexsort((bits[at, 0], n[at]) if alone else (bits[at, 0], n[at], comp[at]))]
    level = [Node(order[i : i + LEAF], bits, n, rest, comp) for i in range(0, len(order), LEAF)]
    while len(level) > 1:
        groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
        level = [Node(np.concatenate([c.at for c in g]), bits, n, rest, comp, g) for g in groups]
    return level[0]


def may_link(one: Node, two: Node, percent: int = PERCENT) -> bool:
    """Whether members of two nodes may link across components."""
    import numpy as np

    if one.comps == two.comps and one.comps[0] == one.comps[1]:
        return False
    if 100 * one.high < percent * two.low or 100 * two.high < percent * one.low:
        return False
    overlap = int(np.bitwise_count(one.bits & two.bits).sum()) + min(one.rest, two.rest)
    return (100 + percent) * overlap >= percent * (one.low + two.low)


class Merged:
    """Components of a task's classes, merged as links are found."""

    def __init__(self, comp):
        import numpy as np

        self.label = np.unique(comp, return_inverse=True)[1]

    def add(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == y] = x
        return x != y


def leaves(one: Node, two: Node, percent: int):
    """Pairs of leaves that may hold a link, by dual traversal."""
    queue = [(one, two)]
    while queue:
        p, q = queue.pop()
        if not may_link(p, q, percent):
            continue
        if not p.children and not q.children:
            yield p, q
        # The larger node is opened; a node paired with itself pairs each of its children once.
        elif p is q:
            queue += [(c, d) for i, c in enumerate(p.children) for d in p.children[i:]]
        elif p.children and (not q.children or len(p.at) >= len(q.at)):
            queue += [(c, q) for c in p.children]
        else:
            queue += [(p, c) for c in q.children]


def _alike(p: Node, q: Node, bits, n, rest, labels, percent: int):
    """Which rows of two leaves may link, as far as the bitmaps tell, and have different labels."""
    import numpy as np

    apart = labels[p.at][:, None] != labels[q.at][None, :]
    if p is q:
        apart = np.triu(apart, 1)
    if not apart.any():
        return apart
    both = np.bitwise_count(bits[p.at][:, None, :] & bits[q.at][None, :, :]).sum(axis=2, dtype=np.int64)
    both += np.minimum(rest[p.at][:, None], rest[q.at][None, :])
    return ((100 + percent) * both >= percent * (n[p.at][:, None] + n[q.at][None, :])) & apart


def with_partner(one: Node, two: Node, bits, n, rest, comp, percent: int = PERCENT, before=None):
    """Which rows may link with one of another component, as far as the bitmaps tell; pairs that share a bit of ``before`` are left out."""
    import numpy as np

    found = np.zeros(len(n), bool)
    for p, q in leaves(one, two, percent):
        good = _alike(p, q, bits, n, rest, comp, percent)
        if before is not None and good.any():
            good &= ~(before[p.at][:, None, :] & before[q.at][None, :, :]).any(axis=2)
        found[p.at] |= good.any(axis=1)
        found[q.at] |= good.any(axis=0)
    return found


def traversed(one: Node, two: Node, bits, n, comp, percent: int = PERCENT, every: bool = False) -> list[tuple[int, int]]:
    """Pairs of rows that link, by bitmaps of whole sets: one for each merging of two components, or every one between different components."""
    import numpy as np

    merged, found, rest = Merged(comp), [], np.zeros(len(n), np.int64)
    for p, q in leaves(one, two, percent):
        good = _alike(p, q, bits, n, rest, comp if every else merged.label, percent)
        for i, j in zip(*np.nonzero(good), strict=True):
            a, b = int(p.at[i]), int(q.at[j])
            if every or merged.add(a, b):
                found.append((a, b))
    return found


def _each_task(rows):
    """The rows of each pair of blocks in a task's Arrow table, and which are on the right."""
    import numpy as np

    task, side, cid = (rows.column(c).to_numpy() for c in ("task", "side", "cid"))
    order = np.lexsort((side, task))
    edges = np.flatnonzero(np.diff(task[order], prepend=task[order][0] - 1, append=task[order][-1] + 1))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        at = order[i:j]
        # A text may come twice where rows repeat.
        at = at[np.unique(cid[at], return_index=True)[1]]
        if len(at) > 1:
            yield at, np.flatnonzero(side[at] < 2), np.flatnonzero(side[at] > 1)


def _dealt(rows: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """Written rows with what they need of the texts, many small pairs of blocks to a task; a pair of full ones has about one of its own."""
    n_tasks = max(1, -(-rows.count() // ROWS_PER_TASK))
    joined = rows.join(texts.select("cid", *columns), "cid").withColumn("bundle", F.pmod("task", F.lit(n_tasks)))
    return joined.repartition(n_tasks, "bundle")


def _in_rounds(rows: DataFrame, most: float, found, label: str) -> DataFrame:
    """``found`` of the written ``rows``, by parts of at most about ``most`` rows, whole tasks each; written."""
    n = max(1, math.ceil(rows.count() / max(ROUND_ROWS, most)))
    parts = [rows.where(F.pmod(F.xxhash64("task", F.lit("round")), F.lit(n)) == k) for k in range(n)] if n > 1 else [rows]
    return reduce(DataFrame.unionByName, [materialize(found(part), label) for part in parts])


ASKED = "task long, side int, cid long, comp long"


def asked_rows(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(task, side, cid, comp, before): the classes of each pair of blocks; side 0 where a block is paired with itself."""
    own = pairs.where("one = two").select("cell", "one", "two", F.col("one").alias("block"), F.lit(0).alias("side"))
    first = pairs.where("one <> two").select("cell", "one", "two", F.col("one").alias("block"), F.lit(1).alias("side"))
    second = pairs.where("one <> two").select("cell", "one", "two", F.col("two").alias("block"), F.lit(2).alias("side"))
    asked = reduce(DataFrame.unionByName, (own, first, second)).withColumn("task", F.xxhash64("cell", "one", "two"))
    return asked.select("task", "side", "cell", "block").join(members, ["cell", "block"]).select("task", "side", "cid", "comp", "before")


def sifted(rows: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The written ``rows`` whose class may link with one of another component, by bitmaps of the first hashes; a pair counts in the first cell it shares."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        comp, size, blobs, cells, kept = table.column("comp").to_numpy(), table.column("n").to_numpy(), table.column("first"), table.column("before"), []
        for at, left, right in _each_task(table):
            sets = [np.frombuffer(blobs[int(k)].as_py(), np.uint32) for k in at]
            n = size[at]
            # Two hashes with the same 32 bits only make an overlap look larger.
            bits, rest = bitmaps(sets), n - np.array([len(x) for x in sets])
            one = tree(left, bits, n, rest, comp[at])
            two = tree(right, bits, n, rest, comp[at]) if len(right) else one
            before = bitmaps([np.array(cells[int(k)].as_py(), np.int64) for k in at])
            kept.append(at[with_partner(one, two, bits, n, rest, comp[at], percent, before)])
        return table.select(["task", "side", "cid", "comp"]).take(pa.array(np.concatenate(kept) if kept else [], pa.int64()))

    return _dealt(rows, texts, "n", "first").groupBy("bundle").applyInArrow(run, ASKED)


def tree_links(rows: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT, every: bool = False) -> DataFrame:
    """(a, b): links between classes of different components; as many as merge them within a task, or every one."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        cid, comp, blobs, found = table.column("cid").to_numpy(), table.column("comp").to_numpy(), table.column("words"), []
        for at, left, right in _each_task(table):
            sets = [hashes_of(unpacked(blobs[int(k)].as_py()), words) for k in at]
            bits, n = bitmaps(sets), np.array([len(x) for x in sets])
            none = np.zeros(len(n), np.int64)
            one = tree(left, bits, n, none, comp[at])
            two = tree(right, bits, n, none, comp[at]) if len(right) else one
            found += [(int(cid[at[a]]), int(cid[at[b]])) for a, b in traversed(one, two, bits, n, comp[at], percent, every)]
        columns = list(zip(*found, strict=True)) if found else [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    found = _dealt(rows, texts, "words").groupBy("bundle").applyInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Prepared:
    """Written tables of a join: rows with their sets' digests, classes of equal sets, cells of prefix shingles, texts of the classes in cells."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, percent: int):
        self.words, self.percent = words, percent
        wide = materialize(shingle_sets(docs, doc_id, text, words, percent), "sets")
        one = wide.where("n > 0").groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("rest").alias("rest")
        )
        full = materialize(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.sets = materialize(wide.select("doc_id", "row_hash", "n", "digest"), "rows")
        discard(wide)
        self.cells = materialize(prefixes(full, percent).withColumn("band", _band(percent=percent)), "cells")
        self.classes = materialize(full.select("cid", "rep", "n", "digest"), "classes")
        discard(full)
        near = self.classes.join(self.cells.select("cid").distinct(), "cid", "left_semi")
        self.texts = materialize(near_texts(docs, doc_id, text, near, words, percent), "texts")

    def star_links(self) -> DataFrame:
        return materialize(verified(star_pairs(self.cells, self.percent), self.texts, self.words, self.percent), "links")

    def tree_links(self, labelled: DataFrame, every: bool = False) -> DataFrame:
        """Links between classes of different ``comp`` in the cells, by signature trees; written."""
        open_ = materialize(open_cells(labelled), "members")
        small, large = families(open_)
        large = materialize(large, "members")
        members = materialize(blocks(large), "members")
        pairs = materialize(node_pairs(members, self.percent), "blocks")
        none = F.array().cast("array<bigint>").alias("before")
        asked = materialize(small.select("*", none).unionByName(asked_rows(members, pairs)), "asked")
        discard(open_, large, members, pairs)
        n_texts = self.texts.count()
        left = _in_rounds(asked, FIRSTS_PER_ROUND * n_texts, lambda part: sifted(part, self.texts, self.percent), "sifted")
        left = materialize(left, "left")
        discard(asked)
        return _in_rounds(left, TEXTS_PER_ROUND * n_texts, lambda part: tree_links(part, self.texts, self.words, self.percent, every), "links").distinct()


def _named(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, digest, component, component_id) of every class."""
    labels = smallest_labels(links)
    named = classes.select("cid", "rep", "digest").join(labels, classes["cid"] == labels["node"], "left").select("cid", "rep", "digest", F.coalesce("label", "cid").alias("component"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "names")
    return named.join(least, "component").select("cid", "digest", "component", "component_id")


#: The columns of ``components`` from rows joined with their classes.
COMPONENT_COLUMNS = [
    "doc_id", "row_hash", "n AS n_shingles", "digest", "component", "CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id"
]


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, row_hash, n_shingles, digest, component (a number), component_id (its smallest doc_id).

    Pairs that are in one component already are not verified; ``links`` has them all.
    """
    made = Prepared(docs, doc_id, text, words, percent)
    links = made.star_links()
    labels = smallest_labels(links)
    cells = made.cells
    labelled = cells.join(labels, cells["cid"] == labels["node"], "left").select("token", "band", "cid", "n", F.coalesce("label", "cid").alias("comp"))
    more = made.tree_links(labelled)
    discard(made.texts, made.cells)
    named = materialize(_named(made.classes, links.unionByName(more)).select("digest", "component", "component_id"), "named")
    return made.sets.join(named, "digest", "left").selectExpr(*COMPONENT_COLUMNS)


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and which rows have these sets.

    The first table has (a, b, rep_a, rep_b), a < b: two classes of equal sets that link and the smallest
    doc_id of each. The second has all rows' doc_id, row_hash, n, digest and class ``cid``, NULL for rows without words.
    Every class is a component of its own here, so that no pair is left out.
    """
    made = Prepared(docs, doc_id, text, words, percent)
    each = made.cells.select("token", "band", "cid", "n", F.col("cid").alias("comp"))
    found = made.tree_links(each, every=True)
    reps = made.classes.select("cid", "rep")
    found = found.join(reps.select(F.col("cid").alias("a"), F.col("rep").alias("rep_a")), "a").join(reps.select(F.col("cid").alias("b"), F.col("rep").alias("rep_b")), "b")
    rows = made.sets.join(made.classes.select("digest", "cid"), "digest", "left")
    return found.select("a", "b", "rep_a", "rep_b"), rows.select("doc_id", "row_hash", "n", "digest", "cid")


def link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The columns of ``components`` and n_links: how many other rows a row links with, those of equal sets included."""
    found, rows = links(docs, doc_id, text, words, percent)
    found, rows = materialize(found.select("a", "b"), "links"), materialize(rows, "rows")
    sizes = materialize(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("members")), "sizes")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, both["b"] == sizes["cid"]).groupBy("a").agg(F.sum("members").alias("others"))
    counts = sizes.join(others, sizes["cid"] == others["a"], "left").select("cid", F.expr("members - 1 + coalesce(others, 0) AS n_links"))
    classes = rows.where("cid IS NOT NULL").groupBy("cid", "digest").agg(F.min("doc_id").alias("rep"))
    named = _named(classes, found).select("cid", "component", "component_id").join(counts, "cid")
    return rows.join(named, "cid", "left").selectExpr(*COMPONENT_COLUMNS, "coalesce(n_links, 0L) AS n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each component, that with the smallest doc_id; texts without words stay.

    What goes is named by identifier and hash of the text, so documents are read again and never written, and those that a bitmap of these names
    rules out are not shuffled; of rows that are equal in both, any one stays.
    """
    found = materialize(components(docs, doc_id, text, words, percent).where("component IS NOT NULL").select("doc_id", "row_hash", "component"), "components")
    keys = found.groupBy("component", "doc_id", "row_hash").agg(F.count("*").alias("times"))
    # NULL identifiers come last.
    first = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", "times")).alias("k"))
    first = materialize(first.select("k.doc_id", "k.row_hash", "k.times"), "first")
    once = first.where("times = 1").alias("x")
    again = first.where("times > 1").select(F.col("doc_id").alias("k_id"), F.col("row_hash").alias("k_hash"))
    gone = keys.alias("y").join(once, F.expr("x.doc_id <=> y.doc_id AND x.row_hash = y.row_hash"), "left_anti").select(F.col("y.doc_id").alias("k_id"), F.col("y.row_hash").alias("k_hash"))
    gone = materialize(gone, "gone")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), *_row_key(doc_id, text))
    match = F.expr("doc_id <=> k_id AND row_hash = k_hash")
    perhaps, stay = parted(rows, ["doc_id", "row_hash"], gone, ["k_id", "k_hash"])
    kept = stay.select("row.*").unionByName(perhaps.join(gone, match, "left_anti").select("row.*"))
    if again.isEmpty():
        return kept
    place = F.row_number().over(Window.partitionBy("doc_id", "row_hash").orderBy(F.lit(1)))
    return kept.unionByName(rows.join(again, match, "left_semi").withColumn("place", place).where("place = 1").select("row.*"))


def parted(rows: DataFrame, names: list[str], keys: DataFrame, key_names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``names`` may be one of the written ``keys``, and those where they are none: only the first need be shuffled to tell.

    By a bitmap of the keys' hashes, which all tasks get: two bytes a key, and at most ``MOST_BITS``; with more keys more rows may be one.
    """
    bits = min(MOST_BITS, max(PIECE_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))

    def place(columns):
        return F.pmod(F.xxhash64(*columns), F.lit(bits))

    places = keys.select(place(key_names).alias("place"))
    pieces = places.groupBy(F.expr(f"place div {PIECE_BITS}").alias("piece")).agg(F.bitmap_construct_agg(F.col("place") % PIECE_BITS).alias("bitmap"))
    pieces = materialize(pieces, "bitmaps")
    asked = rows.withColumn("place", place(names))
    found = asked.join(F.broadcast(pieces), F.expr(f"place div {PIECE_BITS} = piece"), "left")
    byte = F.expr(f"CAST(conv(hex(substring(bitmap, CAST((place % {PIECE_BITS}) div 8 + 1 AS INT), 1)), 16, 10) AS BIGINT)")
    hit = F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False))
    return found.where(hit).select(*rows.columns), found.where(~hit).select(*rows.columns)


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: size of set and component of every document."""
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_jaccard_join": jaccard_join}

#: Brute force over all pairs of sets that share a shingle.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS g FROM d),
c AS (SELECT dense_rank() OVER (ORDER BY g) AS cid, rid, doc_id, g FROM s),
k AS (SELECT cid, any_value(g) AS g, min(doc_id) AS rep FROM c WHERE len(g) > 0 GROUP BY cid),
e AS (SELECT cid, len(g) AS n, unnest(g) AS x FROM k),
p AS (SELECT a.cid AS a, b.cid AS b FROM e a JOIN e b ON a.x = b.x AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.cid, b.cid HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT cid AS a, cid AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT r.a AS cid, min(k.rep) AS component_id FROM r JOIN k ON k.cid = r.b GROUP BY r.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, CASE WHEN len(g) = 0 THEN doc_id ELSE component_id END AS component_id FROM c LEFT JOIN m USING (cid)"""

ORACLES = {"op4_jaccard_join": ORACLE}
