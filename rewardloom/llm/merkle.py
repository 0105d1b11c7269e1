"""Merkle dataset manifest by concatenated-level strings (operator 11).

Every row is a leaf, the digest of its columns. Leaves ascend by key within a group, every eight consecutive nodes
have their digest as parent, and the groups' roots make a tree in the same way, whose root stands for the table.

1. Leaves are dealt by ranges of (group, key, leaf) and numbered densely: counts per range, their
   running sums, and the place within the range. No group is in one task.
2. Each aligned block of 512 leaves keeps its level as one hex string. The next level is the digest of each
   512 characters of it, so three such steps leave one node. A node's siblings are the characters of its run on either side of its own.
3. Tops of blocks are the next tier's nodes, blocked likewise, until every group has one block. A tier
   has a 512th of the rows of the one below; groups' roots are then nodes of one more such tree.
4. From the top down, every block is given the siblings of its own top. A leaf's path is its siblings within the block, then those.

A block is one row with 32 KB of digests, whatever the size of its group, so hot groups are many blocks. Nothing is collected but one number a tier.

Defined results: a NULL value counts as ``-``, as distinct from an empty text; NULL groups are a group of their own, the first; NULL keys
come first in their group; rows with one key are in order of their leaves, so the order of input never matters; repeated rows are leaves of their
own; a group of one row has that leaf as its root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewardloom.llm.common import table
from rewardloom.scratch import materialize

#: Children of a node, levels within a block, nodes of a block's lowest level, characters of a digest.
RUN, LEVELS = 8, 3
BLOCK, HEX = RUN**LEVELS, 64
#: The columns that make a leaf.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's values, each with its length in bytes so that no two rows are alike by shifting text."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, key, digest, ...) with ``pos``, the place within the group from 0, and ``size``, the group's number of nodes."""
    # Repeated rows are told apart by where they were read, so that many of them are several ranges.
    dealt = nodes.withColumn("read", F.monotonically_increasing_id())
    order = ["grp", "key", "digest", "read"]
    rows = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("read").withColumn("place", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("range", F.shiftright("place", 33)), "ordered")
    counts = rows.groupBy("grp", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("grp", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("size"))
    found = rows.join(materialize(offsets, "offsets"), ["grp", "range"])
    return found.withColumn("pos", F.expr("place - first + offset")).drop("place", "range", "first", "offset")


def _parents(level: str) -> Column:
    """The level above a level's string: digests of its runs, the last of which may be short."""
    return F.expr(f"array_join(transform(sequence(0, (length({level}) - 1) div {RUN * HEX}), i -> sha2(substring({level}, i * {RUN * HEX} + 1, {RUN * HEX}), 256)), '')")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, size, block, rows, l0, l1, l2, top), written; levels that a small group doesn't have are NULL."""
    names = [c for c in nodes.columns if c not in ("grp", "size", "pos", "digest")]
    rows = nodes.select("grp", "size", F.expr(f"pos div {BLOCK}").alias("block"), F.struct("pos", "digest", *names).alias("node"))
    found = rows.groupBy("grp", "size", "block").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    found = found.withColumn("l0", F.expr("array_join(transform(nodes, x -> x.digest), '')"))
    for k in range(1, LEVELS + 1):
        found = found.withColumn(f"l{k}", F.when(F.col("size") > RUN ** (k - 1), _parents(f"l{k - 1}")))
    top = F.coalesce(*[f"l{k}" for k in range(LEVELS, -1, -1)])
    kept = F.expr(f"transform(nodes, x -> struct({', '.join(f'x.`{c}`' for c in names) or 'x.pos'}))")
    return materialize(found.select("grp", "size", "block", kept.alias("rows"), *[f"l{k}" for k in range(LEVELS)], top.alias("top")), "blocks")


def tiers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks by tier, and (grp, root) of every group."""
    out = [_blocks(nodes)]
    many = f"size > {BLOCK}"
    while not out[-1].where(many).isEmpty():
        tops = out[-1].where(many)
        out.append(_blocks(tops.select("grp", F.col("block").alias("pos"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), F.col("top").alias("digest"))))
    roots = [blocks.where(f"NOT {many}").select("grp", F.col("top").alias("root")) for blocks in out]
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return out, found


def _siblings(level: str, i: str) -> str:
    """SQL for the characters of a node's run on the left and on the right of its own."""
    run, at = f"({i} div {RUN}) * {RUN * HEX}", f"{i} * {HEX}"
    return f"struct(substring({level}, {run} + 1, {at} - {run}) AS left, substring({level}, {at} + {HEX + 1}, {run} + {RUN * HEX} - {at} - {HEX}) AS right)"


def _members(blocks: DataFrame, above: str, *also: str) -> DataFrame:
    """The nodes of blocks: ``at`` in the block, row, digest and path, ``above`` being the path of the block's top."""
    levels = " ".join(f"WHEN size > {RUN**k} THEN {k + 1}" for k in range(LEVELS - 1, -1, -1))
    own = ", ".join(_siblings(f"l{k}", f"(i div {RUN**k})") for k in range(LEVELS))
    node = f"struct(i AS at, rows[i] AS row, substring(l0, i * {HEX} + 1, {HEX}) AS digest, concat(slice(array({own}), 1, CASE {levels} ELSE 0 END), {above}) AS path)"
    each = F.expr(f"transform(sequence(0, size(rows) - 1), i -> {node})")
    return blocks.select("grp", "block", *also, F.explode(each).alias("node")).select("grp", "block", *also, "node.*")


NO_PATH = "array<struct<left:string,right:string>>"


def paths(levels: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Every node of the lowest tier with its path, with ``heads`` (grp, head, ...) joined: the path of the group's root and other columns."""
    also = [c for c in heads.columns if c not in ("grp", "head")]
    tops = None
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k]
        done = blocks.where(f"size <= {BLOCK}").join(heads, "grp")
        if tops is not None:
            done = done.unionByName(blocks.where(f"size > {BLOCK}").join(tops, ["grp", "block"]))
        if k == 0:
            return _members(done, "head", *also)
        tops = materialize(_members(done, "head", *also).selectExpr("grp", f"block * {BLOCK} + at AS block", "path AS head", *also), "tops")
    raise ValueError("no tiers")


@dataclass
class Manifest:
    """One row per leaf: grp, row (the columns carried along), digest, path, subroot, root."""

    rows: DataFrame


def group_key(group: Column) -> Column:
    """A key without NULLs in whose order NULL comes first and texts go by their bytes."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def manifest(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves`` (grp, key, digest, ...); further columns are carried in ``row``."""
    low, subroots = tiers(numbered(leaves.withColumn("key_", F.col("key"))))
    groups = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("digest"), F.col("grp").alias("name"))
    high, roots = tiers(numbered(groups))
    # One row per table or per group; they stay joins.
    heads = roots.select("grp", "root", F.array().cast(NO_PATH).alias("head"))
    named = paths(high, heads).select(F.col("row.name").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("path").alias("head"))
    return Manifest(paths(low, materialize(named, "groups")))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, side: digest(side["left"], node, side["right"]))


def proof_text(path: Column) -> Column:
    """A path's siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), "")


def verified_against(now: DataFrame, then: DataFrame | None = None, key: str = "doc_id", group: str = "lang", columns: list[str] = COLUMNS, changed: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``now`` and whether each row, with ``changed`` columns in place of its own, still leads to the root.

    Returns key, leaf, subroot, root, path, folded_root, verified.
    """
    changed = changed or {}
    values = [F.col(f"`{c}`") for c in columns]
    seen = leaf_of([changed.get(c, F.col(f"`{c}`")) for c in columns])
    leaves = now.select(group_key(F.col(f"`{group}`")).alias("grp"), F.col(f"`{key}`").alias("key"), leaf_of(values).alias("digest"), seen.alias("seen"))
    # Both digests of a row come from one reading of its text; written, as ranges are drawn from these rows before they are dealt.
    found = manifest(materialize(leaves, "leaves")).rows
    found = found.select(F.col("row.key_").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", folded(F.col("row.seen"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text() -> Column:
    """``text`` with A-Z lower-cased in a third of the rows."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(third, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: roots, proofs and what becomes of them where a text was changed."""
    found = verified_against(table(spark, sf_dir, "documents"), changed={"text": tampered_text()})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op11_merkle_manifest": merkle_manifest}


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field(c if c != 'text' else text) for c in COLUMNS)})"


ORACLE = f"""
WITH RECURSIVE d AS (
    -- CRC-32, bit by bit.
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::BIGINT)), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 3 = 0 AS third FROM documents),
l AS (SELECT *, {_leaf_sql('text')} AS leaf, CASE WHEN third THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql('text')} END AS seen,
    coalesce('+' || lang, '') AS grp FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM l),
t AS (SELECT grp, 0 AS level, pos, leaf AS digest, size FROM n
    UNION ALL
    SELECT grp, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM t WHERE size > 1 GROUP BY grp, level, pos // 8),
g AS (SELECT grp, digest AS subroot, level AS depth, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
u AS (SELECT 0 AS level, pos, subroot AS digest, size FROM g
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM u WHERE size > 1 GROUP BY level, pos // 8),
s AS (SELECT grp, level, pos, coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM t WHERE size > 1),
v AS (SELECT level, pos, coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM u WHERE size > 1),
f AS (SELECT doc_id, leaf, grp, 0 AS level, pos, seen AS node, '' AS proof FROM n
    UNION ALL
    SELECT doc_id, leaf, f.grp, f.level + 1, f.pos // 8, sha256(a || node || b), proof || a || b FROM f JOIN s ON s.grp = f.grp AND s.level = f.level AND s.pos = f.pos),
h AS (SELECT doc_id, leaf, subroot, 0 AS level, g.pos, node, proof FROM f JOIN g ON g.grp = f.grp AND g.depth = f.level
    UNION ALL
    SELECT doc_id, leaf, subroot, h.level + 1, h.pos // 8, sha256(a || node || b), proof || a || b FROM h JOIN v ON v.level = h.level AND v.pos = h.pos)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = digest AS verified
FROM h JOIN (SELECT digest, level AS depth FROM u WHERE size = 1) ON h.level = depth"""

ORACLES = {"op11_merkle_manifest": ORACLE}
