"""Substring dedup by fixed-block anchors (operator 13).

A passage of ``WINDOW`` words that also starts earlier (in a document with a smaller identifier, or before in the same one) is removed.

1. Texts become chunks of some million words, written compressed.
2. Index: the blocks of ten words at every tenth word of each document, which do not overlap. Every run of 20 words has one of them whole.
3. Probe: every rolling window of ten words asks the index. A chunk asks once for each of its distinct windows, by a hash as wide as the
   number of blocks needs, dealt to partitions by hash ranges. A block that occurs nowhere else answers no.
4. Extend: a hit is carried on to both sides, one word at a time, through the windows of 20 words that hold it. These windows are compared by 96 bits, again
   once per chunk and partition, and the smallest identifier of each comes back.
   Windows that have an earlier one make up maximal exact repeats; their words go.

A hash that two different blocks of ten share only makes candidates, which step 4 drops. However often a passage occurs, a chunk asks for it once
and no pairs are formed, so no partition is hot; the number of partitions grows with the words.

Words are runs without white space, unchanged. Defined results: NULL and empty texts have no words and stay empty; documents shorter than a window stay
whole; rows of one identifier are documents of equal rank, neither of which is earlier, so repeated rows stay; NULL identifiers come last and count as one identifier; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm.bpe import slices
from rewardloom.llm.common import table
from rewardloom.scratch import materialize

#: Words of a window, and of a block: twice a block less one is at most a window.
WINDOW, BLOCK = 20, 10
#: Characters of a chunk's documents; distinct windows (per chunk) that a partition gets, about.
CHUNK_CHARS, PARTITION_WINDOWS = 6_000_000, 4_000_000
#: Bits of a block's hash beyond those that number all blocks: one window in so many is a candidate by chance.
SPARE_BITS = 10
#: Where NULL identifiers stand.
LAST = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def rolled(h, size: int, factor: int):
    """Hashes of all runs of ``size`` words, by those of the words."""
    import numpy as np

    n = max(0, len(h) - size + 1)
    x = h[:n].copy()
    for k in range(1, size):
        x ^= x >> np.uint64(32)
        x *= np.uint64(factor)
        x += h[k : k + n]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def squeezed(numbers) -> bytes:
    """Numbers as compressed bytes, first bytes first."""
    import pyarrow as pa

    planes = numbers.view("uint8").reshape(len(numbers), numbers.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def stretched(blob: bytes, n: int, kind):
    import numpy as np
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    planes = pa.decompress(blob, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def bits_of(flags) -> bytes:
    import numpy as np

    return np.packbits(flags).tobytes()


def flags_of(blob: bytes, n: int):
    import numpy as np

    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class Chunk:
    """Hashes of the words of some documents, ``ids`` their identifiers, ``starts`` where each begins, and the end of all."""

    def __init__(self, ids, texts: list[list[bytes]]):
        import numpy as np
        import xxhash

        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.append(0, np.cumsum(lengths))
        self.h = np.fromiter((xxhash.xxh64_intdigest(w) for t in texts for w in t), np.uint64, int(self.starts[-1]))
        self.doc = np.repeat(np.arange(len(texts)), lengths)
        self.within = np.arange(len(self.h)) - self.starts[self.doc]
        self.left = lengths[self.doc] - self.within

    def blocks(self, bits: int):
        """Distinct hashes of the rolling windows of ten words in order, which are of index blocks, which occur more than once; where windows are, and which hash each has."""
        import numpy as np

        at = np.flatnonzero(self.left >= BLOCK)
        x = rolled(self.h, BLOCK, 0x9E3779B97F4A7C15)[at] >> np.uint64(64 - bits)
        distinct, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
        indexed = np.zeros(len(distinct), bool)
        indexed[inverse[self.within[at] % BLOCK == 0]] = True
        return distinct, indexed, times > 1, at, inverse

    def candidates(self, hits):
        """Starts of the windows of 20 words that hold one of the ``hits``, the starts of blocks found in the index."""
        import numpy as np

        seen = np.zeros(len(self.h) + 1, np.int64)
        seen[hits + 1] = 1
        seen = np.cumsum(seen)
        at = np.flatnonzero(self.left >= WINDOW)
        return at[seen[at + WINDOW - BLOCK + 1] > seen[at]]

    def asked(self, at):
        """What of the windows at ``at`` the chunk can't tell: (high, low, identifier, start) in order; and the starts of those it knows to be repeats."""
        import numpy as np

        high = rolled(self.h, WINDOW, 0x9E3779B97F4A7C15)[at]
        low = (rolled(self.h, WINDOW, 0xC2B2AE3D27D4EB4F)[at] >> np.uint64(32)).astype(np.uint32)
        ids, docs = self.ids[self.doc[at]], self.doc[at]
        order = np.lexsort((at, docs, ids, low, high))
        high, low, ids, docs, at = high[order], low[order], ids[order], docs[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(new) - 1
        least = ids[new][group] if len(at) else ids
        again = np.zeros(len(at), bool)
        again[1:] = ~new[1:] & (docs[1:] == docs[:-1])
        known = (ids > least) | again
        return high[~known], low[~known], ids[~known], at[~known], np.sort(at[known])


def chunks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents in chunks, written: (chunk, ids, lengths, words, size), the words of all joined by blanks and compressed."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for start, n in slices(sizes, CHUNK_CHARS):
                part = batch.slice(start, n)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                joined = b" ".join(w for t in texts for w in t)
                blob = pa.compress(joined, codec="zstd", asbytes=True) if joined else b""
                values = [number, part.column(0).to_pylist(), [len(t) for t in texts], blob, len(joined)]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["chunk", "ids", "lengths", "words", "size"])
                number += 1

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "chunk long, ids array<long>, lengths array<long>, words binary, size long"), "chunks")


def _texts(row) -> list[list[bytes]]:
    import pyarrow as pa

    words = pa.decompress(row["words"], row["size"], codec="zstd", asbytes=True).split() if row["size"] else []
    out, start = [], 0
    for n in row["lengths"]:
        out.append(words[start : start + n])
        start += n
    return out


def _ranges(keys, bits: int, n_partitions: int):
    """Where each partition's range of sorted hashes starts."""
    import numpy as np

    width = (1 << bits) // n_partitions + 1
    bounds = np.array([min(k * width, (1 << 64) - 1) for k in range(1, n_partitions)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _probes(chunks: DataFrame, bits: int, n_partitions: int) -> DataFrame:
    """Each chunk's distinct windows of ten words, by partition: (chunk, part, n, keys, indexed, several)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.uint32 if bits <= 32 else np.uint64
        for batch in batches:
            for row in batch.to_pylist():
                keys, indexed, several, _, _ = Chunk(row["ids"], _texts(row)).blocks(bits)
                edges, out = _ranges(keys, bits, n_partitions), []
                for part, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if j > i:
                        # Sorted, so differences take few bytes.
                        steps = np.diff(keys[i:j], prepend=np.uint64(0)).astype(kind)
                        out.append((row["chunk"], part, int(j - i), squeezed(steps), bits_of(indexed[i:j]), bits_of(several[i:j])))
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["chunk", "part", "n", "keys", "indexed", "several"])

    return chunks.mapInArrow(run, "chunk long, part int, n long, keys binary, indexed binary, several binary")


def _found(probes: DataFrame, bits: int) -> DataFrame:
    """(chunk, part, n, found): which of a chunk's windows, in order, are blocks of the index that occur elsewhere too."""

    def run(rows):
        import numpy as np
        import pyarrow as pa

        kind = np.uint32 if bits <= 32 else np.uint64
        sizes = rows.column("n").to_pylist()
        each = [np.cumsum(stretched(b, n, kind), dtype=np.uint64) for b, n in zip(rows.column("keys").to_pylist(), sizes, strict=True)]
        flags = lambda name: np.concatenate([flags_of(b, n) for b, n in zip(rows.column(name).to_pylist(), sizes, strict=True)])
        keys = np.concatenate(each)
        distinct, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        indexed, several = np.zeros(len(distinct), bool), times > 1
        indexed[inverse[flags("indexed")]] = True
        several[inverse[flags("several")]] = True
        live = (indexed & several)[inverse]
        blobs = [bits_of(x) for x in np.split(live, np.cumsum(sizes)[:-1])]
        return pa.table([rows.column("chunk"), rows.column("part"), rows.column("n"), pa.array(blobs, pa.binary())], ["chunk", "part", "n", "found"])

    return probes.groupBy("part").applyInArrow(run, "chunk long, part int, n long, found binary")


EXTENSIONS = "chunk long, part int, n long, high binary, low binary, ids binary, at binary"


def _extended(chunks: DataFrame, found: DataFrame, bits: int, n_partitions: int) -> DataFrame:
    """The windows of 20 words around hits, by partition, which the chunk can't settle itself; those it knows to be repeats have a negative partition."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = []
        for row in left.to_pylist():
            chunk = Chunk(row["ids"], _texts(row))
            keys, _, _, at, inverse = chunk.blocks(bits)
            live = np.zeros(len(keys), bool)
            edges = _ranges(keys, bits, n_partitions)
            for part, n, blob in zip(*[right.column(c).to_pylist() for c in ("part", "n", "found")], strict=True):
                live[edges[part] : edges[part] + n] = flags_of(blob, n)
            high, low, ids, starts, known = chunk.asked(chunk.candidates(at[live[inverse]]))
            if len(known):
                out.append((row["chunk"], -1 - row["chunk"] % 1_000_003, len(known), None, None, None, squeezed(np.diff(known, prepend=0))))
            edges = _ranges(high, 64, n_partitions)
            for part, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if j > i:
                    steps = np.diff(high[i:j], prepend=np.uint64(0))
                    out.append((row["chunk"], part, int(j - i), squeezed(steps), low[i:j].tobytes(), squeezed(ids[i:j]), squeezed(starts[i:j].astype(np.uint32))))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "part", "n", "high", "low", "ids", "at"])

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, EXTENSIONS)


def _late(extensions: DataFrame) -> DataFrame:
    """(chunk, n, at): starts of windows that also start earlier, by chunk and partition."""

    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        if key[0].as_py() < 0:
            return rows.select(["chunk", "n", "at"])
        sizes = rows.column("n").to_pylist()
        pairs = lambda name: zip(rows.column(name).to_pylist(), sizes, strict=True)
        high = np.concatenate([np.cumsum(stretched(b, n, np.uint64), dtype=np.uint64) for b, n in pairs("high")])
        low = np.concatenate([np.frombuffer(b, np.uint32) for b in rows.column("low").to_pylist()])
        ids = np.concatenate([stretched(b, n, np.int64) for b, n in pairs("ids")])
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        late = np.minimum.reduceat(ids[order], np.flatnonzero(new))[group] < ids
        out = []
        for chunk, blob, n, own in zip(rows.column("chunk").to_pylist(), rows.column("at").to_pylist(), sizes, np.split(late, np.cumsum(sizes)[:-1]), strict=True):
            if own.any():
                at = np.sort(stretched(blob, n, np.uint32)[own].astype(np.int64))
                out.append((chunk, len(at), squeezed(np.diff(at, prepend=0))))
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "n", "at"])

    return extensions.groupBy("part").applyInArrow(run, "chunk long, n long, at binary")


RESULT = "id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


def _cut(chunks: DataFrame, late: DataFrame) -> DataFrame:
    """The documents without the words of late windows."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = []
        for row in left.to_pylist():
            texts = _texts(row)
            starts = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
            turns = np.zeros(starts[-1] + WINDOW + 1, np.int64)
            for blob, n in zip(right.column("at").to_pylist(), right.column("n").to_pylist(), strict=True):
                at = np.cumsum(stretched(blob, n, np.int64))
                turns[at] += 1
                turns[at + WINDOW] -= 1
            gone = np.cumsum(turns) > 0
            for i, (name, words) in enumerate(zip(row["ids"], texts, strict=True)):
                own = gone[starts[i] : starts[i + 1]]
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept = [w for w, g in zip(words, own.tolist(), strict=True) if not g] if spans else words
                out.append((name, len(words), int(own.sum()), spans, b" ".join(kept).decode("utf-8", "surrogatepass")))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.string()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "n_words", "n_removed", "removed", "kept"])

    return chunks.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(run, RESULT)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, removed, kept): spans of words of the maximal repeats that went, and the words that stay, joined by blanks."""
    chunks = chunks_of(docs, doc_id, text)
    total = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).first()["n"] or 0
    n_partitions = max(1, -(-total // PARTITION_WINDOWS))
    bits = min(64, max(16, (total // BLOCK + 1).bit_length() + SPARE_BITS))
    found = _found(_probes(chunks, bits, n_partitions), bits)
    late = _late(_extended(chunks, found, bits, n_partitions))
    return _cut(chunks, late)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: how many words of every document went and a digest of the rest."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_substring_dedup": substring_dedup}

#: All windows by their words.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT rid, coalesce(doc_id, {LAST}) AS id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM p),
l AS (SELECT rid, i, min(id) OVER (PARTITION BY s) < id OR row_number() OVER (PARTITION BY s, rid ORDER BY i) > 1 AS late FROM g),
r AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS k FROM l WHERE late),
c AS (SELECT rid, list(k) AS gone FROM r GROUP BY rid),
e AS (SELECT doc_id, w, gone, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END AS kept FROM d LEFT JOIN c USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM e"""

ORACLES = {"op13_substring_dedup": ORACLE}
