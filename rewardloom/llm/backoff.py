"""Stupid-backoff language-model scores (operator 6).

Counts of all n-grams up to ``order`` words are gathered from the whole input and
every document is scored by them, leaving out what it added itself, so that no
document vouches for its own words. A word scores by the longest n-gram it ends
that other documents have: its count over its history's count; each step down costs the factor ``ALPHA``. A word no
other document has counts as half a word.

The n-grams of a chunk of documents are exploded once per distinct n-gram and
chunk, as 56-bit hashes with their counts (of ten trillion different n-grams, one in ten thousand
would share its hash). These rows are partitioned by hash into count tables: a
row packs the sorted hashes of one chunk that fall in one partition. Each
partition sums the counts of equal hashes and answers with the sums in the order asked, and
the answers are joined to the chunks, where logarithms are summed per document. However
frequent an n-gram is, a chunk asks for it once, so no partition is hot;
the number of partitions grows with the n-grams.

Words are runs without white space, A-Z lower-cased; the text's start is no
word. Defined results: NULL and empty texts have no words and a score of 0; repeated
rows are documents of their own, and so count for each other; an empty table gives an empty result; with one
document every word is unseen; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm.bpe import slices
from rewardloom.llm.common import WORDS_SQL, table
from rewardloom.scratch import scratch_path

ORDER, ALPHA = 2, 0.4
#: Characters of a chunk's documents, and distinct n-grams (per chunk) of a partition of the count tables.
CHUNK_CHARS, PARTITION_GRAMS = 8_000_000, 1_000_000
#: Bits of a hash.
HASH_BITS = 56


class Chunk:
    """The n-grams of some documents.

    ``types``: hash of each distinct word; ``words``: place of each word's type; ``ends``: where each document's words end.
    """

    def __init__(self, types, words, ends):
        self.types, self.words, self.ends = types, words, ends

    @classmethod
    def of(cls, texts):
        import numpy as np
        import xxhash

        hashes, ends = [], [0]
        for text in texts:
            found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
            ends.append(ends[-1] + len(found))
        all_ = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        types, words = np.unique(all_ >> np.uint64(64 - HASH_BITS), return_inverse=True)
        return cls(types, words.astype(np.uint32), np.array(ends, np.int64))

    def grams(self, order: int):
        """Per n: (hashes of the distinct n-grams, place of the n-gram that ends at each word, -1 where the text is too short)."""
        import numpy as np

        starts = np.zeros(len(self.words), np.int64)
        begins = self.ends[:-1][self.ends[:-1] < self.ends[1:]]
        starts[begins] = begins
        starts = np.maximum.accumulate(starts) if len(starts) else starts
        within = np.arange(len(self.words)) - starts
        hashes, places = self.types, self.words.astype(np.int64)
        yield hashes, places
        for n in range(2, order + 1):
            enough = within >= n - 1
            at = np.nonzero(enough)[0]
            pairs = places[at - 1] * len(self.types) + self.words[at]
            distinct, inverse = np.unique(pairs, return_inverse=True)
            left, right = distinct // max(1, len(self.types)), distinct % max(1, len(self.types))
            x = (hashes[left] * np.uint64(0x9E3779B97F4A7C15)) ^ (self.types[right] + np.uint64(0xC2B2AE3D27D4EB4F))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            places = np.full(len(self.words), -1, np.int64)
            places[at] = inverse
            hashes = x >> np.uint64(64 - HASH_BITS)
            yield hashes, places

    def scores(self, counts, total: int, order: int):
        """Per document: words, and the sum of its words' log scores. ``counts``: per n, the corpus's count of each distinct n-gram."""
        import numpy as np

        lengths = np.diff(self.ends)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        others = total - lengths[doc]
        best, above, drop = None, None, np.zeros(len(doc))
        seen = []
        for (hashes, places), count in zip(self.grams(order), counts, strict=True):
            at = np.nonzero(places >= 0)[0]
            # Counts of the document's own n-grams.
            own = np.zeros(len(doc), np.int64)
            _, inverse, n = np.unique(doc[at] * (len(hashes) + 1) + places[at], return_inverse=True, return_counts=True)
            own[at] = n[inverse]
            left = np.zeros(len(doc), np.int64)
            left[at] = count[places[at]] - own[at]
            seen.append((left, places >= 0))
        one = seen[0][0]
        score = np.log(np.where(one > 0, one, 0.5)) - np.log(np.maximum(others, 1))
        for n in range(1, order):
            left, enough = seen[n]
            history = np.zeros(len(doc), np.int64)
            history[1:] = seen[n - 1][0][:-1]
            hit = enough & (left > 0)
            score = np.where(hit, np.log(np.maximum(left, 1)) - np.log(np.maximum(history, 1)), score + np.where(enough, np.log(ALPHA), 0.0))
        sums = np.zeros(len(lengths))
        np.add.at(sums, doc, score)
        return lengths, sums


def chunks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents' words as numbers, in chunks, written: (chunk, ids, types, words, ends)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for start, n in slices(lengths, CHUNK_CHARS):
                part = batch.slice(start, n)
                chunk = Chunk.of(part.column(1).to_pylist())
                blobs = [pack(chunk.types), squeeze(chunk.words), squeeze(chunk.ends)]
                arrays = [pa.array([number], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *[pa.array([b], pa.binary()) for b in blobs]]
                arrays.append(pa.array([len(chunk.words)], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "types", "words", "ends", "n_words"])
                number += 1

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = rows.mapInArrow(run, "chunk long, ids array<long>, types binary, words binary, ends binary, n_words long")
    path = scratch_path(docs.sparkSession, "chunks")
    found.write.parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def squeeze(numbers) -> bytes:
    """An array's bytes, the lowest of all numbers first, compressed."""
    import pyarrow as pa

    planes = numbers.view("uint8").reshape(len(numbers), numbers.itemsize).T.tobytes()
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def stretch(squeezed: bytes, kind):
    """The array of numbers of a ``kind`` that was squeezed."""
    import numpy as np
    import pyarrow as pa

    n, size = int.from_bytes(squeezed[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(squeezed[8:], n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def _chunk(types, words, ends) -> Chunk:
    import numpy as np

    return Chunk(unpack(types), stretch(words, np.uint32), stretch(ends, np.int64))


def _partitions(hashes, n_partitions: int):
    """Order of the hashes by partition and value, and where each partition starts. A partition is a range of hashes."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    width = (1 << HASH_BITS) // n_partitions + 1
    bounds = np.arange(n_partitions, dtype=np.uint64) * np.uint64(width)
    return order, np.append(np.searchsorted(hashes[order], bounds), len(hashes))


def pack(hashes) -> bytes:
    """Sorted hashes as the first one and differences in as many bytes as the largest needs."""
    import numpy as np

    if not len(hashes):
        return b""
    steps = np.diff(hashes)
    size = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return bytes([size]) + hashes[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(packed: bytes):
    import numpy as np

    if not packed:
        return np.empty(0, np.uint64)
    size = packed[0]
    steps = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, size) if size else np.empty((0, 0), np.uint8)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[1:, :size] = steps
    wide[0] = np.frombuffer(packed, np.uint8, 8, offset=1)
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def counts_of(chunks: DataFrame, order: int, n_partitions: int) -> DataFrame:
    """(chunk, n, part, counts): the corpus's count of each distinct n-gram of each chunk, by partition in order of hash."""

    def asked(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number, types, words, ends in zip(*[batch.column(c).to_pylist() for c in ("chunk", "types", "words", "ends")], strict=True):
                rows = []
                for n, (hashes, places) in enumerate(_chunk(types, words, ends).grams(order), 1):
                    times = np.bincount(places[places >= 0], minlength=len(hashes)).astype(np.uint32)
                    at, starts = _partitions(hashes, n_partitions)
                    for part in range(n_partitions):
                        own = at[starts[part] : starts[part + 1]]
                        if len(own):
                            rows.append((number, n, part, pack(hashes[own]), squeeze(times[own])))
                    if len(rows) * 2 > n_partitions:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "n", "part", "hashes", "times"])

    def summed(key, rows):
        import numpy as np
        import pyarrow as pa

        hashes = [unpack(b) for b in rows.column("hashes").to_pylist()]
        times = [stretch(b, np.uint32) for b in rows.column("times").to_pylist()]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate(times), minlength=len(distinct)).astype(np.int64)[inverse]
        ends = np.cumsum([len(h) for h in hashes])
        blobs = [squeeze(x) for x in np.split(sums, ends[:-1])]
        return pa.table([rows.column("chunk"), rows.column("n"), rows.column("part"), pa.array(blobs, pa.binary())], ["chunk", "n", "part", "counts"])

    rows = chunks.select("chunk", "types", "words", "ends").mapInArrow(asked, "chunk long, n int, part int, hashes binary, times binary")
    return rows.groupBy("n", "part").applyInArrow(summed, "chunk long, n int, part int, counts binary")


def scores(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score): one row per document, the sum of its words' natural log scores."""
    chunks = chunks_of(docs, doc_id, text)
    sizes = chunks.agg(F.sum("n_words").alias("words")).first()
    total = sizes["words"] or 0
    n_partitions = max(1, -(-total // PARTITION_GRAMS))
    answers = counts_of(chunks, order, n_partitions)

    def scored(key, left, right):
        import numpy as np
        import pyarrow as pa

        found: dict[int, dict[int, bytes]] = {n: {} for n in range(1, order + 1)}
        for n, part, counts in zip(*[right.column(c).to_pylist() for c in ("n", "part", "counts")], strict=True):
            found[n][part] = counts
        (row,) = left.to_pylist()
        chunk = _chunk(row["types"], row["words"], row["ends"])
        counts = []
        for n, (hashes, _) in enumerate(chunk.grams(order), 1):
            at, starts = _partitions(hashes, n_partitions)
            sums = np.zeros(len(hashes), np.int64)
            for part, blob in found[n].items():
                own = at[starts[part] : starts[part + 1]]
                sums[own] = stretch(blob, np.int64)
            counts.append(sums)
        lengths, sums = chunk.scores(counts, total, order)
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_words", "log_score"])

    left = chunks.select("chunk", "ids", "types", "words", "ends").groupBy("chunk")
    return left.cogroup(answers.groupBy("chunk")).applyInArrow(scored, "doc_id long, n_words long, log_score double")


def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the score of every document, also per word."""
    found = scores(table(spark, sf_dir, "documents"))
    mean = F.expr("round(CASE WHEN n_words > 0 THEN log_score / n_words ELSE 0D END, 6) + 0D")
    return found.select("doc_id", "n_words", (F.round("log_score", 3) + F.lit(0.0)).alias("log_score"), mean.alias("mean_score"))


QUERIES = {"op6_language_model_scores": language_model_scores}
#: Scores of words and pairs; sums are rounded, as their order differs.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
t AS (SELECT rid, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS y FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT rid, i, y, count(*) OVER (PARTITION BY x) - count(*) OVER (PARTITION BY rid, x) AS c1,
    count(*) OVER (PARTITION BY y, x) - count(*) OVER (PARTITION BY rid, y, x) AS c2, count(*) OVER () - count(*) OVER (PARTITION BY rid) AS others FROM t),
h AS (SELECT *, lag(c1) OVER (PARTITION BY rid ORDER BY i) AS c0 FROM c),
z AS (SELECT rid, sum(CASE WHEN y IS NOT NULL AND c2 > 0 THEN ln(c2) - ln(greatest(c0, 1))
    ELSE ln(CASE WHEN c1 > 0 THEN c1 ELSE 0.5::DOUBLE END) - ln(greatest(others, 1)) + CASE WHEN y IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END END) AS s FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0), 3) + 0.0::DOUBLE AS log_score,
    round(CASE WHEN len(w) > 0 THEN s / len(w) ELSE 0 END, 6) + 0.0::DOUBLE AS mean_score FROM d LEFT JOIN z USING (rid)"""

ORACLES = {"op6_language_model_scores": ORACLE}
