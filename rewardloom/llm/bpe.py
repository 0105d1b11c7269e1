"""Byte-pair encoding and decoding (operator 10).

A text is cut into special tokens and pieces by the tokenizer file's rules. Each
piece starts as a doubly linked list of byte symbols; a priority queue holds the
merge rank and place of every pair that may merge. The lowest rank merges first,
the leftmost of equal ones; entries whose pair has changed meanwhile are stale and skipped.
Decoding joins the bytes of the ids' vocabulary strings.

Texts go through Python in Arrow batches, cut so that no batch of results holds
more than about ``BATCH_CHARS`` characters besides one text. Each worker keeps the ids of
pieces it has met in two bounded generations. Nothing is shuffled, and the
tokenizer file, of fixed size, is the only thing broadcast.

Defined results: NULL and empty texts have no ids and decode to an empty text; rows are independent, so repeated
rows get equal results and an empty table an empty one; other columns pass through, and
a column with a result's name is an error at plan time.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.llm.common import table

#: How the byte-level family cuts texts into pieces: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in a generation of a worker's memory, and the longest one kept.
KEPT, KEPT_CHARS = 250_000, 40
BATCH_CHARS = 4_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class BytePairEncoder:
    """Encodes and decodes by a byte-level tokenizer file's content."""

    def __init__(self, content: str | bytes):
        import regex

        model = json.loads(content)
        vocabulary = model["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in symbols.items()}
        self.byte_ids = [vocabulary[symbols[b]] for b in range(256)]
        # Pair of ids, as one number, to the merge's rank and the merged id.
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocabulary[left] << 32 | vocabulary[right]
            self.ranks.setdefault(pair, (rank, vocabulary[left + right]))
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in piece.encode()]
        n, ranks = len(ids), self.ranks
        if n == 1:
            return (ids[0],)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # Rank and place as one number each: place needs the low 32 bits.
        queue = [r[0] << 32 | i for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at = entry & 0xFFFFFFFF
            right = after[at]
            if ids[at] < 0 or right >= n:
                continue
            found = ranks.get(ids[at] << 32 | ids[right])
            if found is None or found[0] != entry >> 32:
                continue
            ids[at], ids[right] = found[1], -1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                if r := ranks.get(ids[at] << 32 | ids[beyond]):
                    heapq.heappush(queue, r[0] << 32 | at)
            ahead = before[at]
            if ahead >= 0 and (r := ranks.get(ids[ahead] << 32 | ids[at])):
                heapq.heappush(queue, r[0] << 32 | ahead)
        return tuple(i for i in ids if i >= 0)

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, from the worker's memory where it is there."""
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merged(piece)
        if len(piece) <= KEPT_CHARS:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        parts = self.cut(text) if self.cut else [text]
        ids: list[int] = []
        for i, part in enumerate(parts):
            if i % 2:
                ids.append(self.special[part])
            elif part:
                pieces = self.find(part)
                # In slices, so that a text of any length only ever looks back into the two generations.
                get, slow = self.young.get, self.piece
                ids.extend(chain.from_iterable([get(p) or slow(p) for p in pieces]))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[bytes, BytePairEncoder] = {}


def encoder(content: bytes) -> BytePairEncoder:
    """One encoder per worker and tokenizer file."""
    if content not in _ENCODERS:
        _ENCODERS[content] = BytePairEncoder(content)
    return _ENCODERS[content]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_content(spark: SparkSession, path: str | None = None):
    """The tokenizer file, read by the driver, as a broadcast: executors need no copy of it."""
    with open(path or tokenizer_path(), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def slices(lengths: list[int], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with at most ``most`` characters, or one row."""
    start = total = 0
    for i, length in enumerate(lengths):
        if i > start and total + length > most:
            yield start, i - start
            start, total = i, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths) - start


def encode(docs: DataFrame, text_col: str = "text", ids: str = "ids", decoded: str | None = None, path: str | None = None) -> DataFrame:
    """``docs`` with the array column ``ids`` and, if named, the text decoded from it as column ``decoded``."""
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        added.append(T.StructField(decoded, T.StringType(), False))
    if clash := {c.name.lower() for c in added} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are in the table already")
    content = tokenizer_content(docs.sparkSession, path)
    at = docs.columns.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = encoder(content.value)
        names = None
        for batch in batches:
            names = [*batch.schema.names, *[f.name for f in added]]
            lengths = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            for start, n in slices(lengths):
                part = batch.slice(start, n)
                found = [np.array(coder.encode(t or ""), dtype=np.int32) for t in part.column(at).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                columns = [*part.columns, lists]
                if decoded:
                    columns.append(pa.array([coder.decode(x.tolist()) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(table_: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``table_`` with the text of its ids as column ``decoded``; NULL ids stay NULL."""
    content = tokenizer_content(table_.sparkSession, path)

    @F.pandas_udf("string")
    def text(series):
        coder = encoder(content.value)
        return series.map(lambda x: None if x is None else coder.decode(int(i) for i in x))

    return table_.withColumn(decoded, text(F.col(f"`{ids}`")))


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of an encoded table."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]


def byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the digests of every document's ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, decoded="decoded").drop("text")
    return encoded.select("doc_id", *digests(encoded))


QUERIES = {"op10_byte_pair_encoding": byte_pair_encoding}
ORACLES: dict[str, str] = {}
