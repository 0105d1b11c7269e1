"""Edit-aware token counts (operator 5).

Per document the tokens of each pre-token piece are kept at the leaves of a
segment tree, with the pieces' lengths. An edit re-encodes only the pieces it
touches and as much context as the cutting rule can look at: from the piece that holds
the third character before the edit and the white space in front of it, up to
the first new piece boundary that was one before. Then only the sums on the path from the changed
leaf to the root are renewed. Counts equal those of encoding the edited text anew.

Leaves are blocks of about ``LEAF`` pieces, so an edit's cost grows with the logarithm of a
document's length plus what it changes. Documents pass through Python in Arrow batches
and are never shuffled; a document's tree travels with it as a column.

Strings of special tokens count as ordinary text. Edits are (start, end, text) in
code points of the text before all of them, in any order and not overlapping; what reaches beyond the text is cut off, and
of overlapping edits (equal ones too) the later starts where the earlier ends. Defined results:
NULL and empty texts have no tokens, and edits can fill them; NULL or no edits change nothing; an
edit's NULL text deletes; repeated rows are counted each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.llm.bpe import BytePairEncoder, encoder, slices, tokenizer_content
from rewardloom.llm.common import column, table, unused

LEAF = 32

EDITS = "array<struct<start:int,end:int,text:string>>"


class PieceTree:
    """Lengths and token counts of a text's pieces, summed in a segment tree over blocks of pieces."""

    def __init__(self, pieces, sizes):
        """``pieces``: an array of (length, tokens) rows; ``sizes``: how many of them each block has."""
        import numpy as np

        ends = np.cumsum(sizes, dtype=np.int64) if len(sizes) else np.zeros(1, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        upto = np.zeros((len(pieces) + 1, 2), np.int64)
        np.cumsum(pieces, axis=0, out=upto[1:])
        # Blocks stay rows of the array until an edit touches them.
        self.blocks = [pieces[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.width = 1 << max(0, (len(self.blocks) - 1).bit_length())
        level = np.zeros((self.width, 2), np.int64)
        level[: len(ends)] = upto[ends] - upto[starts]
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(levels[-1][0::2] + levels[-1][1::2])
        # Node 1 is the root, node n has the children 2 n and 2 n + 1.
        nodes = np.concatenate([np.zeros((1, 2), np.int64), *levels[::-1]])
        self.chars, self.tokens = nodes[:, 0].tolist(), nodes[:, 1].tolist()

    @classmethod
    def of(cls, text: str, coder: BytePairEncoder) -> PieceTree:
        import numpy as np

        pieces = coder.find(text)
        get, slow = coder.young.get, coder.piece
        rows = np.empty((len(pieces), 2), np.uint32)
        rows[:, 0] = np.fromiter(map(len, pieces), np.uint32, len(pieces))
        rows[:, 1] = np.fromiter([len(get(p) or slow(p)) for p in pieces], np.uint32, len(pieces))
        return cls(rows, dealt(len(pieces)))

    def block(self, i: int) -> list[tuple[int, int]]:
        """A block's pieces as a list."""
        if not isinstance(self.blocks[i], list):
            self.blocks[i] = [tuple(p) for p in self.blocks[i].tolist()]
        return self.blocks[i]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def renew(self, block: int) -> None:
        """The sums from a block to the root."""
        node = self.width + block
        self.chars[node] = sum(p[0] for p in self.block(block))
        self.tokens[node] = sum(p[1] for p in self.block(block))
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def holding(self, at: int) -> tuple[int, int, int]:
        """(block, piece, start) of the piece that holds character ``at``; the end of the text is after the last piece."""
        if at >= self.chars[1]:
            last = len(self.blocks) - 1
            return last, len(self.blocks[last]), self.chars[1]
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.width
        for i, (length, _) in enumerate(self.block(block)):
            if at < start + length:
                return block, i, start
            start += length
        raise AssertionError("sums and pieces differ")

    def edit(self, text: str, start: int, end: int, new: str, coder: BytePairEncoder, pattern) -> tuple[str, int]:
        """The edited text, and how many pieces were encoded anew. ``text`` is the tree's text."""
        after = text[:start] + new + text[end:]
        grown = len(new) - (end - start)
        # The rule looks past a run of white space to what follows it, and two letters past an apostrophe.
        back = start
        while back > 0 and text[back - 1].isspace():
            back -= 1
        block, piece, begin = self.holding(max(0, back - 3))
        pieces: list[tuple[int, int]] = []
        old_block, old_piece, old_at = block, piece, begin
        synced = None
        for match in pattern.finditer(after, begin):
            stop = match.end()
            word = match.group()
            pieces.append((len(word), len(coder.young.get(word) or coder.piece(word))))
            # Old boundaries up to the same place; one beyond the edit ends the work.
            while old_at + grown < stop or old_at < end:
                if old_piece >= len(self.blocks[old_block]):
                    if old_block + 1 >= len(self.blocks):
                        break
                    old_block, old_piece = old_block + 1, 0
                    continue
                old_at += self.block(old_block)[old_piece][0]
                old_piece += 1
            if old_at >= end and old_at + grown == stop:
                synced = (old_block, old_piece)
                break
        if synced is None:
            synced = (len(self.blocks) - 1, len(self.blocks[-1]))
        last, upto = synced
        rest = self.block(last)[upto:]
        head = self.block(block)[:piece]
        if last == block:
            self.blocks[block] = head + pieces + rest
        else:
            self.blocks[block] = head + pieces
            for i in range(block + 1, last):
                if len(self.blocks[i]):
                    self.blocks[i] = []
                    self.renew(i)
            self.blocks[last] = rest
            self.renew(last)
        self.renew(block)
        if len(self.blocks[block]) > 64 * LEAF:
            # A block that took in much new text is dealt out again.
            rows = self.rows()
            self.__init__(rows, dealt(len(rows)))
        return after, len(pieces)

    def rows(self):
        import numpy as np

        return np.concatenate([np.asarray(b, np.uint32).reshape(-1, 2) for b in self.blocks])

    def packed(self) -> bytes:
        import numpy as np

        sizes = np.array([len(self.blocks), *map(len, self.blocks)], np.uint32)
        return sizes.tobytes() + self.rows().tobytes()

    @classmethod
    def unpacked(cls, state: bytes) -> PieceTree:
        import numpy as np

        numbers = np.frombuffer(state, np.uint32)
        n = int(numbers[0])
        return cls(numbers[n + 1 :].reshape(-1, 2), numbers[1 : n + 1])


def dealt(pieces: int) -> list[int]:
    """Sizes of blocks for so many pieces."""
    full, rest = divmod(pieces, LEAF)
    return [LEAF] * full + [rest] * (rest > 0 or not full)


def in_order(edits: Iterable | None, length: int) -> list[tuple[int, int, str]]:
    """Edits by start, cut to the text and to each other."""
    out, at = [], 0
    for e in sorted((e for e in edits or () if e is not None), key=lambda e: (e["start"] or 0, e["end"] or 0)):
        start = min(max(e["start"] or 0, at), length)
        end = min(max(e["end"] or 0, start), length)
        out.append((start, end, e["text"] or ""))
        at = end
    return out


def edited(text: str | None, state: bytes, edits: Iterable | None, coder: BytePairEncoder) -> tuple[str, PieceTree, int]:
    """The edited text, its tree, and the pieces encoded anew."""
    import regex

    from rewardloom.llm.bpe import PATTERN

    text, tree, work, moved = text or "", PieceTree.unpacked(state), 0, 0
    pattern = regex.compile(PATTERN)
    for start, end, new in in_order(edits, len(text)):
        text, n = tree.edit(text, start + moved, end + moved, new, coder, pattern)
        work += n
        moved += len(new) - (end - start)
    return text, tree, work


def _mapped(docs: DataFrame, added: list[T.StructField], inputs: list[str], row, path: str | None) -> DataFrame:
    """``docs`` with columns ``added``, filled by ``row(coder, *inputs)``, or replaced where they are there."""
    content = tokenizer_content(docs.sparkSession, path)
    names = [f.name for f in added]
    old = [f for f in docs.schema.fields if f.name not in names]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = encoder(content.value)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(inputs[0])), 0).to_pylist()
            for start, n in slices(lengths):
                part = batch.slice(start, n)
                found = [row(coder, *values) for values in zip(*[part.column(c).to_pylist() for c in inputs], strict=True)]
                new = [pa.array([f[i] for f in found], {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}[added[i].dataType.simpleString()]) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in old], *new], [*[f.name for f in old], *names])

    return docs.mapInArrow(run, T.StructType([*old, *added]))


def counted(docs: DataFrame, text: str = "text", state: str = "state", n_tokens: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``docs`` with each text's tree as column ``state`` and its tokens."""
    unused(docs, state, n_tokens)

    def row(coder, value):
        tree = PieceTree.of(value or "", coder)
        return tree.packed(), tree.total

    added = [T.StructField(state, T.BinaryType()), T.StructField(n_tokens, T.LongType())]
    return _mapped(docs, added, [text], row, path)


def updated(docs: DataFrame, edits: str = "edits", text: str = "text", state: str = "state", n_tokens: str = "n_tokens", work: str = "n_reencoded", path: str | None = None) -> DataFrame:
    """``docs`` with their column of edits applied to text, tree and tokens, and the pieces encoded anew."""

    # Text, state and tokens are the columns to be renewed; the number of pieces is a new one.
    unused(docs, work)
    if n_tokens not in docs.columns:
        unused(docs, n_tokens)

    def row(coder, value, old, changes):
        new, tree, n = edited(value, old, changes, coder)
        return new, tree.packed(), tree.total, n

    added = [T.StructField(text, T.StringType()), T.StructField(state, T.BinaryType()), T.StructField(n_tokens, T.LongType()), T.StructField(work, T.LongType())]
    return _mapped(docs, added, [text, state, edits], row, path)


def digit_edits(text: Column) -> Column:
    """Edits that write ``#`` for each run of five digits or more, and drop the text's first word with the white space after it."""
    runs, rest = F.regexp_extract_all(text, F.lit("[0-9]{5,}"), F.lit(0)), F.split(text, "[0-9]{5,}")
    none = F.array().cast(EDITS)

    def step(state, x):
        start = state.at + F.length(x.rest)
        end = start + F.length(x.run)
        edit = F.struct(start.alias("start"), end.alias("end"), F.lit("#").alias("text"))
        return F.struct(end.alias("at"), F.concat(state.edits, F.array(edit)).alias("edits"))

    pairs = F.filter(F.arrays_zip(rest.alias("rest"), runs.alias("run")), lambda x: x.run.isNotNull())
    digits = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("edits")), step, lambda s: s.edits)
    first = F.length(F.regexp_extract(text, r"^\S*\s*", 0))
    return F.concat(F.array(F.struct(F.lit(0).alias("start"), first.alias("end"), F.lit("").alias("text"))), F.when(text.rlike("[0-9]{5}"), digits).otherwise(none))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's tokens before and after edits, pieces encoded anew, and a digest of the edited text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = counted(docs.withColumn("edits", digit_edits(F.coalesce(column(docs, "text", "string"), F.lit("")))), n_tokens="n_before")
    after = updated(before, n_tokens="n_after")
    return after.select("doc_id", "n_before", "n_after", "n_reencoded", F.size("edits").cast("long").alias("n_edits"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op5_token_counts": token_counts}
ORACLES: dict[str, str] = {}
