"""Toxicity by nearest labelled examples (operator 1).

A bounded sample of the labelled documents, the lowest digests of either class, is the set of examples.
Terms are chosen by how well they tell the classes apart in it (chi-squared), and
weighed by their inverse document frequency over all documents, labelled or not. A
document's score is the vote of the ``NEIGHBOURS`` examples with the greatest TF-IDF cosine,
each with the weight exp(-distance / WIDTH), brought to a probability by isotonic regression
over the examples' own votes, each left out of its vote.

The nearest examples are exact: an inverted index holds the examples' weights per
term in blocks of ``BLOCK`` examples, with each block's greatest weight. A query bounds
every block by the sum of its greatest weights and scores blocks from the highest bound
down until no bound exceeds the worst neighbour found.

Only the index is broadcast; its size is bounded by ``EXAMPLES`` and ``TERMS``, what the driver reads by ``EXAMPLES`` and
``EXAMPLE_CHARS``. Documents are not shuffled.

Terms are runs of letters, lower-cased, and their first four and five letters. Defined results: NULL and empty texts, and those without a
chosen term, score the share of label 1 among such examples (of all examples, if there are none); equal texts score alike; documents with several labels count once per
label; without examples every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm.common import table

#: Most examples per class, and the longest text that serves as one.
EXAMPLES, EXAMPLE_CHARS = 1500, 20_000
#: Most chosen terms, in how many examples a term must be, and the least chi-squared value, in all and per example.
TERMS, LEAST_EXAMPLES, LEAST_CHI, LEAST_PHI = 512, 4, 15.0, 0.02
#: Lengths of word beginnings that are terms too.
PREFIXES = (4, 5)
NEIGHBOURS, WIDTH, BLOCK = 15, 0.15, 64
#: Score from which a document counts as toxic: fixed value.
TOXIC = 0.7

WORDS = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> list[str]:
    """Words, and the first letters of longer ones: inflected forms share these."""
    words = WORDS.findall(text.lower()) if text else []
    return words + [w[:n] + "*" for n in PREFIXES for w in words if len(w) > n]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def chosen_terms(texts: list[str], labels: list[int], most: int = TERMS) -> list[str]:
    """The terms that tell the classes apart best, by the chi-squared statistic of having them."""
    n, positives = len(labels), sum(labels)
    having, toxic = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        terms = set(terms_of(text))
        having.update(terms)
        if label:
            toxic.update(terms)
    ranked = []
    for term, k in having.items():
        if LEAST_EXAMPLES <= k < n:
            a = toxic[term]
            chi = n * (a * (n - positives) - (k - a) * positives) ** 2 / (k * (n - k) * max(1, positives) * max(1, n - positives))
            if chi >= max(LEAST_CHI, LEAST_PHI * n):
                ranked.append((-chi, term))
    return [t for _, t in sorted(ranked)[:most]]


def isotonic(votes, labels, weights):
    """Points (vote, probability) of the weighted isotonic regression of labels on votes."""
    import numpy as np

    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weights[order].tolist(), strict=True):
        # Sum of weights, of weighted labels and of weighted votes.
        pools.append([w, w * y, w * v, v])
        while len(pools) > 1 and (pools[-1][3] == pools[-2][3] or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            w2, y2, v2, last = pools.pop()
            pools[-1] = [pools[-1][0] + w2, pools[-1][1] + y2, pools[-1][2] + v2, last]
    return [p[2] / p[0] for p in pools], [p[1] / p[0] for p in pools]


class Index:
    """Examples' unit TF-IDF vectors as a block-max inverted index."""

    def __init__(self, terms: list[str], idf, texts: list[str], labels: list[int], class_weights: tuple[float, float] = (1.0, 1.0)):
        import numpy as np

        self.terms, self.idf = {t: i for i, t in enumerate(terms)}, np.asarray(idf, np.float64)
        vectors = [self.vector(t) for t in texts]
        # Examples with the same heaviest term stand together, so that a block's bounds are tight; those without a term
        # share no term with any query, and only count for queries without one.
        order = sorted((int(ids[np.argmax(w)]), i) for i, (ids, w) in enumerate(vectors) if len(ids))
        without = [labels[i] for i, (ids, _) in enumerate(vectors) if not len(ids)]
        weigh = lambda ys: (sum(class_weights[y] * y for y in ys), sum(class_weights[y] for y in ys))
        self.class_weights = class_weights
        self.examples = [i for _, i in order]
        self.labels = np.array([labels[i] for i in self.examples], np.float64)
        n = len(self.examples)
        self.n_blocks = -(-n // BLOCK)
        self.greatest = np.zeros((len(terms), self.n_blocks))
        # Postings by block, then term: starts[block][term] .. starts[block][term + 1].
        self.starts, self.rows, self.weights = [], [], []
        for block in range(self.n_blocks):
            postings = []
            for row, i in enumerate(self.examples[block * BLOCK : (block + 1) * BLOCK]):
                ids, w = vectors[i]
                postings += [(int(t), row, float(x)) for t, x in zip(ids, w, strict=True)]
                np.maximum.at(self.greatest[:, block], ids, w)
            postings.sort()
            ids = np.array([p[0] for p in postings], np.int64)
            self.starts.append(np.searchsorted(ids, np.arange(len(terms) + 1)))
            self.rows.append(np.array([p[1] for p in postings], np.int64))
            self.weights.append(np.array([p[2] for p in postings]))
        toxic, all_ = weigh(without)
        base, all_labels = weigh(labels)
        self.prior = toxic / all_ if all_ else (base / all_labels if all_labels else 0.0)
        if n > 1:
            votes = np.array([self.vote(vectors[i], skip=k)[0] for k, i in enumerate(self.examples)])
            weights = np.array([class_weights[int(y)] for y in self.labels])
            self.votes, self.odds = isotonic(votes, self.labels, weights)
        else:
            self.votes, self.odds = [0.0], [self.prior]

    def vector(self, text: str | None):
        """(term numbers, weights) of length one."""
        import numpy as np

        get = self.terms.get
        found = Counter([i for w in terms_of(text) if (i := get(w)) is not None])
        ids = np.array(sorted(found), np.int64)
        w = np.array([found[i] for i in ids.tolist()], np.float64) * self.idf[ids]
        length = np.sqrt((w * w).sum())
        return (ids, w / length) if length > 0 else (ids[:0], w[:0])

    def nearest(self, vector, skip: int | None = None, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples with the greatest cosine, ties to the earlier example: (-cosine, example)."""
        import heapq

        import numpy as np

        ids, w = vector
        bounds = w @ self.greatest[ids]
        found: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            # Slack for sums taken in another order.
            if len(found) == k and bounds[block] < -found[-1][0] - 1e-9:
                break
            starts = self.starts[block]
            scores = np.zeros(BLOCK)
            for t, x in zip(ids.tolist(), w.tolist(), strict=True):
                a, b = starts[t], starts[t + 1]
                if a < b:
                    scores[self.rows[block][a:b]] += x * self.weights[block][a:b]
            size = min(BLOCK, len(self.examples) - block * BLOCK)
            own = [(-s, block * BLOCK + i) for i, s in enumerate(scores[:size].round(12).tolist()) if block * BLOCK + i != skip]
            found = heapq.nsmallest(k, found + own)
        return found

    def vote(self, vector, skip: int | None = None) -> tuple[float, list[tuple[float, int]]]:
        """Share of label 1 among the nearest, each weighed by its distance and its class's share of all labelled rows."""
        import math

        found = self.nearest(vector, skip)
        weights = [math.exp((-s - 1) / WIDTH) * self.class_weights[int(self.labels[i])] for s, i in found]
        total = sum(weights)
        return (sum(w * self.labels[i] for w, (_, i) in zip(weights, found, strict=True)) / total if total else self.prior), found

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """Calibrated probability, and the nearest examples as evidence."""
        import numpy as np

        vector = self.vector(text)
        if not len(vector[0]) or not len(self.examples):
            return float(self.prior), []
        vote, found = self.vote(vector)
        return float(np.interp(vote, self.votes, self.odds)), found


def examples_of(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> tuple[list, list, list, tuple[float, float]]:
    """Identifiers, texts and labels of the examples, and how many labelled rows an example of each class stands for."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").where(~held_out(F.col("id")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64(F.col("id"), F.lit("example")), "id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    rows = ids.join(docs.select(F.col("doc_id").alias("id"), "text").where(F.length("text") <= EXAMPLE_CHARS), "id").orderBy("toxic", "id", F.xxhash64("text")).collect()
    n = Counter(r["toxic"] for r in rows)
    weights = tuple(sizes.get(y, 0) / n[y] if n[y] else 1.0 for y in (0, 1))
    return [r["id"] for r in rows], [r["text"] for r in rows], [r["toxic"] for r in rows], weights


def document_frequencies(docs: DataFrame, terms: list[str], text: str = "text") -> tuple[int, list[int]]:
    """Rows, and rows that have each of the given terms, over the whole table."""
    places = {t: i for i, t in enumerate(terms)}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, counts = 0, np.zeros(len(places) + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                found = [i for w in set(terms_of(t)) if (i := places.get(w)) is not None]
                counts[found] += 1
        counts[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], ["term", "n"])

    found = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r["term"]: r["n"] for r in found}
    return sums.get(len(terms), 0), [sums.get(i, 0) for i in range(len(terms))]


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Index, list]:
    """The index over the examples, and their identifiers in its order."""
    import numpy as np

    ids, texts, ys, weights = examples_of(docs, labels)
    terms = chosen_terms(texts, ys)
    n, counts = document_frequencies(docs, terms)
    index = Index(terms, np.log((1 + n) / (1 + np.array(counts, np.float64))) + 1, texts, ys, weights)
    return index, [ids[i] for i in index.examples]


def scored(docs: DataFrame, index: Index, ids: list, text: str = "text", evidence: int = 3) -> DataFrame:
    """``row`` (all columns), score, and the ``evidence`` nearest examples with their cosines."""
    model = docs.sparkSession.sparkContext.broadcast((index, ids))

    def run(batches):
        import pyarrow as pa

        index, ids = model.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        for batch in batches:
            found = [index.score(t) for t in batch.column(1).to_pylist()]
            near = [[{"doc_id": ids[i], "cosine": -s} for s, i in f[1][:evidence]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array(near, kind)], ["row", "score", "evidence"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    from pyspark.sql import types as T

    near = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("evidence", near)]))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the score of every document, whether its label was held out, and the nearest examples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index, ids = fitted(docs, table(spark, sf_dir, "labels"))
    found = scored(docs, index, ids)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


QUERIES = {"op1_toxicity": toxicity}
ORACLES: dict[str, str] = {}
