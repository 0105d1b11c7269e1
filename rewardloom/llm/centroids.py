"""Centroid clustering with geometric drift tightening (operator 12).

Lloyd's rounds over whole-number vectors. Every vector keeps its cluster and a lower bound on its distance to all other centroids.

1. A round's means are exact: sums by partial aggregation, divided as whole numbers on the driver (``clusters`` x components numbers).
2. When centroids move, a lower bound must fall by as much as some other centroid may have come nearer. The full drift is
   the plain amount. Tighter: all vectors of a cluster lie in a sphere around its old centroid, and in the plane through that centroid and the line of
   another one's move, the gain of a point x is at most drift * cos(angle between the move and x, seen from the move's midpoint), and at most
   twice x's projection beyond the midpoint. The sphere's best point gives the amount for the whole cluster: nothing where
   a centroid moves away from it. (With foci at both ends of the move: d1^2 - d2^2 = 2 drift X, and d1 + d2 >= 2 |x - midpoint| and >= drift.)
3. A vector whose distance to its own moved centroid is under its bound stays; it cost one distance. All others are scanned exactly.

Each round reads the vectors with their state and writes them with the new one; the table before goes. There is no shuffle of
vectors, so neither hot clusters nor very many equal vectors meet in one task. Distances are exact 64-bit whole numbers, bounds have a margin for rounding.

Defined results: vectors that are NULL, of another length, or with a NULL or non-finite component are left out; repeated rows each
get their row; equal distances go to the smaller number; fewer vectors than ``clusters`` start as many centroids as there are (NULL and equal identifiers in order of their
vectors, NULL last); an empty table gives no rows; other columns are ignored. Components whose whole number is beyond 2^27 are an error, as squared distances would
leave 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm.common import table
from rewardloom.scratch import discard, materialize

#: Components of a vector, the factor before the floor, centroids and rounds.
SIZE, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Largest magnitude of a component.
LARGEST = 1 << 27
#: Share of the largest distance that bounds give way for rounding.
MARGIN = 1e-9

STATE = "id long, v array<long>, cluster int, distance long, lower double, scans int"


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id, v): the kept vectors as whole numbers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(good).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def drift_bounds(old, new, radius):
    """By cluster: by how much any other centroid may have come nearer to any vector within ``radius`` of the cluster's old centroid."""
    import numpy as np

    a, b, r = old[:, None, :].astype(float), old.astype(float), np.asarray(radius, float)
    move = new.astype(float) - b
    drift = np.sqrt((move**2).sum(axis=1))
    unit = move / np.where(drift > 0, drift, 1)[:, None]
    off = a - (b + move / 2)[None, :, :]
    away = np.sqrt((off**2).sum(axis=2))
    ahead = (off * unit[None, :, :]).sum(axis=2)
    inside = away <= r[:, None]
    # Seen from the midpoint, the sphere spans this angle to either side of its centre.
    spread = np.arcsin(np.clip(r[:, None] / np.where(inside, 1, away), 0, 1) * ~inside)
    angle = np.arccos(np.clip(ahead / np.where(away > 0, away, 1), -1, 1))
    turned = np.where(inside, 1.0, np.cos(np.clip(angle - spread, 0, np.pi)))
    gain = np.minimum(np.minimum(drift[None, :], drift[None, :] * turned), 2 * (ahead + r[:, None]))
    gain = np.maximum(gain, 0)
    np.fill_diagonal(gain, 0)
    return gain.max(axis=1, initial=0)


def distances(v, centroids):
    """Squared distances of all vectors to all centroids, as whole numbers."""
    import numpy as np

    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scanned(v, centroids):
    """Nearest centroid, its squared distance, and the distance to the second nearest."""
    import numpy as np

    d = distances(v, centroids)
    near = d.argmin(axis=1)
    own = d[np.arange(len(v)), near]
    d[np.arange(len(v)), near] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1)) if len(centroids) > 1 else np.full(len(v), np.inf)
    return near, own, lower


def moved(v, cluster, lower, centroids, bounds):
    """As ``scanned`` after a move, and which vectors were scanned: only those whose bound doesn't settle it."""
    import numpy as np

    own = ((v - centroids[cluster]) ** 2).sum(axis=1)
    lower = lower - bounds[cluster]
    room = MARGIN * (1 + np.sqrt(own) + np.where(np.isfinite(lower), np.abs(lower), 0))
    open_ = ~(np.sqrt(own) + room < lower - room)
    near = cluster.copy()
    if open_.any():
        near[open_], own[open_], lower[open_] = scanned(v[open_], centroids)
    return near, own, lower, open_


def assigned(rows: DataFrame, centroids, bounds=None) -> DataFrame:
    """The state after assigning every vector; ``bounds`` by cluster where there is a state before."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            v = flat.reshape(batch.num_rows, -1)
            if len(flat) and np.abs(flat).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}")
            if not len(flat):
                continue
            if bounds is None:
                near, own, lower = scanned(v, centroids)
                scans = np.ones(len(v), np.int32)
            else:
                near, own, lower, again = moved(v, batch.column("cluster").to_numpy(), batch.column("lower").to_numpy(), centroids, bounds)
                scans = batch.column("scans").to_numpy() + again
            arrays = [batch.column("id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(own, pa.int64()), pa.array(lower, pa.float64()), pa.array(scans, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "v", "cluster", "distance", "lower", "scans"])

    return rows.mapInArrow(run, STATE)


def first_centroids(rows: DataFrame, clusters: int, seed: int):
    """The vectors with the smallest digests of seed and identifier."""
    import numpy as np

    found = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("k"), "v")
    return np.array([r["v"] for r in found.orderBy(F.asc_nulls_last("k"), "v").limit(clusters).collect()], dtype=np.int64)


def next_centroids(state: DataFrame, centroids):
    """Means of the clusters, empty ones as they were, and the radius of each cluster around its present centroid."""
    import numpy as np

    sums = [F.sum(F.col("v")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
        radius[r["cluster"]] = np.sqrt(r["far"]) * (1 + MARGIN)
    return new, radius


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1):
    """(id, v, cluster, distance, lower, scans) of ``vectors`` (id, v) after the rounds, and the final centroids."""
    rows = materialize(vectors, "vectors")
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], STATE), centroids
    state, bounds = rows, None
    for _ in range(rounds):
        before, state = state, materialize(assigned(state, centroids, bounds), "assigned")
        discard(before)
        new, radius = next_centroids(state, centroids)
        bounds, centroids = drift_bounds(centroids, new, radius), new
    before, state = state, materialize(assigned(state, centroids, bounds), "assigned")
    discard(before)
    return state, centroids


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every kept vector's cluster, with the clusters' inertia and centroids."""
    import hashlib

    state, centroids = clustered(whole_vectors(table(spark, sf_dir, "embeddings")))
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    total = sums.agg(F.sum("own").alias("all"))
    # One row per centroid, whatever the input.
    per = sums.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(total))
    per = per.select("cluster", F.col("own").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), "centroid_sha256")
    return state.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {"op12_centroid_clusters": centroid_clusters}


def _assignment(k: int) -> str:
    """SQL of round ``k``: a{k} assigns to c{k}, c{k + 1} has the means."""
    nearest = f"""a{k} AS (SELECT rid, min({{'d': d, 'cluster': cluster}}) AS best FROM (
        SELECT rid, cluster, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{k} c USING (i) GROUP BY rid, cluster) GROUP BY rid)"""
    means = f"""c{k + 1} AS (SELECT c.cluster, c.i, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
        SELECT best.cluster AS cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM x JOIN a{k} USING (rid) GROUP BY 1, 2) m ON m.cluster = c.cluster AND m.i = c.i)"""
    return f"{nearest}, {means}" if k < ROUNDS else nearest


ORACLE = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
x AS MATERIALIZED (SELECT rid, unnest(range({SIZE})) AS i, unnest(v) AS x FROM k),
c0 AS (SELECT cluster, i, x FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM k) USING (rid) WHERE cluster < {CLUSTERS}),
{", ".join(_assignment(k) for k in range(ROUNDS + 1))},
n AS (SELECT cluster, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster),
r AS (SELECT vec_id, best.cluster AS cluster, best.d::BIGINT AS distance FROM a{ROUNDS} JOIN k USING (rid))
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM r JOIN n USING (cluster)"""

ORACLES = {"op12_centroid_clusters": ORACLE}
