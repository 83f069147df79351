"""Centroid clustering by Delta Lloyd over integer vectors: exact sums, and only what moved is compared.

A table of state keeps for every vector its components, its owner and its distance to it, and on the driver
lie the centroids with their vectors' counts and sums (K rows). A round reads the state once, task by task
and without a shuffle, and writes the next one: a vector whose owner stayed is compared with the changed
centroids alone, as its owner is still the nearest of the others; a vector whose owner moved is compared
with all. What changes hands goes as signed integers: each task subtracts its vectors from the clusters
that they leave and adds them to those that they join, so K rows a task are shuffled and summed, and the
new centroids are floors of the exact sums. Two states exist at a time.

A vector is kept if it has exactly `dims` components, none null or not finite; a component x becomes
floor(scale * x). Products are taken in doubles as long as they are exact there, else in 64-bit integers.

Defined results: equal distances go to the smaller centroid; vectors of equal hash (repeated ids) seed in
the order of their components; a null id is clustered, but seeds after all others; fewer vectors than
clusters give as many centroids as there are vectors; repeated rows are vectors of their own; an empty
table, or one with no kept vector, gives an empty result; further columns are ignored; a component beyond
2**26 in size raises an error before any round, as distances would not stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, record_batch, scratch, table

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: The greatest size of a component.
LARGEST = 1 << 26
#: Up to this size products of 64 components are exact in doubles.
_EXACT = 1 << 21

_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("was", pa.int32()), ("owner", pa.int32()), ("distance", pa.int64())])
_FORM = "vec_id bigint, v array<bigint>, was int, owner int, distance bigint"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of integers."""
    held = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    sound = (F.size("x") == dims) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("x", lambda x: F.floor(x * scale))
    small = F.forall("x", lambda x: F.abs(x) * scale <= LARGEST)
    fail = F.raise_error(F.lit(f"a component is beyond {LARGEST} in size")).cast("array<bigint>")
    return held.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.when(small, scaled).otherwise(fail).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least SHA-256 of `seed:id`, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), -1 if rows else 0)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of integer vectors, exact: a row for each of v."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


def assigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its distance; owner is -1 before the first round.

    changed: whether each centroid differs from that of the assignment before.
    """
    owner, distance = owner.copy(), distance.copy()
    moved = np.flatnonzero((owner < 0) | changed[owner])
    if len(moved):
        found = squared(v[moved], centroids)
        owner[moved] = found.argmin(1)  # the first of equals
        distance[moved] = found.min(1)
    stayed = np.ones(len(v), bool)
    stayed[moved] = False
    rest, some = np.flatnonzero(stayed), np.flatnonzero(changed)
    if len(rest) and len(some):
        found = squared(v[rest], centroids[some])
        best = found.argmin(1)
        near, number = found[np.arange(len(rest)), best], some[best]
        wins = (near < distance[rest]) | ((near == distance[rest]) & (number < owner[rest]))
        owner[rest[wins]] = number[wins]
        distance[rest[wins]] = near[wins]
    return owner, distance


def _next(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The state after an assignment; `was` is the owner before."""
    held = state.sparkSession.sparkContext.broadcast((centroids, changed))  # K rows

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                was = batch.column("owner").to_numpy()
                owner, distance = assigned(_matrix(batch.column("v"), batch.num_rows), was, batch.column("distance").to_numpy(), *held.value)
                yield record_batch(_STATE, [batch.column("vec_id"), batch.column("v"), was, owner, distance])

    return state.mapInArrow(kernel, _FORM)


def transfers(state: DataFrame, clusters: int) -> DataFrame:
    """(cluster, n, total): by how much the count and the sums of each cluster change from `was` to `owner`."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(clusters, np.int64), None
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), batch.num_rows)
                total = np.zeros((clusters, v.shape[1]), np.int64) if total is None else total
                for sign, name in ((-1, "was"), (1, "owner")):
                    at = batch.column(name).to_numpy()
                    for c in np.unique(at[at >= 0]).tolist():
                        n[c] += sign * int((at == c).sum())
                        total[c] += sign * v[at == c].sum(0)
        if total is not None:
            some = np.flatnonzero((n != 0) | total.any(1)).tolist()
            yield record_batch(schema, [some, n[some], total[some].tolist()])

    part = state.where("owner <> was").select("v", "was", "owner").mapInArrow(kernel, "cluster int, n bigint, total array<bigint>")
    entry = part.select("cluster", "n", F.posexplode("total").alias("i", "x"))
    summed = entry.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return summed.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("total"))


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The last state (vec_id, v, was, owner, distance) of vectors(vec_id, v), and the last centroids."""
    spark = vectors.sparkSession
    path = scratch(spark, "state")
    vectors.select("vec_id", "v", F.lit(-1).alias("was"), F.lit(-1).alias("owner"), F.lit(0).cast("bigint").alias("distance")).write.option("compression", "zstd").parquet(path)
    state = spark.read.schema(_FORM).parquet(path)
    centroids = first_centroids(state, clusters, seed)
    changed = np.ones(len(centroids), bool)
    count, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for step in range(rounds + 1 if len(centroids) else 0):
        target = scratch(spark, "state")
        _next(state, centroids, changed).write.option("compression", "zstd").parquet(target)
        dropped(spark, path)
        path, state = target, spark.read.schema(_FORM).parquet(target)
        if step == rounds:
            break
        for r in transfers(state, len(centroids)).collect():  # a row a cluster
            count[r.cluster] += r.n
            total[r.cluster] += np.array(r.total, np.int64)
        full = np.flatnonzero(count)
        after = centroids.copy()
        after[full] = total[full] // count[full, None]  # floors, for negative sums too
        changed, centroids = (after != centroids).any(1), after
    return state, centroids


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each of vectors(vec_id, v)."""
    state, centroids = lloyd(vectors, clusters, rounds, seed)
    form = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    sums = {r.owner: r.d for r in state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}  # a row a cluster
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, d, sum(sums.values()), digest[c]) for c, d in sums.items()]
    named = state.sparkSession.createDataFrame(rows, form)
    found = state.select("vec_id", F.col("owner").alias("cluster"), "distance").join(F.broadcast(named), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(integer_vectors(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """The same rounds as joins of components."""
    steps = [
        f"kept AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) AS id, e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WHERE len(e) = {DIMS} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"comp AS MATERIALIZED (SELECT id, i, CAST(floor({SCALE} * e[i]) AS BIGINT) AS x FROM kept, range(1, {DIMS + 1}) r(i))",
        f"cent0 AS MATERIALIZED (SELECT id - 1 AS c, i, x FROM comp WHERE id <= {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        steps += [
            f"own{r} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT id, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS d FROM comp p JOIN cent{r} q USING (i) GROUP BY id, c) GROUP BY id)",
            f"cent{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) / n AS BIGINT) END AS x FROM cent{r} LEFT JOIN (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM comp JOIN own{r} USING (id) GROUP BY c, i) USING (c, i))",
        ]
    return f"""
        WITH {', '.join(steps[:-1])},
        seal AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM cent{ROUNDS} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM own{ROUNDS} JOIN kept USING (id) JOIN seal USING (c)"""


SQL = _sql()
