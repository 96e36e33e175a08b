"""Centroid clustering of integer vectors by sort-means.

Each round the driver orders, for each of its few centroids, the other ones by their distance from it.  A task takes the vectors of one
previous assignment together: it scans the other centroids in that order and leaves off strictly beyond twice the distance to the previous
one, where by the triangle inequality none can be nearer.  All distances are exact integers, so ties are ties.  A round reads the
vectors with their assignments and writes them again with the new ones; sums by cluster are folded inside the tasks and leave them as one row for
each cluster and batch of work, in the same write, so no vector is shuffled and no cluster, however large, meets in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, written

#: Components are below this in size, so that four times a squared distance of 64 of them fits 64 bits.
LARGEST = 1 << 26
#: Components of all centroids together: they go to every task, 8 bytes each.
CENTROID_CELLS = 1 << 20


def quantised(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, q): floor(scale * x) of vectors with exactly ``dim`` components, none of them null or non-finite; others are left out, ids stay as they are."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # a null component makes the test null, which leaves the vector out as well
    whole = v.where(F.size("v") == dim).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    q = F.transform("v", lambda x: F.floor(x * scale))
    return whole.select("vec_id", F.when(F.forall("v", lambda x: F.abs(x * scale) < LARGEST), q.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}"))).alias("q"))


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``; ties (a repeated id) by components, null ids last."""
    rows = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "q").limit(k).select("q").collect()
    return np.array([r.q for r in rows], np.int64)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid the others by ascending squared distance (ties: smaller number), and these distances."""
    k = len(centroids)
    d = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    order = np.argsort(np.where(np.eye(k, dtype=bool), -1, d), axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(d, order, 1)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector and the number of distances measured, from its previous cluster on."""
    best, dist, measured = before.copy(), ((x - centroids[before]) ** 2).sum(1), len(x)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        rows = rows[np.argsort(-dist[rows], kind="stable")]
        reach = 4 * dist[rows]  # descending: who still looks on is a prefix
        near, who = dist[rows], np.full(len(rows), a)
        for j, far in zip(order[a], apart[a]):
            n = int(np.searchsorted(-reach, -far, "right"))
            if not n:
                break
            measured += n
            d = ((x[rows[:n]] - centroids[j]) ** 2).sum(1)
            closer = (d < near[:n]) | ((d == near[:n]) & (j < who[:n]))
            near[:n][closer], who[:n][closer] = d[closer], j
        dist[rows], best[rows] = near, who
    return best, dist, measured


_ROWS = "kind int, vec_id long, q array<int>, cluster int, distance long, n long, sums array<long>"


def _round(vectors: DataFrame, centroids: np.ndarray, dim: int, final: bool) -> DataFrame:
    """kind 0: each vector with its cluster, in the final round with its distance in place of the components; kind 1: a task's vectors, sums (distance's sum in the final round) by cluster."""
    order, apart = neighbours(centroids)
    k = len(centroids)

    def run(it):
        n, sums = np.zeros(k, np.int64), np.zeros((k, 1 if final else dim), np.int64)
        for b in it:
            if not b.num_rows:
                continue
            q = b.column("q")
            x = q.flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            best, dist, _ = assign(x, b.column("cluster").to_numpy().astype(np.int64), centroids, order, apart)
            n += np.bincount(best, minlength=k)
            np.add.at(sums, best, dist[:, None] if final else x)
            none = lambda kind: pa.nulls(b.num_rows, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(b.num_rows, np.int32)), b.column("vec_id"), none(pa.list_(pa.int32())) if final else q, pa.array(best.astype(np.int32)), pa.array(dist) if final else none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64()))],
                ["kind", "vec_id", "q", "cluster", "distance", "n", "sums"],
            )
        some = np.flatnonzero(n)
        none = lambda kind: pa.nulls(len(some), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(some), np.int32)), none(pa.int64()), none(pa.list_(pa.int32())), pa.array(some.astype(np.int32)), none(pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            ["kind", "vec_id", "q", "cluster", "distance", "n", "sums"],
        )

    return vectors.mapInArrow(run, _ROWS)


def _totals(table: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Vectors and sums of each cluster: tasks' rows are summed by component, what comes here is a number for each centroid's component."""
    parts = table.where("kind = 1").select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("p", "s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "p").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("cluster", "p").collect():
        out.setdefault(r.cluster, (int(r.n), []))[1].append(int(r.s))
    return out


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[dict]]:
    """((vec_id, cluster, distance) of each vector that is kept, [{n, inertia, centroid} by cluster]) after ``rounds`` rounds and a last assignment.

    Vectors are kept if they have exactly ``dim`` components, none null or non-finite; components become floor(scale * x).  The
    first centroids are the k vectors with the smallest hash of ``seed:id`` (fewer vectors, fewer centroids; a null id comes last).  The nearest centroid wins, at a
    tie the smaller number.  New centroids are the floor of sum / count; a cluster without vectors keeps its own.  Rows that repeat an id are
    vectors of their own.  No vector: an empty table.  Columns other than id and vector play no part.  A component of ``LARGEST`` or more is an error.
    """
    if k < 1 or k * dim > CENTROID_CELLS:
        raise ValueError(f"k * dim must be from 1 to {CENTROID_CELLS}")
    bounded_batches(vectors.sparkSession)
    q = quantised(vectors, dim, scale, id_col, vector_col)
    centroids = starts(q, k, seed)
    if not len(centroids):
        return q.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    now, last = q.withColumn("cluster", F.lit(0)), None
    for _ in range(rounds):
        table = written(_round(now, centroids, dim, False), "vectors", "kind")
        if last is not None:
            discard(last)
        for c, (n, sums) in _totals(table).items():
            centroids[c] = [s // n for s in sums]
        now, last = table.where("kind = 0").select("vec_id", "q", "cluster"), table
    table = written(_round(now, centroids, dim, True), "clusters", "kind")
    if last is not None:
        discard(last)
    totals = _totals(table)
    about = [{"n": totals.get(c, (0, [0]))[0], "inertia": totals.get(c, (0, [0]))[1][0], "centroid": centroids[c].tolist()} for c in range(len(centroids))]
    return table.where("kind = 0").select("vec_id", "cluster", "distance"), about


def op11_sort_means(spark, sf_dir):
    """Each kept vector of embeddings with its cluster after three rounds of 16 centroids; see ``cluster`` for nulls, ties, repeats and empty tables."""
    rows, about = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = [(c, a["inertia"], hashlib.sha256(",".join(map(str, a["centroid"])).encode()).hexdigest()) for c, a in enumerate(about)]
    per = spark.createDataFrame(digest, "cluster int, cluster_inertia long, centroid_sha256 string")  # a row for each centroid
    total = F.lit(sum(a["inertia"] for a in about)).cast("long")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    sql = f"""
WITH kept AS (SELECT row_number() OVER () AS rn, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT rn, vec_id, unnest(range(64)) AS p, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
first AS (SELECT rn, row_number() OVER (ORDER BY h, es) - 1 AS c FROM (SELECT rn, sha256('1:' || vec_id) AS h, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS es FROM kept) QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, p, x FROM q JOIN first USING (rn))"""
    assigned = "SELECT rn, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT rn, c, sum((q.x - k.x) * (q.x - k.x)) AS d FROM q JOIN {c} k USING (p) GROUP BY rn, c) GROUP BY rn"
    for r in range(rounds):
        sql += f""",
a{r} AS MATERIALIZED ({assigned.format(c=f"c{r}")}),
c{r + 1} AS MATERIALIZED (SELECT o.c, o.p, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT c, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{r} JOIN q USING (rn) GROUP BY c, p) m USING (c, p))"""
    return (
        sql
        + f""",
f AS MATERIALIZED ({assigned.format(c=f"c{rounds}")}),
i AS (SELECT c, sum(d)::BIGINT AS ci FROM f GROUP BY c), s AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p)) AS sh FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, ci AS cluster_inertia, (SELECT sum(ci) FROM i)::BIGINT AS inertia, sh AS centroid_sha256
FROM f JOIN kept USING (rn) JOIN i USING (c) JOIN s USING (c)"""
    )


ORACLE = _oracle()
