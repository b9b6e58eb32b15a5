"""Plain Lloyd clustering in integers.

Vectors become integers once; then each round sends the centroids to all tasks, which compute squared differences to
each of them, and the tasks' integer sums meet in one group-by. All arithmetic is exact, so results don't depend on how
the vectors are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import _scratch, _text

#: Components beyond this have no squared distance that is sure to fit into 64 bits; such vectors take no part.
LARGEST = 1 << 27


def _integers(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """vec_id and the components as bytes (little-endian, 32 bits) of the vectors that take part."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            full = np.flatnonzero(lengths == size)
            part = batch.take(pa.array(full))
            values = part.column("vector").flatten()
            x = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)  # null becomes NaN
            with np.errstate(invalid="ignore"):
                x = np.floor(x * scale)
                sound = (np.abs(x) < LARGEST).all(axis=1)
            whole = x[sound].astype("<i4").tobytes()
            step = 4 * size
            yield pa.RecordBatch.from_arrays([part.column("vec_id").filter(pa.array(sound)), pa.array([whole[i : i + step] for i in range(0, len(whole), step)], pa.binary())], ["vec_id", "x"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return _text.bounded(vectors).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(convert, f"vec_id {kind}, x binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (of equally near ones the smallest) and the squared distance to it."""
    distances = np.empty((len(centroids), len(x)), dtype=np.int64)
    for k, c in enumerate(centroids):
        off = x - c
        distances[k] = (off * off).sum(axis=1)
    own = distances.argmin(axis=0)
    return own, distances[own, np.arange(len(x))]


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(-1, size).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[int], list[list[int]]]:
    """Of each cluster the number of vectors, the sum of their distances and the sums of their components."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, size = centroids.shape

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, size + 2), dtype=np.int64)
        for frame in frames:
            x = _matrix(frame["x"], size)
            own, distance = nearest(x, shared.value)
            columns = np.column_stack([np.ones(len(x), dtype=np.int64), distance, x])
            order = np.argsort(own, kind="stable")
            heads = np.flatnonzero(np.diff(own[order], prepend=-1))
            if len(order):
                total[own[order][heads]] += np.add.reduceat(columns[order], heads, axis=0)
        yield pd.DataFrame({"cluster": np.repeat(np.arange(k), size + 2), "column": np.tile(np.arange(size + 2), k), "value": total.ravel()})

    parts = vectors.select("x").mapInPandas(partial, "cluster int, column int, value long")
    rows = parts.groupBy("cluster", "column").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # a row a component
    table = [[0] * (size + 2) for _ in range(k)]
    for r in rows:
        table[r.cluster][r.column] = int(r.value)
    return np.array([t[0] for t in table]), [t[1] for t in table], [t[2:] for t in table]


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors of exactly ``size`` components take part, if none is null, not finite, or 2**27 and more when scaled;
    components become ``floor(scale * x)``. The first centroids are the vectors whose ``salt:vec_id`` has the smallest
    SHA-256 (a null id never; of rows with one id the one with the smaller components first); there are fewer if there
    are fewer vectors. Each round moves non-empty centroids to the floor of their vectors' means. Repeated rows count
    each; an empty table gives no rows; vectors with a null id are clustered like others, unless no vector has an id:
    then there are no centroids and no rows. Other columns are not read.
    """
    stored = _scratch.stage(_integers(vectors, id_col, vector_col, size, scale), "integers")
    spark = vectors.sparkSession
    sha = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    # As many rows as centroids: each task keeps that many.
    chosen = stored.where("vec_id is not null").withColumn("sha", sha).orderBy("sha").limit(clusters).select(F.max("sha")).first()[0]
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if chosen is None:
        return spark.createDataFrame([], schema)
    counted = stored.where("vec_id is not null").withColumn("sha", sha).where(F.col("sha") <= chosen).groupBy("sha", "x").count()
    first = sorted(((r.sha, tuple(np.frombuffer(r.x, "<i4").tolist()), r["count"]) for r in counted.collect()))
    starts = [x for _, x, n in first for _ in range(min(n, clusters))][:clusters]
    centroids = np.array(starts, dtype=np.int64)
    for _ in range(rounds):
        n, _, sums = _sums(stored, centroids)
        centroids = np.array([[s // int(m) for s in row] if m else old.tolist() for m, row, old in zip(n, sums, centroids, strict=True)], dtype=np.int64)
    _, inertia, _ = _sums(stored, centroids)
    shared = spark.sparkContext.broadcast((centroids, np.array(inertia, dtype=np.int64), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle, inertia, shas = shared.value
        for frame in frames:
            own, distance = nearest(_matrix(frame["x"], size), middle)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": own, "distance": distance, "cluster_inertia": inertia[own], "inertia": inertia.sum(), "centroid_sha256": np.array(shas, dtype=object)[own]})

    return stored.mapInPandas(assign, schema)


#: The query's rows: each round is one table of centroids.
_ROUND = """
near{i} AS MATERIALIZED (
  SELECT vec_id, row_id, x, c, d FROM (
    SELECT vec_id, row_id, v.x AS x, m.c AS c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM kept v, middle{i} m)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c) = 1)"""
_MOVE = """
middle{j} AS MATERIALIZED (
  SELECT m.c AS c, coalesce(s.x, m.x) AS x FROM middle{i} m LEFT JOIN (
    SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY k) AS x FROM (
      SELECT c, k, sum(x[k]) AS t, count(*) AS n FROM near{i}, range(1, 65) r(k) GROUP BY c, k) GROUP BY c) s ON s.c = m.c)"""
ORACLE_SQL = (
    """WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
middle0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, x FROM kept QUALIFY c < 16),"""
    + ",".join(_ROUND.format(i=i) + "," + _MOVE.format(i=i, j=i + 1) for i in range(3))
    + ","
    + _ROUND.format(i=3)
    + """
SELECT vec_id, n.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM near3 n JOIN middle3 m ON n.c = m.c"""
)
