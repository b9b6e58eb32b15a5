"""How much of the true neighbours the index finds, by the share of lists that a query visits.

``python -m marketlens.llm.recall SF_DIR`` prints the curve for the supplied vectors: first without bounds, by the share,
and then what ``ann.search`` returns with them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm import _text, ann

#: Queries that the exact search sends to all tasks.
MOST_QUERIES = 500


def exact(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id and vec_id of the k rows with the largest cosine to each of at most MOST_QUERIES queries, by trying all.

    ``vectors`` and ``queries`` are what ``ann.usable`` gives; of equally near ones the smaller id counts.
    """
    asked = queries.orderBy("vec_id").limit(MOST_QUERIES).collect()
    ids = np.array([r.vec_id for r in asked])
    unit = ann._unit(pa.array([bytes(r.vector) for r in asked], pa.binary()))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, unit))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("vec_id").to_numpy()
            score = unit @ ann._unit(batch.column("vector")).T
            score[ids[:, None] == own[None, :]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, : 2 * k]
            row = np.repeat(np.arange(len(ids)), top.shape[1])
            keep = np.isfinite(score[row, top.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(ids[row][keep]), pa.array(own[top.ravel()][keep]), pa.array(np.round(score[row, top.ravel()][keep], 12))], ["query_id", "vec_id", "score"])

    found = _text.bounded(vectors).mapInArrow(best, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).select("query_id", "vec_id")


def curve(vectors: DataFrame, queries: DataFrame, probes: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6), k: int = 5, bounds: bool = False) -> list[tuple[float, float]]:
    """(share of lists visited, share of the true neighbours found) for each of ``probes``."""
    dimension = ann.commonest_dimension(vectors, "vec_id", "embedding")
    truth = exact(ann.usable(vectors, dimension, "vec_id", "embedding"), ann.usable(queries, dimension, "vec_id", "embedding").distinct(), k).cache()
    total, asked = truth.count(), truth.select("query_id").distinct()
    few = queries.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    return [(p, ann.search(vectors, few, k=k, probes=p, bounds=bounds).join(truth, ["query_id", "vec_id"]).count() / total) for p in probes] if total else []


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for share, found in curve(vectors, vectors.where("vec_id % 50 = 0")):
        print(f"{share:.2f} of the lists: recall {found:.4f}")
    print(f"with bounds: recall {curve(vectors, vectors.where('vec_id % 50 = 0'), (0.6,), bounds=True)[0][1]:.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
