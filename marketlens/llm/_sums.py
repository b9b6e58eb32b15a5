"""Element-wise sums of arrays that tasks have gathered, in steps, so that no task or driver gets all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import _scratch

#: Rows that one step adds up in a task.
FAN_IN = 64


def sum_arrays(parts: DataFrame, dtype: str = "float64", steps: int = 2) -> dict[int, np.ndarray]:
    """The sum of the ``counts`` (bytes of arrays of one length) of each ``part`` (a few numbers that don't grow).

    Each step adds up to about FAN_IN rows in a task; the last takes what is left, one row in FAN_IN ** steps.
    """

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("counts"):
            own = np.frombuffer(x.as_buffer(), dtype=dtype)
            total = own.copy() if total is None else total + own
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = parts.select("part", "counts")
    for step in range(steps):
        # The first step groups by the writing task, the next by the task that added up.
        parts = parts.withColumn("group", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("part", "group").applyInArrow(add, "part int, counts binary")
    with _scratch.brief(parts.sparkSession):
        rows = parts.groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    return {r.part: np.frombuffer(r.counts, dtype=dtype) for r in rows}
