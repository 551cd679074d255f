"""Number partitioning from SQL.

    SELECT * FROM partition_numbers(TABLE(w) PARTITION BY (set_id), 'kk,2')
    SELECT * FROM partition_numbers(TABLE(w) WITH SINGLE PARTITION, 'greedy,4')

The table has columns id and w, and part if an improver is to start from one. Each partition of
the table is one set and one task, as with :func:`partlab.operators.numbers.solve`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..model import PartitionError
from ..operators import numbers


def kernel(spec: str) -> numbers.Kernel:
    """A kernel from ``name,argument``."""
    name, *args = spec.split(",")
    if name not in numbers.KERNELS:
        raise PartitionError(f"unknown algorithm {name!r}")
    return numbers.KERNELS[name](*[float(a) if name == "ckk" else int(a) for a in args])


@udtf(returnType="id bigint, part int")
class PartitionNumbers:
    def __init__(self):
        self.rows: list[tuple] = []
        self.spec = ""

    def eval(self, row: Row, spec: str):
        self.spec = spec
        self.rows.append((row["id"], row["w"], row["part"] if "part" in row.asDict() else 0))

    def terminate(self):
        if self.rows:
            ids, w, parts = (np.array(c) for c in zip(*self.rows))
            found, _ = kernel(self.spec)(ids, w, parts.astype(np.int64))
            for i, p in zip(ids.tolist(), found):
                yield i, int(p)


def register(spark: SparkSession) -> None:
    spark.udtf.register("partition_numbers", PartitionNumbers)
