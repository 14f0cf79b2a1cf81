"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in one row of a partial vector sum.
CHUNK = 4096


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of Arrow batches, which hands memory back to the system when its task ends: workers are reused, and idle ones would keep what they once held."""

    def ending(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

    return ending


def fold(key: Column | str, n: int) -> Column:
    """crc32 of a key as text, modulo n: a fold that doesn't depend on the order or number of rows."""
    return (F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n).cast("int")


def vector_rows(vectors: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A partition's partial sums as rows (name, part, values)."""
    names, parts, values = [], [], []
    for name, v in vectors.items():
        v = np.ascontiguousarray(v, np.float64)
        for i in range(0, len(v), CHUNK):
            names.append(name)
            parts.append(i // CHUNK)
            values.append(v[i : i + CHUNK].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int32()), pa.array(values, pa.binary())], ["name", "part", "values"])


VECTOR_SCHEMA = "name string, part int, values binary"


def sum_vectors(partial: DataFrame) -> dict[str, np.ndarray]:
    """Sums vectors of fixed length over all partitions; the driver gets one vector a name.

    `partial` has `VECTOR_SCHEMA`.  Rows meet by (name, part) and are added up as
    they stream in, so a task holds one chunk for each key and no list of rows.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(raw, np.float64)
                if (name, part) in total:
                    total[name, part] += v
                else:
                    total[name, part] = v.copy()
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["name", "part", "values"])

    rows = partial.repartition("name", "part").mapInArrow(lean(add), VECTOR_SCHEMA).collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["part"])):
        found.setdefault(r["name"], []).append(np.frombuffer(r["values"], np.float64))
    return {k: np.concatenate(v) for k, v in found.items()}


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that `spark.checkpoint.dir` names.

    Only where no folder is set, as in tests, one in the warehouse is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal `keys` in one partition, one after the other: for functions of batches that rely on it.

    A plain repartition is dropped where a join or an aggregation has dealt the rows by
    these columns already; Spark may then turn the join into a broadcast one, read its
    input from local files and tear groups apart, as nothing in the plan asks for them.
    The hash of the keys is a partitioning that no other step has.
    """
    return df.repartition(F.xxhash64(*keys, F.lit(0))).sortWithinPartitions(*keys)
