"""Cutting the lineage of iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that `spark.checkpoint.dir` names; in the warehouse where none is set, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    kept = df.checkpoint()._jdf
    # as a new table: a checkpoint keeps the estimated size, which joins multiply, so that planning round after round takes ever longer and overflows
    fresh = df.sparkSession._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False)
    return DataFrame(fresh, df.sparkSession)
