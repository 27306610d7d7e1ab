"""Cutting the lineage of iterations in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session on one machine gets a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessera-"))
    return found or sc._jsc.sc().getCheckpointDir().get()


def cut_with(df: DataFrame, **sums: Column) -> tuple[DataFrame, Row]:
    """df written to the shared folder and read again, and sums over it that the same job observed."""
    seen, path = Observation(), f"{shared_dir(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.observe(seen, *(c.alias(name) for name, c in sums.items())).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), Row(**seen.get)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later jobs read it, and a lost executor does not lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
