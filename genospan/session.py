"""Session settings used by tests, the benchmark and the entry module."""

from __future__ import annotations

import os
import sys
import tempfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_by_value(module_name: str) -> None:
    """Send the functions of a module along with the job, so workers need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def local_table(spark: SparkSession, columns: dict[str, list], schema: pa.Schema) -> DataFrame:
    """A small driver-side table as a local relation, whose size Catalyst knows."""
    return spark.createDataFrame(pa.table(columns, schema=schema))


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    On a cluster the master, the shuffle partition count and
    ``spark.checkpoint.dir`` come from the submitted configuration; nothing here
    overrides them unless the caller asks for it.
    """
    builder = (
        SparkSession.builder.appName("genospan")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("GENOSPAN_DRIVER_MEMORY", "8g"))
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the configured one, else a new local one.

    The local folder is only ever chosen when the session names none, which is
    the case in unit tests on one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured
