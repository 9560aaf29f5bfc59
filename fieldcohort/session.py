"""SparkSession defaults used by tests, the bench and the command line."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "fieldcohort", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; ANSI stays at Spark's default (on).  A session that is there already is
    returned as it is: its settings are its owner's."""
    if active := SparkSession.getActiveSession():
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("FIELDCOHORT_DRIVER_MEMORY", "6g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder if all of Spark is one process (tests); on a cluster an error, since each
    executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldcohort-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: computed once however often it is read, without holding
    memory of the session; the files stay."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
