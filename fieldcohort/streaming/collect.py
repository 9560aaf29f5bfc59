"""Streaming collection of finished cases: the batch reader's documents as they arrive.

Each case is taken once, by a state on case_id that a watermark on the arrival time bounds; the sink appends Parquet, so the
table can be read while the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcohort.sources.tables import METRICS_FILE


def case_stream(spark: SparkSession, root: str, schema: StructType | str, name: str = METRICS_FILE, late: str = "7 days", files: int = 1000) -> DataFrame:
    """Case documents below ``root`` as a stream, each case_id once within ``late`` of its first arrival."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).option("maxFilesPerTrigger", files)
    docs = reader.json(root).withColumn("arrived", F.col("_metadata.file_modification_time"))
    return docs.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["case_id"])


def write_cases(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append to a Parquet table; with ``once`` what is there now, then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def qc_counts(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """Arrivals and passes by window of the arrival time."""
    return stream.groupBy(F.window("arrived", window)).agg(F.count(F.lit(1)).alias("cases"), F.count_if("deformation_qc_pass").alias("passed"))
