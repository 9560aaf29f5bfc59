"""Job: a provenance ledger of case texts, taken in as they arrive, and an audit of each source.

Before an analysis is run, its inputs are audited: every record there once, complete, unchanged since it was recorded.  For
texts that keep arriving this job does so by increments.  A file stream with a checkpoint takes only files that it has not
seen; every text becomes a ledger row with its size, SHA-256 and the checks that it passed or failed, and is not read again.
The audit has a row for each source and language: texts, failures by kind, repeated ids and repeated texts, and a checksum of
the contents that does not depend on their order.  Only sources whose ledger has grown are audited anew, by an overwrite of
their partitions.

    python -m jobs.text_ledger --texts DIR --output DIR --checkpoint DIR [--config FILE]

``output/ledger`` (partitioned by source) is written by the stream's exactly-once sink, ``output/audit`` (the same) by dynamic
partition overwrite.  A run that died anywhere is made good by the next: the stream goes on from its checkpoint, and a source
is audited whenever its counts in the two tables differ.  All paths may be remote.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcohort.operators import contracts as C
from fieldcohort.session import get_session
from fieldcohort.sources import tables

LOG = logging.getLogger("jobs.text_ledger")
CONFIG = Path(__file__).with_suffix(".toml")
TEXTS = "doc_id long, text string, lang string, source string, n_chars long"
LEDGER = "doc_id long, lang string, n_bytes long, n_chars long, sha256 string, status string, method_version string, source string"
AUDIT = "lang string, texts long, no_id long, no_text long, length_differs long, repeated_ids long, repeated_texts long, n_bytes long, content_sum long, source string"


@dataclass(frozen=True)
class Settings:
    """What the settings file may change."""

    method_version: str = "text-ledger-v1"
    files_per_source: int = 4
    files_per_batch: int = 256
    unnamed: str = "(none)"


def load_settings(path: str | Path | None = None) -> Settings:
    config = tables.load_config(path or CONFIG)
    unknown = set(config.get("ledger", {})) - set(Settings.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**config.get("ledger", {}))


def ledger_rows(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A ledger row for each text; the text itself does not leave this projection.

    status: the first that holds of no_id, no_text (null or blank), length_differs (from the recorded n_chars), else ok.  A
    null text has the size and digest of an empty one."""
    text = F.coalesce("text", F.lit(""))
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(settings.unnamed)).alias(c)
    status = (
        F.when(F.col("doc_id").isNull(), "no_id")
        .when(F.trim(text) == "", "no_text")
        .when(~F.col("n_chars").eqNullSafe(F.char_length(text).cast("long")), "length_differs")
        .otherwise("ok")
    )
    return texts.select(
        "doc_id", named("lang"), F.octet_length(text).cast("long").alias("n_bytes"), F.char_length(text).cast("long").alias("n_chars"),
        F.sha2(text.cast("binary"), 256).alias("sha256"), status.alias("status"), F.lit(settings.method_version).alias("method_version"), named("source"),
    )


def take_in(spark: SparkSession, texts: str, output: str, checkpoint: str, settings: Settings = Settings()) -> int:
    """Append the ledger rows of all files that the checkpoint does not know; the number of texts taken in.

    ``texts`` is a folder, or a pattern of files and folders."""
    before = read_ledger(spark, output).count()  # no column is read for that
    C.require_columns(spark.read.parquet(texts), StructType.fromDDL(TEXTS).fieldNames(), texts)
    stream = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(texts)
    # narrow rows are dealt by source, a large source to several files
    dealt = ledger_rows(stream, settings).repartition("source", F.pmod(F.xxhash64("doc_id", "sha256"), F.lit(settings.files_per_source)))
    writer = dealt.writeStream.format("parquet").partitionBy("source").option("path", f"{output}/ledger").option("checkpointLocation", checkpoint)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_ledger(spark, output).count() - before


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the job, empty before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_ledger(spark: SparkSession, output: str) -> DataFrame:
    return _read(spark, f"{output}/ledger", LEDGER)


def read_audit(spark: SparkSession, output: str) -> DataFrame:
    return _read(spark, f"{output}/audit", AUDIT)


def grown(spark: SparkSession, output: str) -> list[str]:
    """The sources whose ledger has other counts than their audit: a name for each partition folder, as Spark lists them on
    the driver anyway.  Counting by partition reads no column."""
    now = read_ledger(spark, output).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    then = read_audit(spark, output).groupBy("source").agg(F.sum("texts").alias("m"))
    return [r["source"] for r in now.join(then, "source", "left").where(~F.col("n").eqNullSafe(F.col("m"))).orderBy("source").collect()]


def audit_rows(ledger: DataFrame) -> DataFrame:
    """The audit of a ledger, by source and language.

    Rows are first counted by content, so that a text sent a million times is a row; repeated ids and texts count the rows
    beyond the first within their source and language.  content_sum adds the first seven hexadecimal digits of all digests."""
    groups = ["source", "lang"]
    failed: Column = F.col("status")
    counts = {"texts": F.count(F.lit(1)), **{s: F.count_if(failed == s) for s in ("no_id", "no_text", "length_differs")}, "n_bytes": F.sum("n_bytes")}
    by_text = ledger.groupBy(*groups, "sha256").agg(*[c.alias(n) for n, c in counts.items()])
    digits = F.conv(F.substring("sha256", 1, 7), 16, 10).cast("long")
    per_group = by_text.groupBy(*groups).agg(*[F.sum(n).alias(n) for n in counts], F.sum(F.col("texts") - 1).alias("repeated_texts"), F.sum(digits * F.col("texts")).alias("content_sum"))
    repeated = C.duplicate_keys(ledger.where("doc_id is not null"), *groups, "doc_id").groupBy(*groups).agg(F.sum(F.col("n") - 1).alias("repeated_ids"))
    return per_group.join(repeated, groups, "left").select("lang", "texts", "no_id", "no_text", "length_differs", F.coalesce("repeated_ids", F.lit(0).cast("long")).alias("repeated_ids"), "repeated_texts", "n_bytes", "content_sum", "source")


def refresh_audit(spark: SparkSession, output: str) -> list[str]:
    """Audit the sources that have grown; their names."""
    sources = grown(spark, output)
    if sources:
        # the filter is on the partition column: other sources' files are not opened
        rows = audit_rows(read_ledger(spark, output).where(F.col("source").isin(sources)))
        rows.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{output}/audit")
    return sources


def run(spark: SparkSession, texts: str, output: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Take in what is new below ``texts`` and audit the sources that it belongs to."""
    LOG.info("reading %s, ledger and audit below %s, checkpoint %s", texts, output, checkpoint)
    new = take_in(spark, texts, output, checkpoint, settings)
    LOG.info("took in %d texts", new)
    sources = refresh_audit(spark, output)
    LOG.info("audited %d sources with new texts", len(sources))
    return {"texts": new, "sources": len(sources)}


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """Both tables as one: the column ``kind`` is ledger or audit, and columns of the other kind are null."""
    ledger, audit = read_ledger(spark, output), read_audit(spark, output)
    return ledger.withColumn("kind", F.lit("ledger")).unionByName(audit.withColumn("kind", F.lit("audit")), allowMissingColumns=True)


#: DuckDB text of ``read_output`` after all of ``documents`` was taken in.
SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(nullif(lang, ''), '(none)') AS lang, strlen(coalesce(text, ''))::BIGINT AS n_bytes, length(coalesce(text, ''))::BIGINT AS n_chars, sha256(coalesce(text, '')) AS sha256,
    CASE WHEN doc_id IS NULL THEN 'no_id' WHEN trim(coalesce(text, ''), ' ') = '' THEN 'no_text' WHEN n_chars IS DISTINCT FROM length(coalesce(text, '')) THEN 'length_differs' ELSE 'ok' END AS status,
    'text-ledger-v1' AS method_version, coalesce(nullif(source, ''), '(none)') AS source
  FROM documents),
a AS (
  SELECT source, lang, count(*) AS texts, count(*) FILTER (status = 'no_id') AS no_id, count(*) FILTER (status = 'no_text') AS no_text, count(*) FILTER (status = 'length_differs') AS length_differs,
    count(doc_id) - count(DISTINCT doc_id) AS repeated_ids, count(*) - count(DISTINCT sha256) AS repeated_texts, sum(n_bytes)::BIGINT AS n_bytes, sum(('0x' || left(sha256, 7))::BIGINT)::BIGINT AS content_sum
  FROM l GROUP BY source, lang)
SELECT *, 'ledger' AS kind FROM l UNION ALL BY NAME SELECT *, 'audit' AS kind FROM a
"""


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.text_ledger", description=__doc__.split("\n")[0])
    parser.add_argument("--texts", required=True, help="folder of Parquet files, or a pattern of files and folders, with " + TEXTS)
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--config", default=None, help=f"settings, {CONFIG.name} beside the job by default")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session("text-ledger")
    try:
        run(spark, given.texts, given.output, given.checkpoint, load_settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
