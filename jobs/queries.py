"""The jobs as registered queries: each runs twice into a new folder of its own and gives back what stands there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcohort.session import shared_dir
from jobs import release_tables, text_ledger


def job1_text_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    # a pattern, since a stream takes a folder by its name but a single file by a pattern only, and the table may be either
    for _ in range(2):
        text_ledger.run(spark, f"{sf_dir}/document[s].parquet", f"{folder}/output", f"{folder}/checkpoint", text_ledger.load_settings())
    return text_ledger.read_output(spark, f"{folder}/output")


def job2_release_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        release_tables.run(spark, sf_dir, f"{folder}/output", f"{folder}/work", release_tables.load_settings())
    return release_tables.read_output(spark, f"{folder}/output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_text_ledger, job2_release_tables)}


def oracle_sql() -> dict[str, str]:
    return {"job1_text_ledger": text_ledger.SQL, "job2_release_tables": release_tables.SQL}
