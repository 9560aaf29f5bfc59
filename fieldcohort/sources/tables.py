"""Readers: delimited tables, case documents, settings, paths, markers."""

from __future__ import annotations

import os
import re
import tomllib
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcohort.functions import expr as X
from fieldcohort.operators import contracts as C

METRICS_FILE, MARKER, ERRORS = "mass_effect_metrics.json", "mass_effect_complete", "processing_error.json"


def read_table(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV, or with the suffix .tsv (any case) a TSV, with a header.

    The usual tokens for a missing value become NULL before types are found: a column is long where all its values are
    whole numbers, double where they are numbers, boolean where they are True or False, else text.  A missing file raises."""
    raw = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    clean = raw.select(*[X.null_token(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if not infer or not clean.columns:
        return clean
    # one pass over the table tells the type of every column
    tests = []
    for k, c in enumerate(clean.columns):
        v = F.col(f"`{c}`")
        tests += [F.count(v).alias(f"n{k}"), F.count_if(v.rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"i{k}"), F.count_if(F.lower(v).rlike(X.NUMERIC)).alias(f"d{k}"), F.count_if(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{k}")]
    seen = clean.agg(*tests).first()
    out = []
    for k, c in enumerate(clean.columns):
        v, n = F.col(f"`{c}`"), seen[f"n{k}"]
        if n and seen[f"b{k}"] == n:
            v = F.lower(v) == "true"
        elif n and seen[f"i{k}"] == n:
            v = F.trim(v).cast("long")
        elif seen[f"d{k}"] == n:
            v = X.finite(F.trim(v).try_cast("double"))
        out.append(v.alias(c))
    return clean.select(*out)


def collect_cases(spark: SparkSession, root: str, name: str = METRICS_FILE) -> DataFrame:
    """The case documents below ``root``, one row each, columns united by name, ordered by subject and case.

    No document, or a case_id that two documents have, raises."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
    if not docs.columns or docs.isEmpty():
        raise FileNotFoundError(f"no {name} below {root}")
    C.require_unique(docs, "case_id", name)
    return docs.orderBy(*[c for c in ("subject", "case_id") if c in docs.columns])


def pending(cases: DataFrame, finished: DataFrame, version: str, key: str = "case_id", column: str = "method_version") -> DataFrame:
    """Cases without a finished row of this method version."""
    return cases.join(finished.where(F.col(column) == version).select(key), key, "left_anti")


def same_request(path: str | os.PathLike, request: dict) -> bool:
    """Whether a run's request file is new or equal to ``request``; a different one raises, so that results do not mix."""
    import json

    file = Path(path)
    if not file.exists():
        return False
    if json.loads(file.read_text()) != json.loads(json.dumps(request)):
        raise ValueError(f"{file} holds another request")
    return True


def load_config(path: str | os.PathLike) -> dict[str, Any]:
    """Settings from a TOML file."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def setting(config: dict, section: str, key: str, default: Any = None, given: Any = None) -> Any:
    """A given value if there is one, else that of the file, else the default; a given 0 counts."""
    return given if given is not None else config.get(section, {}).get(key, default)


def localized(path: str, root: str | os.PathLike, anchor: str = "ARC", exists=os.path.exists) -> str:
    """A path as it is if it exists, else what follows its last component ``anchor``, below ``root``; it must stay there."""
    if exists(path):
        return path
    parts = PurePosixPath(path).parts
    if anchor not in parts:
        raise ValueError(f"{path} has no component {anchor}")
    last = len(parts) - 1 - parts[::-1].index(anchor)
    base = Path(root).resolve()
    target = base.joinpath(*parts[last + 1 :]).resolve()
    if base != target and base not in target.parents:
        raise ValueError(f"{path} leaves {root}")
    return str(target)


def localized_column(column, root: str, anchor: str = "ARC"):
    """The same as a column, without looking at files: what follows the last ``anchor``, below ``root``; others unchanged.

    A path that leaves ``root``, because more of its components are ``..`` than there are folders before them, raises when the
    row is read, as ``localized`` does."""
    tail = F.regexp_extract(column, rf"^(?:.*/)?{anchor}/(.*)$", 1)
    # how deep each component leads, and whether any place on the way lies above the root
    step = lambda p: F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)
    walk = F.aggregate(F.split(tail, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), lambda a, p: F.struct((a["depth"] + step(p)).alias("depth"), F.least(a["least"], a["depth"] + step(p)).alias("least")))
    leaves = F.raise_error(F.concat(column, F.lit(f" leaves {root}"))).cast("string")
    return F.when(tail == "", column).when(walk["least"] < 0, leaves).when(tail != "", F.concat(F.lit(root.rstrip("/") + "/"), tail)).otherwise(column)


def required(paths: list[str | None]) -> None:
    """All paths exist; the missing ones are named."""
    missing = [str(p) for p in paths if p is None or not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(f"missing: {missing}")


def marker_counts(spark: SparkSession, root: str) -> dict[str, int]:
    """Completed cases (sub-*/mass_effect_complete) and error documents below ``root``, from file listings only."""

    def count(glob: str, pattern: str) -> int:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        # the listing itself: markers are empty files, which no scan reads
        return sum(bool(re.search(pattern, f)) for f in files.inputFiles())

    return {"complete": count(MARKER, rf"/sub-[^/]+/{MARKER}$"), "errors": count(ERRORS, ERRORS)}
