"""Command line: audit, collect, extract, hodge, hodge-sensitivity, model, report, compare, reproduce, second.

A value given on the command line comes before one in the TOML file, that before the default; a given 0 counts.  A step that
lacks an input raises.  ``reproduce`` is audit, hodge, hodge-sensitivity, model and report; ``second`` is what follows the
registration of a second pipeline: hodge on its own grid, model with its own limits, comparison with the first one, public
aggregates and the supplement.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcohort.functions import vocabulary as N
from fieldcohort.operators import cases, cohort, cv
from fieldcohort.operators import kernels as K
from fieldcohort.plans import pipelines, volumes
from fieldcohort.session import get_session
from fieldcohort.sources import nifti, report, tables

COMMANDS = ("audit", "collect", "extract", "hodge", "hodge-sensitivity", "model", "report", "compare", "reproduce", "second")
TEXT = ("manifest", "clinical", "uncertainty", "hodge", "fields", "design", "legacy", "atlas-image", "atlas-mask", "tables", "other-manifest", "predictions", "other-predictions", "anchor", "method-version")
NUMBERS = (("seed", int), ("repeats", int), ("replicates", int), ("stride", int), ("padding", int), ("taper", float), ("sigma", float), ("expected", int), ("smoothing", float), ("subsample", int), ("minimum-points", int), ("minimum-voxels", int))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldcohort")
    p.add_argument("--config", help="TOML settings")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("--output", help="folder for results")
        c.add_argument("--data", help="data folder, below which volumes are; no output may lie in it")
        for flag in TEXT:
            c.add_argument(f"--{flag}")
        for flag, kind in NUMBERS:
            c.add_argument(f"--{flag}", type=kind)
        c.add_argument("--spacing", type=float, nargs=3)
        c.add_argument("--maps", action="store_const", const=True, help="audit: read the stored maps as well")
    return p


class Run:
    """The settings of a call, its inputs and its steps."""

    def __init__(self, args: argparse.Namespace):
        self.args, self.config = args, tables.load_config(args.config) if args.config else {}
        self.spark: SparkSession = get_session(master=args.master)
        self.out = self.get("paths", "output", "results")
        self.data = self.get("paths", "data")
        report.outside(self.out, self.data or "/nonexistent-data-root")
        self.spacing = tuple(args.spacing or self.config.get("grid", {}).get("spacing", (1.0, 1.0, 1.0)))
        self.settings = K.HodgeConfig(**{k: self.get("hodge", k, getattr(K.HodgeConfig(), k)) for k in ("stride", "padding", "taper", "sigma")})
        self.anchor = self.get("paths", "anchor", "ARC")
        self.version = self.get("model", "method-version", N.METHOD_VERSION)
        self.made: dict[str, DataFrame] = {}

    def get(self, section: str, key: str, default=None):
        return tables.setting(self.config, section, key, default, getattr(self.args, key.replace("-", "_"), None))

    def need(self, key: str) -> str:
        if not (value := self.get("paths", key)):
            raise ValueError(f"{self.args.command} needs --{key}, or {key} in the section paths of the settings")
        return value

    def read(self, key: str, optional: bool = False) -> DataFrame | None:
        """An input table, or what an earlier step of this call has made of that name."""
        if key in self.made:
            return self.made[key]
        if optional and not self.get("paths", key):
            return None
        return tables.read_table(self.spark, self.need(key))

    def fields(self) -> tuple[DataFrame, cases.Loader]:
        """Prepared fields as Parquet if they are given, else the volumes that the manifest names."""
        if path := self.get("paths", "fields"):
            return self.spark.read.parquet(path), cases.stored
        return volumes.fields(self.spark, self.manifest(), self.need("data"), self.version, self.anchor), nifti.vector_and_mask

    def manifest(self) -> DataFrame:
        # ids are text, whatever they look like
        raw = self.read("manifest")
        return raw.withColumns({k: F.col(k).cast("string") for k in volumes.KEYS if k in raw.columns})

    def audit(self) -> None:
        manifest = self.manifest()
        got = pipelines.audit_manifest(manifest, self.version, self.get("audit", "expected")) | {"status": "pass"}
        folder = str(Path(self.need("manifest")).parent)
        found = tables.marker_counts(self.spark, folder)
        got |= {"failure_records": found["errors"], "completion_markers": found["complete"]}
        if found["errors"]:
            raise ValueError(f"{found['errors']} error documents below {folder}")
        if self.get("audit", "expected") is not None and found["complete"] not in (0, self.get("audit", "expected")):
            raise ValueError(f"{found['complete']} completed cases below {folder}")
        if self.get("audit", "maps"):
            got |= volumes.require_empty(volumes.audit_maps(self.spark, manifest, self.need("data"), self.anchor))
        if self.get("paths", "legacy"):
            compared = pipelines.compare_legacy(manifest, self.read("legacy").withColumn("case_id", F.col("case_id").cast("string")))
            pipelines.write_tables({"legacy_feature_comparison": compared}, self.out)
            got |= pipelines.require_equal(compared)
        report.write_json(f"{self.out}/cohort_audit.json", got)

    def collect(self) -> None:
        pipelines.write_tables({"manifest": tables.collect_cases(self.spark, self.need("data"))}, self.out)

    def extract(self) -> None:
        if path := self.get("paths", "fields"):
            cases.extract_cases(self.spark.read.parquet(path), self.spacing).write.mode("overwrite").parquet(f"{self.out}/cases")
            return
        atlas = volumes.read_atlas(self.spark, self.need("atlas-image"), self.need("atlas-mask"))
        how = {"smoothing_mm": self.get("extract", "smoothing", 2.0), "subsample": self.get("extract", "subsample", 8), "minimum_points": self.get("extract", "minimum-points", 10_000)}
        made = volumes.extract(self.spark, self.manifest(), self.need("data"), atlas, self.anchor, **how)
        # the cases go to disk once; files and table are both taken from there
        made.write.mode("overwrite").parquet(f"{self.out}/cases")
        made = self.spark.read.parquet(f"{self.out}/cases")
        report.write_files(made.select(F.explode("files").alias("f")).select("f.name", "f.content"), self.out)

    def hodge(self) -> None:
        fields, load = self.fields()
        keys = tuple(k for k in volumes.KEYS if k in fields.columns)
        rows, summary = pipelines.run_hodge(fields, self.spacing, self.settings, load, keys)
        pipelines.write_tables({"hodge_manifest": rows}, self.out)
        self.made["hodge"] = rows
        report.write_json(f"{self.out}/hodge_summary.json", {"method_version": N.HODGE_METHOD_VERSION} | summary)
        report.write_json(f"{self.out}/hodge_config.json", report.redact({"method_version": N.HODGE_METHOD_VERSION, "config": vars(self.settings), "input_manifest": self.get("paths", "manifest")}))

    def hodge_sensitivity(self) -> None:
        if path := self.get("paths", "design"):
            design = self.spark.read.parquet(path)
        else:
            design, _ = cohort.build_design(self.manifest(), self.read("clinical"), hodge=self.read("hodge"))
        fields, load = self.fields()
        self.sensitivity = pipelines.run_sensitivity(fields, design, self.spacing, load=load)
        pipelines.write_tables(self.sensitivity, f"{self.out}/sensitivity")

    def model(self) -> None:
        base, design = pipelines.ModelRun(), cohort.DesignConfig()
        limits = cohort.DesignConfig(method_version=self.version, minimum_voxels=self.get("model", "minimum-voxels", design.minimum_voxels))
        run = pipelines.ModelRun(limits, cv.CvConfig(seed=self.get("model", "seed", base.cv.seed), repeats=self.get("model", "repeats", base.cv.repeats)), self.get("model", "replicates", base.replicates))
        made, audit = pipelines.run_model(self.manifest(), self.read("clinical"), run, self.read("uncertainty", True), self.read("hodge", True))
        report.write_json(f"{self.out}/model/analysis_config.json", audit)
        pipelines.write_tables(made, f"{self.out}/model")
        self.made["other-predictions"] = made["predictions"]

    def reproduce(self) -> None:
        for step in (self.audit, self.hodge, self.hodge_sensitivity, self.model):
            step()
        # reports read one folder
        pipelines.write_tables({k: v for k, v in self.sensitivity.items() if k != "variants"}, f"{self.out}/model")
        self.report()

    def second(self) -> None:
        """``manifest`` and ``predictions`` are the first pipeline's, ``other-manifest`` the second's, whose version and limits
        are given; what the first one found is compared, not fitted again."""
        first, own = self.read("manifest"), self.read("other-manifest")
        self.made["manifest"] = own
        self.hodge()
        self.model()
        self.made |= {"manifest": first, "other-manifest": own}
        self.compare()

    def report(self) -> None:
        """From the stored tables of a run; nothing is fitted again."""
        stored = pipelines.read_tables(self.spark, self.get("paths", "tables", f"{self.out}/model"))
        known = {name: json.loads(file.read_text()) if (file := Path(self.out, path)).exists() else {} for name, path in (("flow", "model/analysis_config.json"), ("hodge", "hodge_summary.json"))}
        written = pipelines.write_report(stored, f"{self.out}/report", **known) | pipelines.write_supplement(stored, f"{self.out}/report")
        print(json.dumps(written))

    def compare(self) -> None:
        """Two pipelines: agreement, paired errors, flow counts, and their public aggregates."""
        sides = []
        for prefix in ("", "other-"):
            rows = {"manifest": self.read(f"{prefix}manifest")}
            if self.get("paths", f"{prefix}predictions") or f"{prefix}predictions" in self.made:
                rows["predictions"] = self.read(f"{prefix}predictions")
            sides.append(rows)
        features = [f.removeprefix("me_") for f in N.DEFORMATION]
        descriptors = [f for f in features if all(f in s["manifest"].columns for s in sides)]
        made = pipelines.compare_runs(*sides, descriptors, self.get("model", "replicates", 5000), self.get("model", "seed", 2026))
        pipelines.write_tables(made, f"{self.out}/comparison")
        pipelines.write_supplement(made, f"{self.out}/comparison")
        pipelines.freeze_run(made | {"manifest": sides[0]["manifest"], "other_manifest": sides[1]["manifest"]}, f"{self.out}/frozen", {"manifest": descriptors, "other_manifest": descriptors}, {"input_manifest": self.get("paths", "manifest"), "other_manifest": self.get("paths", "other-manifest")})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    run = Run(args)
    getattr(run, args.command.replace("-", "_"))()
    return 0
