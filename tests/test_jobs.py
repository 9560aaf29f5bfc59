import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import TABLES, plain

import __spark_entry__ as entry
from jobs import queries, release_tables, text_ledger

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    r = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()), key=repr)
    assert rows(df) == want and len(want) > 10


# --- the ledger ---------------------------------------------------------------------------------------------------------


class Arrivals:
    """A growing folder of text files, with a ledger."""

    def __init__(self, spark, tmp_path):
        self.spark, self.texts, self.out, self.mark = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
        self.n, self.tmp = 0, tmp_path

    def send(self, *texts):
        """A file with rows (doc_id, text, lang, source, n_chars)."""
        self.n += 1
        side = str(self.tmp / f"side{self.n}")
        self.spark.createDataFrame(list(texts), text_ledger.TEXTS).coalesce(1).write.parquet(side)
        os.makedirs(self.texts, exist_ok=True)
        for f in os.listdir(side):
            if f.startswith("part-"):
                shutil.copy(f"{side}/{f}", f"{self.texts}/{self.n}-{f}")

    def run(self, **how):
        return text_ledger.run(self.spark, self.texts, self.out, self.mark, text_ledger.Settings(**how))

    def audit(self):
        return {(r.source, r.lang): r.asDict() for r in text_ledger.read_audit(self.spark, self.out).collect()}

    def ledger(self):
        return rows(text_ledger.read_ledger(self.spark, self.out))


def text(k, words, source="s", lang="en"):
    return (k, words, lang, source, len(words))


def test_two_runs_over_growing_input(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.send(text(1, "one"), text(2, "two"), text(3, "drei", "t", "de"))
    assert a.run() == {"texts": 3, "sources": 2}
    first, untouched = a.ledger(), a.audit()["t", "de"]
    stamp = {f: os.stat(f).st_mtime_ns for f in _files(a.out + "/audit", "source=t")}
    # nothing new: nothing read, nothing audited
    assert a.run() == {"texts": 0, "sources": 0} and a.ledger() == first
    # new files only, of which one repeats a text and one an id; the other source keeps its files
    a.send(text(4, "two"), text(1, "uno"))
    a.send(text(5, "", "new"))
    assert a.run(files_per_batch=1) == {"texts": 3, "sources": 2}
    got = a.audit()
    assert got["t", "de"] == untouched and stamp == {f: os.stat(f).st_mtime_ns for f in _files(a.out + "/audit", "source=t")}
    s = got["s", "en"]
    assert (s["texts"], s["repeated_ids"], s["repeated_texts"], s["n_bytes"]) == (4, 1, 1, 12) and got["new", "en"]["no_text"] == 1
    assert len(a.ledger()) == 6 and set(first) < set(a.ledger())
    # one run over everything gives the same tables
    whole = Arrivals(spark, tmp_path / "whole")
    whole.texts = a.texts
    assert whole.run() == {"texts": 6, "sources": 3}
    assert whole.ledger() == a.ledger() and whole.audit() == got


def _files(folder, part):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if part in d and f.startswith("part-"))


def test_a_run_that_died_before_the_audit_is_made_good(spark, tmp_path, monkeypatch):
    a = Arrivals(spark, tmp_path)
    a.send(text(1, "one"))
    a.run()
    a.send(text(2, "two"))
    with monkeypatch.context() as m:
        m.setattr(text_ledger, "refresh_audit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            a.run()
    assert a.audit()["s", "en"]["texts"] == 1
    assert a.run() == {"texts": 0, "sources": 1} and a.audit()["s", "en"]["texts"] == 2


def test_odd_texts(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.send((None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (1, None, None, None, None), (2, "  ", "", "", 2), (3, "é🙂", "en", "s", 2), (4, "é🙂", "en", "s", 3), (4, "word " * 200_000, "en", "s/p=1 %", 1_000_000))
    assert a.run() == {"texts": 7, "sources": 3}
    status = {(r.doc_id, r.n_bytes): r.status for r in text_ledger.read_ledger(spark, a.out).collect()}
    assert status == {(None, 1): "no_id", (1, 0): "no_text", (2, 2): "no_text", (3, 6): "ok", (4, 6): "length_differs", (4, 1_000_000): "ok"}
    got = a.audit()
    assert got["s", "en"] | {"content_sum": 0} == dict(lang="en", texts=4, no_id=2, no_text=0, length_differs=1, repeated_ids=0, repeated_texts=2, n_bytes=14, content_sum=0, source="s")
    assert got["(none)", "(none)"]["texts"] == 2 and got["s/p=1 %", "en"]["n_bytes"] == 1_000_000
    assert a.run() == {"texts": 0, "sources": 0}


def test_missing_columns_and_settings(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="lacks columns"):
        text_ledger.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    bad = tmp_path / "bad.toml"
    bad.write_text("[ledger]\nmethod = 1\n[release]\nminimum = 2\n")
    for job in (text_ledger, release_tables):
        with pytest.raises(ValueError, match="unknown settings"):
            job.load_settings(bad)
        assert job.load_settings() == job.Settings()


def test_command_line(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    a.send(text(1, "one"), text(2, "two"))
    call = [sys.executable, "-m", "jobs.text_ledger", "--texts", a.texts, "--output", a.out, "--checkpoint", a.mark]
    done = subprocess.run(call, cwd=ROOT, env=os.environ | {"FIELDCOHORT_DRIVER_MEMORY": "1g"}, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "took in 2 texts" in done.stderr and len(a.ledger()) == 2


# --- the release --------------------------------------------------------------------------------------------------------


def people(spark, sizes):
    """Participants of sites by size; ten distinct values of each descriptor."""
    out = [(k, site, float(k % 7), 5, k % 10, float(k % 10), k % 10, 0.1 * (k % 10), float(k % 10)) for site, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(out, "key long, site string, outcome double, items long, visits long, mean_price double, span_days long, returned_share double, mean_quantity double")


def test_small_sites_and_counts_are_hidden(spark):
    settings = release_tables.Settings(minimum_visits=0, minimum_cell=5, descriptors=("mean_price",))
    got = release_tables.release(people(spark, {"big": 400, "small": 4}), settings).collect()
    assert [(r.table, r.item, r.n) for r in got if r.site == "small"] == [("flow", "withheld", None)]
    big = [r for r in got if r.site == "big"]
    assert {r.item: r.n for r in big if r.table == "flow"} == {"all": 400, "visited": 400, "measured": 400, "complete": 400}
    assert all(r.n is None or r.n >= 5 for r in got)
    assert not {"minimum", "maximum"} & {r.item for r in got}
    median = [r.value for r in big if r.item == "median"]
    assert median == [4.5]


def test_a_single_hidden_count_takes_another_with_it(spark):
    cells = spark.createDataFrame([("a", 0, 3), ("a", 1, 50), ("a", 2, 9), ("a", 3, 9), ("b", 0, 2), ("b", 1, 4), ("b", 2, 7), ("c", 0, 8), ("d", 0, 1)], "g string, bin int, n long")
    got = {(r.g, r.bin): r.n for r in release_tables.hidden(cells, ["g"], "n", 5, ["bin"]).collect()}
    assert got == {("a", 0): None, ("a", 1): 50, ("a", 2): None, ("a", 3): 9, ("b", 0): None, ("b", 1): None, ("b", 2): 7, ("c", 0): 8, ("d", 0): None}


def test_participants_are_not_shuffled_by_site(spark):
    # whatever Spark's estimate of the table of sites
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = release_tables.release(people(spark, {"big": 40}), release_tables.Settings(descriptors=("mean_price",)))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(name, before)
    joins = re.findall(r"(\w+) \[site#\d+\], \[site#\d+\], LeftSemi", plan)
    assert joins and set(joins) == {"BroadcastHashJoin"}


def test_release_reruns_and_forgets_withheld_sites(spark, sf, tmp_path):
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    first = release_tables.run(spark, sf, out, work, release_tables.Settings(minimum_cell=2))
    before = rows(release_tables.read_output(spark, out))
    assert release_tables.run(spark, sf, out, work, release_tables.Settings(minimum_cell=2)) == first and rows(release_tables.read_output(spark, out)) == before
    assert {d for d in os.listdir(out) if "=" in d} == {"table=flow", "table=summary", "table=histogram", "table=association"}
    sizes = {r.site: r.n for r in release_tables.read_output(spark, out).where("item = 'complete'").collect()}
    limit = sorted(sizes.values())[len(sizes) // 2]
    release_tables.run(spark, sf, out, work, release_tables.Settings(minimum_cell=limit))
    left = release_tables.read_output(spark, out)
    assert {r.site for r in left.where("table = 'summary'").select("site").distinct().collect()} == {s for s, n in sizes.items() if n >= limit}
    # participants' rows are nowhere in the output
    assert "key" not in left.columns


def test_empty_cohort_and_bad_settings(spark, tmp_path):
    assert release_tables.release(people(spark, {"a": 3}).limit(0)).count() == 0
    for settings in (release_tables.Settings(minimum_cell=1), release_tables.Settings(descriptors=("weight",)), release_tables.Settings(descriptors=())):
        with pytest.raises(ValueError, match="bad settings"):
            release_tables.run(spark, "/nowhere", str(tmp_path / "o"), str(tmp_path / "w"), settings)
