import random
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from fieldcohort.llm import filter_audit, registry

DOCS, LABELS = "doc_id long, text string, lang string, mask int, place int, range string", "doc_id long, quality int, toxic int"


def brute_masks(rows):
    """Masks of (doc_id, text, lang) by plain loops."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
        ids = [i for i, t, _ in rows if i is not None and (t or "") == text]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), doc_id is not None and any(i < doc_id for i in ids)]
        out.append(sum(f << k for k, f in enumerate(fails)))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masks, out = brute_masks(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], m) for r, m in zip(rows, masks, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                removed = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                shapley[f] += len(removed)
                fails = sum(bool(m & bit) for _, m in own)
                out[part, order, step] = [len(left), len(removed), fails - len(removed), sum(m == bit for _, m in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit(spark, rows, labels, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS).repartition(parts)
    return docs, filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def sample(n, seed=5):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "Ünïcode   word", "word " * 250, "a#b", "ABC"] + [" ".join(rnd.choices(words, k=rnd.choice([3, 150, 220, 400]))) + rnd.choice(["", "", " |", " SHOUTING " * 20]) for _ in range(12)]
    return [(rnd.choice([None, *range(n)]), rnd.choice(texts), rnd.choice([None, "", "en", "de"])) for _ in range(n)]


def test_query_against_sql(spark, sf):
    got = rows_of(registry.op12_filter_audit(spark, sf))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({registry.OP12_SQL})").fetchall()
    assert got == {r[:3]: list(r[3:]) for r in want} and len(got) == 600 * len({p for p, *_ in got})


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_audit_against_brute_force(spark, parts):
    # ranges of many rows, of one row and of one text; the largest group of copies is a third of all rows
    rows = sample(120) + [(k, "the same text", "en") for k in range(60)]
    random.Random(1).shuffle(rows)
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 110, 2)] + [(5, 1, None), (5, 0, 1), (None, 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs, found = audit(spark, rows, [(i, q, int(t) if t is not None else None) for i, q, t in labels])
        assert rows_of(found) == brute(rows, labels)
        masks = Counter((r.doc_id, r.part, r.mask) for r in filter_audit.failures(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert masks == Counter((r[0], r[2] or "", m) for r, m in zip(rows, brute_masks(rows), strict=True))


def test_copies_over_many_ranges():
    # one text over three ranges, then others: all but its first document are late
    edges = [dict(zip(("range", "first", "last", "least", "whole"), x, strict=True)) for x in [(0, b"a", b"b", 5, False), (2, b"b", b"b", 9, True), (3, b"b", b"b", 11, True), (7, b"b", b"c", 1, False), (8, b"d", b"d", None, True), (9, b"d", b"d", None, True)]]
    assert filter_audit._carry(edges) == [(2, 5), (3, 5), (7, 5)]


def test_empty_and_long(spark):
    assert audit(spark, [], [(1, 1, 1)])[1].count() == 0
    long = "Word " * 400_000
    docs, found = audit(spark, [(2, long, "en"), (1, long, "en"), (3, long + "#", "fr")], [])
    assert Counter((r.doc_id, r.mask) for r in filter_audit.failures(docs).collect()) == Counter([(1, 6), (2, 22), (3, 14)])
    assert found.count() == 1200


def test_limits_are_exact():
    words = [f"w{k}" for k in range(200)]
    mask = filter_audit.text_mask
    assert mask(" ".join(words)) == 0 and mask(" ".join(words[:199])) == 1
    assert mask(" ".join(words[:100] * 2)) == 0 and mask(" ".join([*words[:100] * 2, "w0"])) == 2
    assert mask("x " * 97 + "A" * 6) & 4 == 0 and mask("x " * 96 + "A" * 6) & 4 == 4
    # code points, not bytes; only A-Z are capitals; blanks are ASCII
    assert mask("é" * 97 + "AAA") & 4 == 0 and mask("É" * 50) & 4 == 0 and mask("a b") & 1 == 1
