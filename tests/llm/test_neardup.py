import importlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldcohort.llm import neardup, registry
from fieldcohort.llm.components import components


def shingle_set(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset([tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else [])


def brute(texts, n, percent=80):
    """Smallest id reachable, by comparing all pairs that share a shingle."""
    sets, parent, index = {k: shingle_set(t, n) for k, t in texts.items()}, {k: k for k in texts}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(sets):
        shared = defaultdict(int)
        for s in sets[k]:
            for other in index[s]:
                shared[other] += 1
            index[s].append(k)
        for other, both in shared.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[other]) - both):
                a, b = root(k), root(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), root(k)) for k in texts}


def compare(spark, texts, n, **how):
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in texts.items()], "doc_id long, text string, id string, key int")
    rows = neardup.near_duplicates(df, words=n, **how).collect()
    want = brute(texts, n)
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (want[r.doc_id][1] == r.doc_id) for r in rows)


def groups(seed, copies=70):
    """Copies of a text with up to a dozen edits each: many pairs near the threshold, chains, hubs that are no copy's neighbour."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base, out, k = [word() for _ in range(90)], {}, 0
    for _ in range(copies):
        w = list(base)
        for _ in range(rnd.randrange(0, 12)):
            w[rnd.randrange(len(w))] = word()
        out[k * 3 % 211] = " ".join(w)
        k += 1
    chain = [word() for _ in range(60)]
    for j in range(12):
        out[300 + j] = " ".join(chain[: 60 - 2 * j] + [word() for _ in range(2 * j)])
    for j in range(40):
        out[400 + j] = " ".join(word() for _ in range(30))
    return out


@pytest.mark.parametrize("pairs,block", [(256, 1 << 18), (2, 1 << 18), (2, 900)])
def test_near_copies(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    monkeypatch.setattr(neardup, "BLOCK", block)
    compare(spark, groups(5), 4)


@pytest.mark.parametrize("pairs,rows", [(256, 2048), (20, 37)])
def test_a_common_opening(spark, monkeypatch, pairs, rows):
    # short texts that share their first words: hopeless pairs but for the planted ones, in buckets of hundreds of texts
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    rnd = random.Random(2)
    texts = {k: f"please click here to read more of w{k}" for k in range(1500)}
    texts |= {2000 + k: f"please click here to w{k}" for k in range(1500)}
    tail = [" ".join(f"t{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    # long texts with a common opening of 40 words, in pairs that are a word apart
    opening = " ".join(f"o{k}" for k in range(40))
    texts |= {4000 + 2 * k + j: f"{opening} {t}{' end' * j}" for k, t in enumerate(tail) for j in range(2)}
    # links of the short texts: one more word at the end of the longer opening
    texts |= {5000 + k: f"please click here to read more of w{k} and so on it goes {'further ' * j}" for k in range(30) for j in range(2)}
    texts |= {6000: "please click here to read more of", 6001: "please click here to read more"}
    compare(spark, texts, 4)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_prefixes_lose_no_pair(spark, percent):
    rng = np.random.default_rng(percent)
    pool = rng.integers(-(1 << 62), 1 << 62, 60)
    sets = {k: np.sort(rng.choice(pool, rng.integers(1, 25), replace=False)) for k in range(250)}
    df = spark.createDataFrame([(k, k, k % 3 > 0, v.tolist()) for k, v in sets.items()], "id long, label long, outer boolean, shingles array<long>")
    counts = neardup._counted(df.where("outer"))
    found = defaultdict(list)
    for r in neardup.prefixes(df, counts, percent).collect():
        found[r.token].append((r.id, r.small))
    met = {(a, b) for rows in found.values() for a, small in rows if small for b, _ in rows}
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a != b and len(sets[a]) <= len(sets[b]) and (a % 3 or b % 3) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in met


def test_divided_joins(spark, monkeypatch):
    # as for large tables: hot keys and hubs are joined apart
    from fieldcohort.llm import common

    for module in (common, neardup, importlib.import_module("fieldcohort.llm.components")):
        monkeypatch.setattr(module, "EASY", 10)
    texts = groups(6, 40) | {900 + k: "one and the same text of a few words that many have " * 2 for k in range(60)}
    compare(spark, texts, 4)


def test_words_and_cases(spark):
    texts = {1: None, 2: "", 3: "  \t\n", 4: "one two", 5: "ONE\ttwo", 6: "one", 7: "Ünder straße a b c", 8: "ünder straße a b c", 9: "x " * 50_000, 10: "x " * 60_000, 11: "a b c d", 12: "A B C D", 13: "a b c d e"}
    compare(spark, texts, 4)


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    df = spark.createDataFrame([(5, long), (3, long), (5, other), (9, other), (None, long), (None, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None)) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.reject_copies(df)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 3]


def test_op8_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(texts, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op8_minhash_neardup(spark, sf).collect()} == want


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for j in (0.2, 0.5, 0.8):
        n = 400
        both = int(2 * n * j / (1 + j))
        agree = []
        for _ in range(30):
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : 2 * n - both])))
            s = neardup.sketches([a, b], 128)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - j) < 0.03
    small = neardup.sketches([pool[:1], pool[:3], np.zeros(0, dtype=np.uint64)], 128)
    assert (small[:2] != neardup.EMPTY).all() and (small[2] == neardup.EMPTY).all()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.id: r.label for r in rows}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160))
    more = components(spark.createDataFrame([(5, 130), (300, 301)], "a long, b long"), spark.createDataFrame(rows)).collect()
    later = {r.id: r.label for r in more}
    assert later[159] == 0 and later[40] == 0 and later[301] == 300


def test_links_of_very_large_sets_are_exact():
    # unions of 5,000,009: 100 * 4,000,007 is 20 short of 80 * 5,000,009, less than single precision holds at that size
    def table(first, end, label):
        return pa.table({"id": pa.array([label]), "label": pa.array([label]), "shingles": pa.array([np.arange(first, end)])})

    for common, linked in ((4_000_007, 0), (4_000_008, 1)):
        assert neardup._links(table(0, 4_500_000, 1), table(4_500_000 - common, 5_000_009, 2), 80).num_rows == linked
