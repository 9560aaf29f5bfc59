import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from fieldcohort.llm import hashing, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_additive_model_with_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95
    one = quality.fit(x, (x[:, 2] > 0.3).astype(float))
    assert ((one.score(x) > 0.5) == (x[:, 2] > 0.3)).mean() > 0.98


def test_features_of_odd_texts():
    assert quality.features("") == [0.0] * len(quality.FEATURES)
    for t in (" ", "\n\n", "a", "é" * 10, "%$#" * 1000, "w " * 100_000):
        assert np.isfinite(quality.features(t)).all()


def test_quality_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in registry.op5_quality(spark, SF).collect() if r.doc_id in labels and r.held_out]
    y, s = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert len(rows) > 40 and auc(y, s) > 0.95 and ((s >= 0.3) == (np.array([r.predicted for r in rows]) == 1)).all()


def documents(spark):
    rows = [(k, f"a fine text of {k} words and a few more", 0) for k in range(1, 60)] + [(100 + k, f"%%% $$$ ### {k} $$$ |", 0) for k in range(1, 60)]
    return spark.createDataFrame([*rows, (None, "null id", 0), (500, None, 0), (501, "", 0), (1, "again", 0), (502, "long text " * 100_000, 0)], "doc_id long, text string, score int")


def labels(spark):
    rows = [(k, int(k < 100), int(k > 130)) for k in [*range(1, 60), *range(101, 160)]]
    return spark.createDataFrame([*rows, (3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def test_quality_cases(spark):
    docs = documents(spark)
    got = quality.score_documents(docs, labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert not by[None].held_out and by[500].score == by[501].score
    assert all(r.score == 0.5 for r in quality.score_documents(docs, labels(spark).limit(0)).collect())
    assert quality.score_documents(docs.limit(0), labels(spark)).count() == 0


def test_chain_feeds_later_links():
    # the second label follows from the first one's feature only by way of its probability
    rng = np.random.default_rng(1)
    n, row, col = 600, [], []
    first = rng.random(n) < 0.4
    for k in range(n):
        words = {int(w) for w in rng.integers(1, 40, 6)} | ({0} if first[k] else set())
        row += [k] * len(words)
        col += sorted(words)
    x = toxicity.Sparse(np.array(row), np.array(col), n, 40, np.ones((n, 1)))
    y = np.column_stack((first, first)).astype(float)
    chain = toxicity.Chain(np.arange(40), ("a", "b")).fit(x, y, np.arange(n) % toxicity.INNER)
    p = chain.predict(x)
    assert ((p[:, 1] > 0.5) == first).all() and chain.weights[1][40] > 0.1
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_toxic_words_are_found(spark, sf):
    insults = {"trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = registry.op2_toxicity(spark, "/root/testdata/sf0.1").collect()
    bad = {k for k, t in texts.items() if len([w for w in t.lower().replace(".", " ").replace(",", " ").split() if w in insults]) > 2}
    found = {r.doc_id for r in rows if r.toxic}
    assert len(rows) == len(texts) and len(bad & found) > 0.9 * len(bad) and len(bad) > 300
    labelled = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    clean = [k for k, v in labelled.items() if not v]
    assert sum(k in found for k in clean) < 0.01 * len(clean)


def test_toxicity_cases(spark):
    docs = documents(spark)
    got = toxicity.score_documents(docs, labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in got)
    kept = toxicity.reject_toxic(docs, labels(spark))
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id < 60").count() == 60
    none = toxicity.score_documents(docs, labels(spark).limit(0)).collect()
    assert not any(r.toxic for r in none) and {r.p_toxic for r in none} == {0.5}
    assert toxicity.score_documents(docs.limit(0), labels(spark)).count() == 0


@pytest.mark.parametrize("texts", [[b""], [b"", b"a b"], [b"..."]])
def test_features_without_words(texts):
    row, feature = toxicity.present(texts)
    assert len(row) == len(feature) and set(row.tolist()) <= set(range(len(texts)))


# --- against plain loops ----------------------------------------------------------------------------------------------


@lru_cache(None)
def word_buckets(word):
    """Buckets of a word and of its stems, each hashed by itself."""
    hashed, _, starts, _, low = hashing.words([word], hashing.NOT_ALNUM)
    mask = (1 << toxicity.BITS) - 1
    stems = [(int(hashing.prefixes(low, starts, n)[0]) & mask) + ((k + 1) << toxicity.BITS) for k, n in enumerate(toxicity.STEMS) if len(word) >= n]
    return int(hashed[0]) & mask, stems


def plain_features(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    tally, out, share, kinds = Counter(words), set(), Counter(), Counter()
    for w, n in tally.items():
        bucket, stems = word_buckets(w)
        out.add(bucket * toxicity.KINDS)
        for s in stems:
            share[s] += n
            kinds[s] += 1
    for s, n in share.items():
        for j, least in enumerate(toxicity.SHARES):
            if n / len(words) >= least:
                out.add(s * toxicity.KINDS + 1 + 2 * j)
                if kinds[s] > 1:
                    out.add(s * toxicity.KINDS + 2 + 2 * j)
    return out


def test_chain_scores_by_plain_loops(spark, sf):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit_chain(docs, labels)
    assert len(chain.weights) == 2 and len(chain.weights[1]) == len(chain.kept) + 2
    place = {int(f): k for k, f in enumerate(chain.kept)}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in registry.op2_toxicity(spark, SF).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        there = [place[f] for f in plain_features(text) if f in place]
        first, second = (sum(w[k] for k in there) for w in chain.weights)
        p = 1 / (1 + math.exp(-(first + chain.weights[0][-1])))
        q = min(max(p, 1e-3), 1 - 1e-3)
        # the later link reads the earlier one's probability
        p2 = 1 / (1 + math.exp(-(second + chain.weights[1][-2] * math.log(q / (1 - q)) / 4 + chain.weights[1][-1])))
        assert got[doc_id].p_low_quality == pytest.approx(p, abs=1e-9) and got[doc_id].p_toxic == pytest.approx(p2, abs=1e-9)
        assert got[doc_id].toxic == (p2 >= toxicity.THRESHOLD)
    assert abs(chain.weights[1][-2]) > 0


def test_link_weights_are_the_optimum():
    # the penalised likelihood cannot be lowered: no single weight moved by a little makes it smaller
    rng = np.random.default_rng(5)
    n, width = 200, 12
    dense = (rng.random((n, width)) < 0.3).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(dense[:, 0] * 2 - dense[:, 1] * 2)))).astype(float)
    row, col = np.nonzero(dense)
    w = toxicity.fit_linear(toxicity.Sparse(row, col, n, width, np.ones((n, 1))), y, penalty=0.01, steps=4000)

    def loss(v):
        z = [sum(v[c] for c in range(width) if dense[r, c]) + v[-1] for r in range(n)]
        return sum(math.log1p(math.exp(-x if t else x)) for x, t in zip(z, y, strict=True)) / n + 0.01 * sum(abs(x) for x in v[:-1])

    base = loss(w)
    for k in range(width + 1):
        for step in (-1e-3, 1e-3):
            moved = w.copy()
            moved[k] += step
            assert loss(moved) >= base - 1e-9
    assert (w[:-1] == 0).any() and w[0] > 0.5 and w[1] < -0.5


def test_quality_scores_by_plain_loops(spark, sf, monkeypatch):
    models, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: models.append(fit(x, y)) or models[-1])
    got = {r.doc_id: r.score for r in registry.op5_quality(spark, SF).collect()}
    (m,) = models
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(texts) and len(m.pairs) == quality.PAIRS
    for doc_id, text in texts.items():
        x = quality.features(text)
        total = m.base + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(m.edges, m.tables, x, strict=True))
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            total += t[bisect_right(m.pair_edges[i].tolist(), x[i])][bisect_right(m.pair_edges[j].tolist(), x[j])]
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-12)


def plain_tree(g, h, leaves):
    """The same greedy tree by trying every cut of every leaf."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        tries = [(value(a, k) + value(k, b) - value(a, b), -k) for a, b in zip(cuts, cuts[1:], strict=False) for k in range(a + 1, b)]
        best = max(tries, default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, -best[1]])
    return [sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in zip(cuts, cuts[1:], strict=False) for _ in range(a, b)]


def test_a_boosting_turn_by_plain_loops():
    rng = np.random.default_rng(6)
    for size in (1, 2, 5, 12, 32):
        g, h = rng.normal(size=size), rng.random(size)
        for leaves in (2, 3):
            assert np.allclose(quality._tree(g, h, leaves), plain_tree(g.tolist(), h.tolist(), leaves))
    for shape in ((2, 2), (4, 3), (8, 8)):
        g, h = rng.normal(size=shape), rng.random(shape)
        best = (0.0, np.zeros(shape))
        for axis in (0, 1):
            a, b = (g, h) if axis == 0 else (g.T, h.T)
            for k in range(1, len(a)):
                grid, gain = [], 0.0
                for part in (slice(0, k), slice(k, None)):
                    gp, hp = a[part].sum(axis=0).tolist(), b[part].sum(axis=0).tolist()
                    leaf = plain_tree(gp, hp, 2)
                    gain += sum(v * x for v, x in zip(leaf, gp, strict=True))
                    grid += [leaf] * len(a[part])
                if gain > best[0]:
                    best = (gain, np.array(grid) if axis == 0 else np.array(grid).T)
        got, gain = quality._tree2(g, h)
        assert gain == pytest.approx(best[0]) and np.allclose(got, best[1])
    # one round over one feature: the table is the tree's values, times the rate
    x, y = rng.random((300, 1)), (rng.random(300) < 0.4).astype(float)
    m = quality.fit(x, y)
    assert m.base == pytest.approx(math.log(y.mean() / (1 - y.mean())))


def test_samples_are_bounded(spark):
    docs = documents(spark).union(documents(spark)).union(documents(spark))
    chain = toxicity.fit_chain(docs, labels(spark), train_rows=50)
    assert len(chain.weights) == 2
    assert quality.score_documents(docs, labels(spark), train_rows=50).count() == docs.count()
