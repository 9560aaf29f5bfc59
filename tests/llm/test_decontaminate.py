import random

import numpy as np

from fieldcohort.llm import decontaminate as D
from fieldcohort.llm import registry


def test_every_exact_passage_is_found(spark, sf):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in registry.op9_decontamination(spark, path).collect()}
    assert len(exact) > 20 and exact <= got and len(got - exact) <= 1


def test_no_exact_copy_is_lost(spark):
    # every item of the larger benchmark, 20 times, at any place of many host texts
    path = "/root/testdata/sf0.1"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    hosts = [r.text.split() for r in spark.read.parquet(f"{path}/documents.parquet").where("length(text) > 200").limit(1500).collect()]
    rnd, docs, planted = random.Random(3), [], set()
    for k in range(4000):
        i, host = k % len(items), rnd.choice(hosts)[: rnd.randrange(30, 400)]
        cut = rnd.randrange(len(host) + 1)
        docs.append((k, " ".join([*host[:cut], items[i], *host[cut:]])))
        planted.add((k, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    assert not planted - got


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) if rnd.random() > 0.4 else rnd.choice(words[:20]) for _ in range(n))
    items = [(k, text(rnd.randrange(15, 60)) + ". " + text(6)) for k in range(30)]
    docs = [(k, text(rnd.randrange(5, 600))) for k in range(200)]
    return rnd, words, text, items, docs


def test_paraphrases(spark):
    rnd, words, text, items, docs = corpus()
    planted = {}
    for k, (i, x) in enumerate(items):
        w = x.split(" ")
        for _ in range(len(w) // 8):  # one word in eight is replaced, the answer stays
            w[rnd.randrange(len(w) - 6)] = rnd.choice(words)
        docs.append((1000 + k, f"{text(rnd.randrange(0, 300))} {' '.join(w)} {text(rnd.randrange(0, 300))}"))
        planted[1000 + k] = i
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, cosine double")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, b).collect()}
    assert len(got & set(planted.items())) >= 29 and not {d for d, _ in got} & set(range(200))
    again = {(r.doc_id, r.item_id) for r in D.find_leaks(df, b, items_at_once=11).collect()}
    assert len(again & set(planted.items())) >= 29
    kept = D.reject_leaks(df, b)
    assert kept.columns == df.columns and kept.where("doc_id < 200").count() == 200 and kept.count() <= 201


def test_blocks_change_nothing(spark):
    rnd, words, text, items, docs = corpus(7)
    for k in range(300):
        w = items[k % 30][1].split(" ")
        for _ in range(len(w) // 4):
            w[rnd.randrange(len(w) - 6)] = rnd.choice(words)
        docs.append((1000 + k, f"{text(rnd.randrange(0, 100))} {' '.join(w)} {text(rnd.randrange(0, 100))}"))
    b, df = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda n: sorted((r.doc_id, r.item_id, round(r.cosine, 4), r.lcs, r.answer, r.word) for r in D.find_leaks(df, b, items_at_once=n).collect())
    whole = rows(100)
    assert len(whole) > 200 and rows(1) == whole and rows(13) == whole


def accepted(text, words):
    """Whether any stretch of one and a half items has LCS of the item, and its answer, by trying all of them."""
    (x,) = D.prepare([(0, text)])
    doc, size = D.split([words.encode()])[0].tolist(), len(x.words)
    for k in range(len(doc)):
        part = doc[k : k + size + size // 2 + 1]
        if sum(w in x.masks for w in part) >= D.LCS * size:
            share = D.common_subsequence(x.masks, size, part) / size
            if share >= D.SURE or (share >= D.LCS and D.common_subsequence(x.answer_masks, len(x.answer), part) / len(x.answer) >= D.ANSWER):
                return True
    return False


def test_paraphrases_that_all_stretches_accept(spark):
    rnd, words, text, items, docs = corpus(4)
    planted = set()
    for k in range(1200):
        i, x = items[k % len(items)]
        body, answer = x.split(". ")
        body, most = body.split(" "), (3 * len(x.split()) // 2 + 1) - 6
        for _ in range(len(x.split()) * (1 + k % 3) // 10):  # 10, 20 or 30 % are replaced or come in
            at = rnd.randrange(1, len(body))
            body[at : at + rnd.randrange(2)] = [rnd.choice(words)]
        while k % 4 == 0 and len(body) < most:  # these fill the stretch
            body.insert(rnd.randrange(1, len(body)), rnd.choice(words))
        doc = f"{text(rnd.randrange(0, 200))} {' '.join(body)} {answer} {text(rnd.randrange(0, 200))}"
        if accepted(x, doc):
            planted.add((1000 + k, i))
        docs.append((1000 + k, doc))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(planted) > 1000 and not planted - got, (len(planted), len(planted - got))


def test_cases(spark):
    item = "the quick brown fox jumps over the lazy dog while nine clever zebras watch in silence. forty two"
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "short one")], "item_id long, text string")
    df = spark.createDataFrame([(1, None), (2, ""), (3, item.upper()), (3, item), (None, item), (5, "x " * 200_000 + item), (6, "nothing of it"), (7, "a short one here")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0) for r in D.find_leaks(df, b).collect()))
    assert got == [(0, 0), (0, 1), (3, 0), (3, 0), (3, 1), (3, 1), (5, 0), (5, 1), (7, 4)]
    assert D.find_leaks(df, b.limit(0)).count() == 0 and D.find_leaks(df.limit(0), b).count() == 0


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        assert D.common_subsequence(D._masks(a.astype(np.uint64)), len(a), b.tolist()) == slow(a.tolist(), b.tolist())


def test_svd_finds_the_dominant_directions():
    rng = np.random.default_rng(2)
    t = rng.poisson(0.3, (500, 60)).astype(float) + 3 * np.outer(rng.random(500) < 0.5, np.r_[np.ones(10), np.zeros(50)])
    idf = np.ones(60)
    test = rng.standard_normal((60, 20))
    p = D._nystroem(t.T @ (t @ test), idf, test, 5)
    u = np.linalg.svd(t)[2][0]
    q, _ = np.linalg.qr(p.astype(float))
    assert np.linalg.norm(q.T @ u) > 0.99


def test_the_cosine_decides():
    rnd, words, text, items, docs = corpus(3)
    own = D.prepare(items)
    vocabulary = np.unique(np.concatenate([x.words for x in own]))
    space = D.term_vectors(np.random.default_rng(1).normal(size=(len(vocabulary), 32)), np.full(len(vocabulary), 5.0))
    texts = [f"{text(50)} {x} {text(50)}".encode() for _, x in items]
    hits = {c: {(t, k) for t, k, *_ in D.Finder(own, vocabulary, space, cosine=c).find(texts)} for c in (D.COSINE, 9.0)}
    assert hits[D.COSINE] == {(k, k) for k in range(len(items))} and not hits[9.0]


def test_memory_of_a_block_of_long_items():
    # 2,000 items of 400 words of their own: a worker of the search stays small
    import subprocess
    import sys

    code = r"""
import re
import numpy as np
from fieldcohort.llm import decontaminate as D
rng = np.random.default_rng(0)
most = lambda: int(re.search(r"VmHWM:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
before = most()
texts = [" ".join(f"w{k * 400 + j}" for j in range(400)) for k in range(2000)]
items = D.prepare(list(enumerate(texts)))
vocabulary = np.unique(np.concatenate([x.words for x in items]))
space = np.zeros((len(vocabulary) + 1, D.LATENT), dtype=np.float32)
for k in range(0, len(vocabulary), 10_000):
    space[k : k + 10_000] = rng.standard_normal((len(space[k : k + 10_000]), D.LATENT))
space[-1] = 0
tool = D.Finder(items, vocabulary, space)
assert len(tool.find([t.encode() for t in texts[:300]])) == 300
for k in range(300, 900, 50):
    assert len(tool.find([t.encode() for t in texts[k : k + 50]])) == 50
print(most(), before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, env=__import__("os").environ | {"OMP_NUM_THREADS": "1"})
    most, before = map(float, done.stdout.split())
    assert most < 450 and most - before < 330, (most, before)


def test_short_items(spark):
    b = spark.createDataFrame([(1, "xyzzy"), (2, "plugh frobnicate"), (3, "one rare quuxword here"), (4, "seven words make up this whole grault")], "item_id long, text string")
    rnd = random.Random(1)
    fill = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "one", "here"]) for _ in range(n))
    docs, want = [], set()
    for k in range(200):
        text = ["xyzzy", "plugh frobnicate", "one rare quuxword here", "seven words make up this whole grault"][k % 4]
        docs.append((k, f"{fill(k % 13)} {text} {fill(k % 7)}"))
        want.add((k, k % 4 + 1))
    docs += [(1000 + k, fill(50)) for k in range(20)]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert got == want
