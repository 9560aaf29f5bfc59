"""Benchmark decontamination by latent semantic retrieval.

1. Fit: every document is cut into passages; over the terms of the benchmark, document frequencies and the product
   T'T W (T: passage-term counts, W: a random test matrix of signs) are summed in one distributed pass.  With idf weights on both
   sides that is the sketch of a randomised SVD of the TF-IDF passage matrix, completed in its single-pass (Nystroem) form
   on a matrix of terms by a few dozen columns.
2. Retrieve: a term's vector is its direction in latent space, as long as its idf.  Windows of about an item's length over
   every document, and the items' own windows, are sums of such vectors; windows whose cosine with an item's reaches COSINE,
   and that share MEMBERS of their words with it, are candidates, all of them.
3. Verify: the longest common subsequence of the item and a stretch around the window must cover LCS of the item's
   words; under SURE, the item's answer (its last sentence) must be found there as well.

The benchmark is a stated query set: terms and latent space are those of all items, the search takes blocks of ITEMS items,
each of which is a pass over the documents.  What is found of an item does not depend on the blocks.  The fit holds SKETCH
numbers for each distinct word of the benchmark in a task (16 MB for 100,000 words), the search LATENT.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcohort.llm import hashing
from fieldcohort.llm.common import slices, small_batches, without

ITEMS, PASSAGE, SKETCH, LATENT = 2000, 64, 40, 32
#: Bytes of the items of a block, on average.
ITEM_BYTES = 16 << 20
COSINE, LCS, SURE, ANSWER = 0.7, 0.7, 0.9, 0.6
#: Share of a window's words that are an item's: LCS of it over a stretch of one and a half items, less what the window's place costs.
MEMBERS = 0.9 * LCS / 1.5
#: Window lengths in words; an item belongs to the longest that is not longer than itself.
SCALES = (1, 2, 4, 8, 16, 32, 64)
#: Windows begin at multiples of this many words, or of one word if any item is shorter than SHORT.
UNIT, SHORT = 4, 11
#: Units whose windows are compared with the items' at once, and columns of the items' tables of words.
STRIDE, MARKS = 4096, 4096
#: Cosines computed at once, and items whose masks a worker keeps.
COSINES, KEPT = 1 << 21, 256
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, word long"
#: Terms in a block of the summed matrices, and how many sums a task takes in at once.
BLOCK, FAN_IN = 512, 64


def split(texts: list[bytes]):
    """Word hashes and owners: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    hashed, owner, *_ = hashing.words(texts, hashing.NOT_ALNUM)
    return hashed, owner


@dataclass
class Item:
    """A benchmark item: its words and those of its answer; masks have a bit for each place of a word."""

    item_id: int
    words: np.ndarray
    answer: np.ndarray
    scale: int
    #: Rows of the benchmark that are this item.
    copies: int = 1

    @functools.cached_property
    def masks(self) -> dict[int, int]:
        return _masks(self.words)

    @functools.cached_property
    def answer_masks(self) -> dict[int, int]:
        return _masks(self.answer)

    def forget(self) -> None:
        self.__dict__.pop("masks", None)
        self.__dict__.pop("answer_masks", None)


def prepare(rows: list[tuple[int, str]] | list[tuple[int, str, int]]) -> list[Item]:
    """Items from (item_id, text) and perhaps how often each row is there; texts without words are left out, as nothing can
    hold them."""
    items = []
    for item_id, text, *copies in rows:
        words, _ = split([(text or "").encode()])
        if not len(words):
            continue
        sentences = [s for s in re.split(r"[.?!\n]+", text) if s.strip()]
        answer, _ = split([sentences[-1].encode()]) if sentences else (words, None)
        if len(answer) < 3:
            answer = words[-5:]
        scale = max([s for s in SCALES if s <= len(words)], default=SCALES[0])
        items.append(Item(item_id, words, answer, scale, *(copies or [1])))
    return items


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | (1 << k)
    return out


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (as bit masks) and a list of words, a bit-parallel sweep."""
    full = state = (1 << size) - 1
    for w in words:
        if m := masks.get(w):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


def wide(size: int) -> int:
    """Words of the stretch in which LCS of an item has to lie."""
    return size + size // 2 + 1


def _terms(vocabulary: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Index of each word among the benchmark's terms, -1 for others."""
    at = np.searchsorted(vocabulary, hashed)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashed, at, -1)


def signs(terms: np.ndarray, sketch: int) -> np.ndarray:
    """The rows of the random test matrix of these terms (hashes): signs from the bits of another hash of each, so that no task
    holds the matrix."""
    bits = hashing.mix(terms + hashing.seed(7))
    return (((bits[:, None] >> np.arange(sketch, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1).astype(np.float32)


def fit(docs: DataFrame, vocabulary: np.ndarray, latent: int = LATENT, sketch: int = SKETCH) -> np.ndarray:
    """The matrix (terms by latent dimensions) that takes a passage's term counts to latent space, from all documents."""
    size = len(vocabulary)
    schema = "block int, part int, passages long, df binary, z binary"

    def rows(z: np.ndarray, df: np.ndarray, n: int, part: int) -> pa.RecordBatch:
        cut = [slice(k, k + BLOCK) for k in range(0, size, BLOCK)]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([n] * len(cut), pa.int64()), pa.array([df[c].tobytes() for c in cut], pa.binary()), pa.array([z[c].astype(np.float64).tobytes() for c in cut], pa.binary())],
            names=["block", "part", "passages", "df", "z"],
        )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        z, df, n = np.zeros((size, sketch), dtype=np.float32), np.zeros(size), 0
        for batch in slices(batches, "text"):
            hashed, owner = split([(t or "").encode() for t in batch.column("text").to_pylist()])
            if not len(hashed):
                continue
            place = np.arange(len(hashed)) - np.searchsorted(owner, owner)
            starts = place % PASSAGE == 0
            passage = np.cumsum(starts) - 1
            n += int(starts.sum())
            term = _terms(vocabulary, hashed)
            keep = term >= 0
            pairs, counts = np.unique(passage[keep] * size + term[keep], return_counts=True)
            if not len(pairs):
                continue
            p, t = pairs // size, pairs % size
            df += np.bincount(t, minlength=size)
            counts = counts.astype(np.float32)[:, None]
            first = np.flatnonzero(np.diff(p, prepend=-1))
            own, of = np.unique(t, return_inverse=True)
            projected = np.add.reduceat(signs(vocabulary[own], sketch)[of] * counts, first, axis=0)[np.cumsum(np.diff(p, prepend=p[0]) > 0)]
            order = np.argsort(t, kind="stable")
            edge = np.flatnonzero(np.diff(t[order], prepend=-1))
            z[t[order][edge]] += np.add.reduceat((projected * counts)[order], edge, axis=0)
        yield rows(z, df, n, TaskContext.get().partitionId())

    def add(_, group: pa.Table) -> pa.Table:
        # blocks of equal terms; passages are counted once, with each block
        df = sum(np.frombuffer(x.as_py()) for x in group["df"])
        z = sum(np.frombuffer(x.as_py()) for x in group["z"])
        return pa.table({"block": [group["block"][0].as_py()], "part": [group["part"][0].as_py() // FAN_IN], "passages": [sum(group["passages"].to_pylist())], "df": [df.tobytes()], "z": [z.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("passages", pa.int64()), ("df", pa.binary()), ("z", pa.binary())]))

    summed = docs.select("text").mapInArrow(sums, schema)
    parts = max(1, docs.rdd.getNumPartitions())
    while parts > 1:
        summed = summed.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(lambda k, g: add(k, g).set_column(1, "part", pa.array([k[1].as_py()], pa.int32())), schema)
        parts = -(-parts // FAN_IN)
    with small_batches(docs.sparkSession):
        got = sorted(summed.collect(), key=lambda r: r["block"])  # terms x sketch, whatever the documents
    if not got:
        return np.zeros((size + 1, latent), dtype=np.float32)
    df = np.concatenate([np.frombuffer(r["df"]) for r in got])
    z = np.concatenate([np.frombuffer(r["z"]).reshape(-1, sketch) for r in got])
    idf = np.log((1 + got[0]["passages"]) / (1 + df)) + 1
    return term_vectors(_nystroem(z, idf, signs(vocabulary, sketch).astype(np.float64), latent), idf)


def _nystroem(z: np.ndarray, idf: np.ndarray, test: np.ndarray, latent: int) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix from its sketch, over their singular values, times idf."""
    # A = T diag(idf); with the test matrix W / idf the sketch A'A (W / idf) is idf * T'T W
    if not z.any():
        return np.zeros((len(idf), latent), dtype=np.float32)
    test, y = test / idf[:, None], z * idf[:, None]
    shift = 1e-9 * max(np.linalg.norm(y), 1e-300)
    y = y + shift * test
    inner = test.T @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > values.max() * 1e-10
    f = y @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(f, full_matrices=False)
    kept = min(latent, int((s > s[0] * 1e-6).sum())) if len(s) else 0
    out = np.zeros((len(idf), latent))
    out[:, :kept] = u[:, :kept] / s[:kept]
    return (idf[:, None] * out).astype(np.float32)


def term_vectors(project: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """With a row of zeros behind them, for words that are no terms (index -1), the terms' directions in latent space, each as long as its idf: so no single foreign word of a window outweighs the
    others, and the cosine of two windows is about the share of rare words that they have in common, or related ones."""
    out = np.zeros((len(project) + 1, project.shape[1]), dtype=np.float32)
    out[:-1] = project * (idf / np.maximum(np.linalg.norm(project, axis=1), 1e-30))[:, None]
    return out


def _query_windows(items: list[Item], vocabulary: np.ndarray, project: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each scale: unit vectors of the items' windows, and the index of the item of each."""
    out = {}
    for scale in {x.scale for x in items}:
        vectors, owners = [], []
        for k, item in enumerate(items):
            if item.scale != scale:
                continue
            term = _terms(vocabulary, item.words)
            last = max(0, len(term) - scale)
            for start in sorted({*range(0, last + 1, max(1, scale // 4)), last}):
                v = project[term[start : start + scale]].sum(axis=0)
                vectors.append(v / max(np.linalg.norm(v), 1e-30))
                owners.append(k)
        out[scale] = np.array(vectors, dtype=np.float32), np.array(owners)
    return out


class Finder:
    """Finds the items of one block in texts: candidates by the cosine of their windows with those of items, then the checks."""

    def __init__(self, items: list[Item], vocabulary: np.ndarray, project: np.ndarray, cosine: float = COSINE, unit: int = UNIT):
        self.items, self.vocabulary, self.cosine = items, vocabulary, cosine
        self.project, self.unit = project, unit
        #: Items that have masks now.
        self.used: set[int] = set()
        self.queries = _query_windows(items, vocabulary, project)
        # words of items by their index modulo MARKS: a word of an item is always marked, few others are
        self.member = np.zeros((len(items), MARKS + 1), dtype=bool)
        for k, item in enumerate(items):
            self.member[k, _terms(vocabulary, item.words) % MARKS] = True
        self.lengths = np.array([len(x.words) for x in items])
        self.wide = np.array([wide(len(x.words)) for x in items])
        self.shortest = {s: min(len(x.words) for x in items if x.scale == s) for s in self.queries}

    def find(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float, int]]:
        """(text index, item index, cosine, share of the item, share of its answer, first word of the window)."""
        hashed, owner = split(texts)
        if not len(hashed):
            return []
        term, n = _terms(self.vocabulary, hashed), len(texts)
        bounds = np.searchsorted(owner, np.arange(n + 1))
        units = -(-np.diff(bounds) // self.unit)
        unit_from = np.cumsum(units) - units
        unit_owner = np.repeat(np.arange(n), units)
        first_word = bounds[unit_owner] + (np.arange(len(unit_owner)) - unit_from[unit_owner]) * self.unit
        known = np.concatenate(([0], np.cumsum(np.add.reduceat((term >= 0).astype(np.int32), first_word))))
        marks = np.where(term >= 0, term % MARKS, MARKS)
        windows = []
        for scale in self.queries:
            across, step = max(1, scale // self.unit), max(1, scale // 4 // self.unit)
            room = np.maximum(units - across, 0)
            counts = np.where(units > 0, -(-room // step) + 1, 0)
            text = np.repeat(np.arange(n), counts)
            start = np.minimum((np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * step, room[text])
            low, high = unit_from[text] + start, unit_from[text] + np.minimum(start + across, units[text])
            # a window with fewer terms of the benchmark than a single item's has to have cannot pass below
            enough = np.flatnonzero(known[high] - known[low] >= MEMBERS * min(scale, self.shortest[scale]))
            windows.append((scale, text[enough], low[enough], high[enough]))
        near: list[np.ndarray] = []
        for base in range(0, len(first_word), STRIDE):
            parts = [(scale, slice(*np.searchsorted(low, (base, base + STRIDE)))) for scale, _, low, _ in windows]
            top = max((high[at].max() for (_, at), (*_, high) in zip(parts, windows, strict=True) if at.stop > at.start), default=base)
            if top > base:
                # sums of the words' vectors up to each unit, once for the windows of all lengths
                begin, end = first_word[base], first_word[top] if top < len(first_word) else len(term)
                sums = np.zeros((top - base + 1, self.project.shape[1]))
                np.cumsum(np.add.reduceat(self.project[term[begin:end]], first_word[base:top] - begin, axis=0), axis=0, dtype=np.float64, out=sums[1:])
                for (scale, at), (_, text, low, high) in zip(parts, windows, strict=True):
                    if at.stop > at.start:
                        near += self._near(sums, base, marks, bounds, first_word, text[at], low[at], high[at], scale)
        return self._verify(np.concatenate(near), hashed, bounds) if any(map(len, near)) else []

    def _near(self, sums, base, marks, bounds, first_word, text, low, high, scale) -> list[np.ndarray]:
        """Which windows, given by their first and last units, are near a window of an item: rows of text, item, first word and
        end of the window, cosine."""
        vectors, owners = self.queries[scale]
        v = (sums[high - base] - sums[low - base]).astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
        w_from, w_to = first_word[low], np.minimum(first_word[high - 1] + self.unit, bounds[text + 1])
        rows, some = [], max(1, COSINES // len(vectors))
        for k in range(0, len(v), some):
            close = v[k : k + some] @ vectors.T
            at, q = np.nonzero(close >= self.cosine)
            rows.append((at + k, q, close[at, q]))
        at, q, cosine = (np.concatenate(c) for c in zip(*rows, strict=True))
        flat, out = self.member.ravel(), []
        for k in range(0, len(at), 16384):
            a, i = at[k : k + 16384], owners[q[k : k + 16384]]
            place = w_from[a][:, None] + np.arange(scale)
            # words past the window's end count as those that no item has; a window inside a copy holds few others
            words = np.where(place < w_to[a][:, None], marks[np.minimum(place, len(marks) - 1)], MARKS)
            shared = np.take(flat, i[:, None] * (MARKS + 1) + words).sum(axis=1, dtype=np.int16)
            good = shared >= MEMBERS * np.minimum(scale, self.lengths[i])
            out.append(np.column_stack((text[a], i, w_from[a], w_to[a], cosine[k : k + 16384]))[good])
        return out

    def _verify(self, near: np.ndarray, hashed: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """The candidates that pass, the best stretch of each text and item."""
        text, item, w_from, w_to = near[:, :4].astype(np.int64).T
        # a stretch around the window, wherever in it the window lies; those of an item that meet are one
        reach = self.wide[item]
        begin, end = np.maximum(bounds[text], w_to - reach), np.minimum(bounds[text + 1], w_from + reach)
        order = np.lexsort((begin, item, text))
        text, item, begin, end, cosine = text[order], item[order], begin[order], end[order], near[order, 4]
        apart = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])])
        found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for row, stop, most in zip(apart.tolist(), np.maximum.reduceat(end, apart).tolist(), np.maximum.reduceat(cosine, apart).tolist(), strict=True):
            key = int(text[row]), int(item[row])
            if found.get(key, (0, 0))[1] < SURE and (got := self._best(self.items[key[1]], hashed[begin[row] : stop].tolist())) and got[:2] > found.get(key, (0, 0, 0))[1:3]:
                found[key] = (most, *got[:2], int(begin[row] + got[2] - bounds[key[0]]))
        self.used.update(item[apart].tolist())
        if len(self.used) > KEPT:
            for k in self.used:
                self.items[k].forget()
            self.used.clear()
        return [(t, k, *x) for (t, k), x in sorted(found.items())]

    @staticmethod
    def _best(x: Item, region: list[int]) -> tuple[float, float, int] | None:
        """The shares of item and answer in the best stretch of a region, one and a half items long, and its first word."""
        size, most = len(x.words), wide(len(x.words))
        if common_subsequence(x.masks, size, region) < LCS * size:
            return None
        best = (0.0, 0.0, 0)
        # every stretch counts; one that begins with a word of the item has all that those before it have
        hit = [w in x.masks for w in region]
        held = sum(hit[:most])
        for k, own in enumerate(hit):
            share = min(held, size) / size
            if own and share >= LCS and share > best[0]:
                part = region[k : k + most]
                share = common_subsequence(x.masks, size, part) / size
                if share >= LCS and share > best[0]:
                    answer = common_subsequence(x.answer_masks, len(x.answer), part) / len(x.answer)
                    if share >= SURE or answer >= ANSWER:
                        best = (share, answer, k)
            elif best[0] >= SURE and k > best[2] + most:
                break  # a sure copy; what follows is another one
            held += (hit[k + most] if k + most < len(hit) else 0) - own
        return best if best[0] else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, word): one row for each document and benchmark item it holds.

    Items and documents whose text is null or has no words match nothing; items of equal text each match; rows with
    repeated ids are handled row by row and a null doc_id stays null.  Empty tables give no rows; other columns are not
    read.  Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    benchmark = benchmark.selectExpr("cast(item_id as long) item_id", "text")
    # rows that repeat are one item, whose finds are repeated; so a block has a bounded number of items, and of bytes
    benchmark = benchmark.groupBy("item_id", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))
    size = benchmark.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["rows"] // items_at_once), -(-size["bytes"] // ITEM_BYTES))
    parts = [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else benchmark for b in range(blocks)]
    vocabulary, unit = np.zeros(0, dtype=np.uint64), UNIT
    for part in parts:
        words, owner = split([(r["text"] or "").encode() for r in part.select("text").collect()])
        vocabulary = np.union1d(vocabulary, words)
        if len(owner) and np.unique(owner, return_counts=True)[1].min() < SHORT:
            unit = 1
    if not len(vocabulary):
        return docs.sparkSession.createDataFrame([], FOUND)
    project = fit(docs, vocabulary)
    space = docs.sparkSession.sparkContext.broadcast((vocabulary, project))
    out = None
    for part in parts:
        items = prepare([(r["item_id"], r["text"], r["n"]) for r in part.orderBy("item_id", "text").collect()])  # one block of the stated query set
        if items:
            got = _search(docs, items, space, unit)
            out = got if out is None else out.unionByName(got)
    return out


def _search(docs: DataFrame, items: list[Item], space: Broadcast, unit: int) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Finder(block.value, *space.value, unit=unit)
        for batch in slices(batches, "text"):
            hits = tool.find([(t or "").encode() for t in batch.column("text").to_pylist()])
            hits = [h for h in hits for _ in range(tool.items[h[1]].copies)]
            ids = batch.column("doc_id")
            columns = zip(*hits, strict=True) if hits else [()] * 6
            text, item, cosine, lcs, answer, word = columns
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text, pa.int64())), pa.array([tool.items[k].item_id for k in item], pa.int64()), pa.array(cosine, pa.float64()), pa.array(lcs, pa.float64()), pa.array(answer, pa.float64()), pa.array(word, pa.int64())],
                names=["doc_id", "item_id", "cosine", "lcs", "answer", "word"],
            )

    return docs.mapInArrow(run, FOUND)


def reject_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id holds no benchmark item; same columns.  Rows without doc_id are kept."""
    return without(docs, find_leaks(docs, benchmark, **how).select(F.col("doc_id").alias("id")), "leak-ids")
