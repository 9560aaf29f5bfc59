"""Token ids as flat files: unsigned integers, 64-bit document offsets, read by memory maps.

A corpus is a folder of numbered pairs of files.  ``kind=uint16/part-K`` (or ``uint32``, for vocabularies beyond 65,536
ids) holds the ids of consecutive documents, each with an end id of 0, and nothing else.  ``kind=index/part-K`` holds 16
bytes a document: its doc_id (signed, 64 bits) and where its ids begin in that file (unsigned, 64 bits), little-endian.
Documents ascend by doc_id through all files in the order of their numbers; where a file begins in the corpus, its base,
is the prefix sum of the files' lengths before it, so that no task needs to know of another while it writes.

Both come from one pass of Spark's text writer, whose committer keeps half-written files of lost tasks out: a row is a
document's ids or its index entry, and what the writer puts after a row, where a text has its line end, is an id of 0; in
the index these bytes are the highest of the offset.  Two writers a task, one for each kind, keep both in the task's order.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcohort.llm.common import local_path, open_file, release, slices, small_batches
from fieldcohort.llm.splitting import RARE, SPLIT

#: Text bytes of a file, on average; a file is one task's work and some 0.8 times as large.
FILE_BYTES = 128 << 20
#: Files that a corpus has at least, if it has as many times LEAST_BYTES of text.
FILES, LEAST_BYTES = 48, 1 << 20
#: Text bytes encoded at once, and characters from which on a text that goes to the library is cut.
PIECE_BYTES = 1 << 18
#: Pre-tokens that each of the memo's two generations keeps, and how long they are at most.
MEMO, LONG = 400_000, 64
#: Ids that the reader holds at once.
READ_IDS = 1 << 20
#: Bit of an index entry's offset that marks a document without doc_id.
NO_ID = 1 << 31
#: A blank between two characters that are none: the split pattern of byte-level BPE always begins a pre-token there.
CUT = re.compile(r"(?<=\S) (?=\S)")


class _Memo(dict):
    """Packed ids of pre-tokens; the library's model is asked for those that are not there."""

    def __init__(self, model, dtype: np.dtype, most: int):
        # a full memo becomes the old one, from which pre-tokens that come again are taken over
        self.model, self.dtype, self.most, self.old = model, dtype, most, {}
        # the characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on
        plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        others = [k for k in range(256) if k not in plain]
        self.pack = [struct.Struct(f"<{n}{'H' if dtype.itemsize == 2 else 'I'}").pack for n in range(16)]
        self.letters = {k: chr(k) for k in plain} | {k: chr(256 + n) for n, k in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            got = self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, dtype=self.dtype).tobytes()
        if len(piece) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """A tokenizer file of the ``tokenizers`` library.

    For byte-level BPE without normalizer or leading blank, texts of common characters are split by the published pattern and
    the library's model encodes each pre-token that the memo does not hold; its own splitting takes most of its time.  Texts
    with RARE characters or added tokens, and all texts of other tokenizers, go to the library as they are; long ones are cut
    before single blanks, where pre-tokens begin whatever stands around them, so that what it holds at once is bounded."""

    def __init__(self, path: str, piece: int = PIECE_BYTES, most: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tool, self.piece = Tokenizer.from_file(path), piece
        how = json.loads(self.tool.to_str())
        before, model = how["pre_tokenizer"] or {}, how["model"]
        self.added = [x["content"] for x in how["added_tokens"]]
        blanks = any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in how["added_tokens"])
        self.cuts = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not how["normalizer"] and not blanks
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
        self.split = SPLIT.findall if self.cuts and plain else None
        self.dtype = np.dtype("<u2" if self.tool.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.memo = _Memo(self.tool.model, self.dtype, most)

    def pieces(self, text: str) -> list[str]:
        if not self.cuts or len(text) <= self.piece:
            return [text]
        out, start = [], 0
        while len(text) - start > self.piece and (cut := CUT.search(text, start + self.piece)):
            out.append(text[start : cut.start()])
            start = cut.start()
        return [*out, text[start:]]

    def common(self, text: str) -> bool:
        """Whether pre-tokens are those of the library for certain."""
        return self.split is not None and not RARE.search(text) and not any(a in text for a in self.added)

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed little-endian in ``dtype``."""
        if self.common(text):
            return b"".join(map(self.memo.__getitem__, self.split(text)))
        got = (self.tool.encode_batch_fast([p], add_special_tokens=False)[0].ids for p in self.pieces(text))
        return b"".join(np.array(x, dtype=self.dtype).tobytes() for x in got)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each process and file."""
    return Encoder(path)


@contextlib.contextmanager
def _writers(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks write up to ``most`` files of different partition values at once, in the order of their rows."""
    name, conf = "spark.sql.maxConcurrentOutputFileWriters", spark.conf
    explicit, before = name in conf.getAll, conf.get(name)
    conf.set(name, str(most))
    try:
        yield
    finally:
        conf.set(name, before) if explicit else conf.unset(name)


def write_files(docs: DataFrame, path: str, tokenizer: str, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole ``text`` of ``docs`` (doc_id, text) and write the corpus to the new folder ``path``.

    A null or empty text is its end id alone.  Rows follow doc_id, null ids first; rows of one id follow a hash of their
    text, and equal rows each have a place of their own, so that files stay even if many rows share an id.  Other columns
    are not read; an empty table writes no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    files = max(-(-size // file_bytes), min(FILES, -(-size // LEAST_BYTES)), 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        width, at = tool.dtype.itemsize, 0
        for batch in slices(batches, "text", PIECE_BYTES):
            got = [tool.encode(t) for t in batch.column("text").to_pylist()]
            entries = np.zeros(len(got), dtype=INDEX)
            sizes = np.array([len(x) // width + 1 for x in got], dtype=np.uint64)
            entries["start"] = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            if batch.column("doc_id").null_count:
                entries["start"] |= np.where(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), np.uint64(NO_ID), np.uint64(0))
            entries["doc_id"] = batch.column("doc_id").fill_null(0).to_numpy()
            if at >= NO_ID:
                raise ValueError("a file has over 2^31 ids; give fewer bytes to a file")
            packed = entries.tobytes()
            values = got + [packed[k : k + 16 - width] for k in range(0, len(packed), 16)]
            kinds = [f"uint{8 * width}"] * len(got) + ["index"] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.binary())], names=["kind", "value"])
        # the worker lives on after the task, with its memo
        release()

    with small_batches(spark), _writers(spark, 4):
        out = ordered.mapInArrow(run, "kind string, value binary").select("kind", F.col("value").cast("string").alias("value"))
        width = encoder(tokenizer).dtype.itemsize
        out.write.partitionBy("kind").option("lineSep", "\0" * width).option("maxRecordsPerFile", 0).option("compression", "none").text(path)


INDEX = np.dtype([("doc_id", "<i8"), ("start", "<u8")])


class Flat:
    """A flat file as an array: a memory map where the file system is the machine's own or mounted there, ranged reads by
    Arrow's file systems elsewhere."""

    def __init__(self, uri: str, dtype: np.dtype, size: int):
        self.dtype, self.n, self.file = dtype, size // dtype.itemsize, None
        if local := local_path(uri):
            self.map = np.memmap(local, dtype=dtype, mode="r") if self.n else np.zeros(0, dtype)
        else:
            self.file = open_file(uri)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return self.map[at]
        start, stop, _ = at.indices(self.n)
        return np.frombuffer(self.file.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), dtype=self.dtype)


class Pair:
    """One file of ids and its index: ``document(k)`` is the k-th document's ids, with the end id."""

    def __init__(self, ids_uri: str, ids_size: int, index_uri: str, index_size: int):
        kind = re.search(r"kind=(uint\d+)/", ids_uri)[1]
        self.ids, self.index = Flat(ids_uri, np.dtype(kind).newbyteorder("<"), ids_size), Flat(index_uri, INDEX, index_size)

    def entries(self, low: int, high: int) -> tuple[list[int | None], np.ndarray]:
        """doc_ids of the documents from ``low`` to ``high``, and their starts, with that of the one behind them."""
        got = self.index[low : high + 1]
        known = (got["start"] & np.uint64(NO_ID)) == 0
        starts = (got["start"] & ~np.uint64(NO_ID)).astype(np.int64)
        if high >= self.index.n:
            starts = np.append(starts, self.ids.n)
        return [int(d) if k else None for d, k in zip(got["doc_id"][: high - low], known, strict=False)], starts

    def document(self, k: int) -> np.ndarray:
        _, (start, stop) = self.entries(k, k + 1)
        return self.ids[start:stop]


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of files below ``path``: number, ids_uri, ids_size, index_uri, index_size and base, the ids of all files
    before.  One row for each file, so that one task may order them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    found = found.select("*", F.regexp_extract("path", r"kind=(\w+)/part-\d+", 1).alias("kind"), F.regexp_extract("path", r"kind=\w+/part-(\d+)", 1).cast("long").alias("number"))
    ids = found.where("kind like 'uint%'").selectExpr("number", "path ids_uri", "length ids_size", "length div (cast(substr(kind, 5) as int) div 8) as n_ids")
    index = found.where("kind = 'index'").selectExpr("number", "path index_uri", "length index_size")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return ids.join(index, "number").select("number", "ids_uri", "ids_size", "index_uri", "index_size", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Read a corpus back: doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), one row a document; a folder without files gives no rows."""
    pairs = corpus_files(spark, path)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair, low = Pair(row["ids_uri"], row["ids_size"], row["index_uri"], row["index_size"]), 0
                while low < pair.index.n:
                    ids, starts = pair.entries(low, min(low + 4096, pair.index.n))
                    sums, k = [], 0
                    while k < len(ids):
                        # as many documents as READ_IDS hold, one at least; one longer than that in pieces
                        stop = max(k + 1, int(np.searchsorted(starts, starts[k] + READ_IDS, side="right")) - 1)
                        if stop == k + 1:
                            crc = 0
                            for begin in range(starts[k], starts[k + 1], READ_IDS):
                                crc = zlib.crc32(pair.ids[begin : min(begin + READ_IDS, starts[k + 1])].astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        else:
                            raw = memoryview(pair.ids[starts[k] : starts[stop]].astype("<u4").tobytes())
                            cuts = (starts[k : stop + 1] - starts[k]) * 4
                            sums += [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                        k = stop
                    columns = (ids, starts[:-1] + row["base"], np.diff(starts), sums)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])
                    low += len(ids)

    # a task for each file: so few bytes would else be joined to one task
    tasks = max(1, pairs.count())
    return pairs.repartitionByRange(tasks, "number").mapInArrow(run, ", ".join(f"{n} long" for n, _ in kinds))
