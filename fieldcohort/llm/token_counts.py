"""Token counts of whole texts under a sentencepiece model, huge ones by overlapping chunks.

A text of up to ``chunk`` bytes is encoded as it is.  A longer one is cut into chunks that overlap; each is encoded with
offsets and neighbours are spliced at a common boundary that is proven stable: a place before a blank and after another
character, where no piece of the vocabulary can lie across (checked against the model's pieces when it is loaded), at
which both encodings have a piece boundary.  What a chunk's borders change stays on the border's side of such a place.
Where an overlap holds none, it is doubled, in the end to the whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from fieldcohort.llm.common import slices

CHUNK, OVERLAP, LIMIT = 1 << 16, 1 << 10, 4096
#: How the model writes a blank.
BLANK = "▁"


class Counter:
    """Counts tokens with one sentencepiece model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        pieces = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        # only if no piece has a blank after another character is a place before such a blank stable
        self.stable = not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def offsets(self, raw: bytes, begin: int, end: int) -> np.ndarray:
        """Where each piece of a part of a text begins, in bytes of the text."""
        return np.fromiter((p.begin for p in self.model.encode(raw[begin:end].decode(), return_type="proto").pieces), dtype=np.int64) + begin

    def count(self, text: str) -> int:
        """Tokens of one text."""
        raw = text.encode()
        size = len(raw)
        if size <= self.chunk or not self.stable:
            return len(self.model.encode(text))

        def cut(k: int) -> int:
            # back to the first byte of a character
            while 0 < k < size and raw[k] & 0xC0 == 0x80:
                k -= 1
            return min(k, size)

        total, at, over, origin = 0, 0, self.overlap, 0
        end = cut(self.chunk)
        left = self.offsets(raw, 0, end)
        while end < size:
            # the text from `at` to `end` is encoded as `left`; the next chunk begins `over` before its end
            begin = cut(max(at, end - over))
            stop = cut(begin + max(self.chunk, 2 * over))
            right = self.offsets(raw, begin, stop)
            place = self._common(raw, left, right, begin, end)
            if place is None:
                self.widened += 1
                if begin == at:
                    # the overlap is all there is on the left: encode both together
                    end = cut(at + 2 * (end - at) + self.chunk)
                    left = self.offsets(raw, origin, end)
                    left = left[np.searchsorted(left, at) :]
                else:
                    over *= 2
                continue
            total += int(np.searchsorted(left, place))
            left, at, end, over, origin = right[np.searchsorted(right, place) :], place, stop, self.overlap, begin
        return total + len(left)

    @staticmethod
    def _common(raw: bytes, left: np.ndarray, right: np.ndarray, begin: int, end: int) -> int | None:
        """The last stable place inside the overlap at which both encodings begin a piece; not the first of the right one,
        which has the model's leading blank."""
        mark = BLANK.encode()
        shared = np.intersect1d(left[left < end - 1], right[(right > begin + 1) & (right < end - 1)])
        for place in shared[::-1].tolist():
            if raw[place] == 0x20 and raw[place - 1] != 0x20 and not raw.endswith(mark, 0, place):
                return place
        return None


@functools.lru_cache(2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One counter for each process and model."""
    return Counter(path, chunk, overlap)


def count_documents(df: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Count the tokens of every whole ``text`` of ``df``, without begin and end tokens.

    Returns doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).  A null text counts as empty: no
    bytes, no tokens.  Null or repeated doc_ids pass through row by row; an empty table gives no rows; other columns are
    not read.  A text that has no blank between two words for long is encoded in chunks as long as that stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path, chunk, overlap)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            counts = np.zeros(len(texts), dtype=np.int64)
            counts[short] = [len(x) for x in tool.model.encode([texts[k] for k in short], num_threads=1)]
            for k in set(range(len(texts))) - set(short):
                counts[k] = tool.count(texts[k])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()),
                "n_tokens": pa.array(counts),
                "over_limit": pa.array(counts > limit),
            })

    return df.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
