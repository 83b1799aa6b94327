"""Problem 6: encode a corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction. A text is cut in halves until a piece is short,
the pieces are encoded on their own, and neighbours are joined by re-encoding a
window around the cut. The window grows until it is bounded on either side by a
place where no token can cross.

Such places can be named from the text alone. The pre-tokenizer's alternatives
never match a non-space character followed by a white-space character, so every
position between the two starts a new pre-token, whatever surrounds it, and no
look-ahead of the part before it can see past it. Hence for a text ``a + b`` cut
there, ``encode(a + b) == encode(a) + encode(b)``, and tokens outside the window
are final. With no such place in a half the window reaches its end, so a text of
one unbroken run is still encoded exactly.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenizer pattern of the public byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the characters of Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")

LEAF_CHARS = 16_384
FIRST_WINDOW = 64

_ENCODERS: dict[str, "TreeEncoder"] = {}


class TreeEncoder:
    """Encodes and decodes single texts by tree reduction."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.piece[v] = k
        self.leaf_chars = max(2, leaf_chars)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.bpe.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        p = self._cut_before(text, lo, mid)
        q = self._cut_after(text, mid, hi)
        n_left, n_right = len(left), 0
        drop = len(text[p:mid].encode())
        while drop > 0:
            n_left -= 1
            drop -= len(self.piece[left[n_left]])
        skip = len(text[mid:q].encode())
        while skip > 0:
            skip -= len(self.piece[right[n_right]])
            n_right += 1
        if drop or skip:
            raise AssertionError("a token crosses a certified cut")
        return left[:n_left] + self.bpe.encode_ordinary(text[p:q]) + right[n_right:]

    @staticmethod
    def _cut_before(text: str, lo: int, mid: int) -> int:
        width = FIRST_WINDOW
        while True:
            start = max(lo, mid - width)
            last = None
            for last in _CUT.finditer(text, start + (start > lo), mid):
                pass
            if last is not None and last.start() > lo:
                return last.start()
            if start == lo:
                return lo
            width *= 2

    @staticmethod
    def _cut_after(text: str, mid: int, hi: int) -> int:
        # mid itself is a cut only for the joined text; the search starts one on.
        m = _CUT.search(text, mid + 1, hi)
        return m.start() if m else hi

    def decode(self, ids) -> str:
        """The text of ``ids``: byte strings are concatenated up a balanced tree."""

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= 1024:
                return b"".join([self.piece[i] for i in ids[lo:hi]])
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(ids)).decode("utf-8", errors="replace")


def encoder(tokenizer_dir: str = TOKENIZER_DIR, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder per Python worker."""
    key = f"{tokenizer_dir}:{leaf_chars}"
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(os.path.join(tokenizer_dir, TOKENIZER_FILE), leaf_chars)
    return _ENCODERS[key]


def encode_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    out: str = "ids",
    tokenizer_dir: str = TOKENIZER_DIR,
    leaf_chars: int = LEAF_CHARS,
    rows_per_batch: int = 512,
) -> DataFrame:
    """(key, out ARRAY<INT>), one row for each input row.

    Null and empty texts give an empty list; blank texts are encoded like any
    other. Repeated rows stay repeated. A null key is kept. Other columns are
    not read. The plan is scan -> map, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir, leaf_chars)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(at, rows_per_batch)
                flat, ends = array("i"), array("i", [0])
                for t in part.column(1):
                    flat.extend(enc.encode(t.as_py()))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "v"])

    cols = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return cols.mapInArrow(run, f"k {kind}, v array<int>").toDF(key, out)


def count_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    out: str = "n_tokens",
    tokenizer_dir: str = TOKENIZER_DIR,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """(key, out BIGINT): how many tokens each text has; 0 for null and empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir, leaf_chars)
        for batch in batches:
            n = array("q", [len(enc.encode(t.as_py())) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["k", "v"])

    cols = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return cols.mapInArrow(run, f"k {kind}, v bigint").toDF(key, out)


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", out: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(key, out STRING): the texts again; an empty list or null gives the empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir)
        for batch in batches:
            texts = [enc.decode(v.as_py() or []) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "v"])

    cols = encoded.select(F.col(key).alias("k"), F.col(ids).alias("t"))
    return cols.mapInArrow(run, f"k {kind}, v string").toDF(key, out)
