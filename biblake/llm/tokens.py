"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: a contiguous rank array. A pre-token of ``n`` bytes starts as ``n`` parts; ``bounds`` holds where parts begin
and ``ranks[i]`` the rank of the merge of parts ``i`` and ``i + 1``. The smallest rank is found by a scan, its inner
boundary deleted, and only the two neighbouring ranks are looked up again. Pre-tokens longer than ``SHORT`` bytes use
the same merges in the same order from a heap, so that a text without white space costs n log n instead of n squared.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import spread, table

#: Where the vocabulary files are by default; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 96
#: Pre-tokens remembered by a worker; the memory is emptied when it is full, which changes no result.
REMEMBERED = 200_000
NONE = 1 << 60


class Encoder:
    """Encodes texts by the ranks of a vocabulary file (lines of base64 bytes and rank)."""

    def __init__(self, vocabulary: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        return self._scan(piece) if len(piece) <= SHORT else self._heap(piece)

    def _scan(self, piece: bytes) -> tuple[int, ...]:
        of = self.rank.get
        bounds = list(range(len(piece) + 1))
        ranks = [of(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            del bounds[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = of(piece[bounds[at] : bounds[at + 2]], NONE)
            if at:
                ranks[at - 1] = of(piece[bounds[at - 1] : bounds[at + 1]], NONE)
        return tuple(self.rank[piece[a:b]] for a, b in zip(bounds, bounds[1:]))

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        of, n = self.rank.get, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # the start of the next part, of the one before
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := of(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := of(piece[i : after[j]])) is not None:
                heapq.heappush(heap, (r, i, j, after[j]))

        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or not alive[j] or after[j] != end:
                continue
            alive[j], after[i] = 0, end
            if end < n:
                before[end] = i
            offer(i)
            if i:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def parts(self, text: str | None) -> list[tuple[int, ...]]:
        """Token ids by pre-token; none for a null or empty text."""
        if not text:
            return []
        known, out = self.known, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.word(piece.encode())
                if len(piece) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text)))


@lru_cache(maxsize=4)
def encoder_of(vocabulary: bytes) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(vocabulary)


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    """The file's content, read by the driver and sent to the tasks: its size is that of the vocabulary (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """``key`` and the token ids (array of int) of ``text``, without special tokens; other columns are dropped.

    Null and empty texts give an empty array; blank and very long texts are encoded whole; repeated rows give repeated
    rows; an empty table gives an empty table. Strings that look like special tokens are ordinary text.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            offsets, flat = [0], []
            for value in batch.column(1).to_pylist():
                for ids in encoder.parts(value):
                    flat += ids
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, out])

    rows = df.select(key, text)
    schema = T.StructType([rows.schema[key], T.StructField(out, T.ArrayType(T.IntegerType(), True))])
    return spread(rows, [key]).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode(table(spark, root, "documents"), "doc_id", "text")


def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    """Documents, empty ones and tokens by source."""
    from pyspark.sql import functions as F

    documents = table(spark, root, "documents")
    sizes = encode(documents, "doc_id", "text").select("doc_id", F.size("ids").alias("n"))
    return (
        documents.select("doc_id", "source").join(sizes, "doc_id")
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("tokens"))
    )
