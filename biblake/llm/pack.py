"""Filling containers of fixed capacity.

Method: bounded-space online packing. Each task keeps at most ``windows`` open containers; an item goes where the
least room would be left, and when it fits nowhere the fullest one is emitted. What is open at the end of the tasks is
merged: leftover containers become items of a second, third, ... round over ever fewer tasks, until one task holds the
rest, which is at most ``windows`` containers of each of ``FAN`` tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, spread, table
from .tokens import VOCABULARY, encoder_of, vocabulary_bytes

CAPACITY, WINDOWS, FAN = 2048, 64, 16


class Windows:
    """The open containers of one task, ordered by the room that is left."""

    def __init__(self, capacity: int, windows: int, first: int):
        self.capacity, self.windows, self.next = capacity, windows, first
        self.open: list[tuple[int, int]] = []  # (room, id)

    def place(self, size: int) -> tuple[int, int]:
        """The container of an item of ``size`` <= capacity, and what it held before."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, which = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                self.open.pop(0)  # the fullest is emitted
            room, which = self.capacity, self.next
            self.next += 1
        if room - size > 0:
            insort(self.open, (room - size, which))
        return which, self.capacity - room


def first_id() -> int:
    return TaskContext.get().partitionId() << 32


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, windows: int = WINDOWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, piece, start_token, n_tokens, container_id``: where each text goes, sizes in tokens.

    A text longer than ``capacity`` is cut into pieces of ``capacity`` tokens, each a container of its own, and a rest
    that is packed as an item; no other text is cut. Null and empty texts have no tokens: they take no room and go to
    a container that is open anyway. Repeated rows are packed as often as they stand; an empty table gives no rows.
    The containers depend on how rows are partitioned; their sizes and the pieces don't.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, w = encoder_of(shared.value), Windows(capacity, windows, first_id())
        last = None
        for batch in batches:
            last = batch.schema
            keys, piece, start, size, at = [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                n, k, done = encoder.count(value), 0, 0
                while True:
                    part = min(capacity, n - done)
                    which, _ = w.place(part)
                    keys.append(row), piece.append(k), start.append(done), size.append(part), at.append(which)
                    done, k = done + part, k + 1
                    if done >= n:
                        break
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(at, pa.int64()), pa.nulls(len(keys), pa.int32())],
                names=["key", "piece", "start_token", "n_tokens", "bin", "fill"],
            )
        if last is not None and w.open:
            n = len(w.open)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, last.field(0).type), *(pa.nulls(n, pa.int32()) for _ in range(3)), pa.array([b for _, b in w.open], pa.int64()), pa.array([capacity - r for r, _ in w.open], pa.int32())],
                names=["key", "piece", "start_token", "n_tokens", "bin", "fill"],
            )

    placed = materialize(spread(rows, ["key"]).mapInArrow(run, f"key {kind}, piece int, start_token int, n_tokens int, bin bigint, fill int"))
    merged = merge_leftovers(placed.where("fill is not null").select("bin", "fill"), capacity, windows)
    pieces = placed.where("fill is null").select("key", "piece", "start_token", "n_tokens", "bin")
    # every container's first id is kept; those merged take the id of the one they were merged into
    return pieces.join(merged, "bin", "left").select(F.col("key").alias(key), "piece", "start_token", "n_tokens", F.coalesce("into", "bin").alias("container_id"))


def merge_leftovers(bins: DataFrame, capacity: int, windows: int) -> DataFrame:
    """``bin, into``: containers that were open at the end of a task and what they are merged into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted(((f, b) for batch in batches for b, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), reverse=True)
        # at most `windows` of each of the FAN tasks before: bounded, so it may be ordered
        w, names, fills, held = Windows(capacity, windows, 0), {}, {}, []
        for fill, b in items:
            which, before = w.place(fill)
            held.append((b, names.setdefault(which, b)))
            fills[names[which]] = before + fill
        still = {names[which] for _, which in w.open}
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in held], pa.int64()), pa.array([i for _, i in held], pa.int64()), pa.array([fills[i] for _, i in held], pa.int32()), pa.array([i in still for _, i in held], pa.bool_())],
            names=["bin", "into", "fill", "open"],
        )

    task = F.shiftrightunsigned("bin", 32)
    tasks = (bins.agg(F.max(task)).first()[0] or 0) + 1
    group, known = 1, None
    rounds = max(1, math.ceil(math.log(tasks, FAN)))
    for last in [False] * (rounds - 1) + [True]:
        group *= FAN
        n = max(1, math.ceil(tasks / group))
        step = materialize(bins.repartition(n, F.floor(task / group)).mapInArrow(run, "bin bigint, into bigint, fill int, open boolean"))
        if known is None:
            known = step.select("bin", "into")
        else:
            known = known.join(step.select(F.col("bin").alias("into"), F.col("into").alias("later")), "into", "left").select("bin", F.coalesce("later", "into").alias("into"))
        bins = step.where("open and bin = into").select("bin", "fill")
    return known


def p7_pack(spark: SparkSession, root: str) -> DataFrame:
    """The container of 2,048 tokens of every document or piece of one."""
    return pack(table(spark, root, "documents"), "doc_id", "text")


def p7_room(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and the share of room used."""
    filled = p7_pack(spark, root).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return filled.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (CAPACITY * F.count("*")), 4).alias("used"))
