"""New papers as they arrive: each micro-batch does only what isn't done yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import mark_complete, pending

STATE = "paper_id string, stage string, query string, completed_at string, input_sha string, version string"


def stream_table(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Files that arrive in a folder, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("recursiveFileLookup", "true").parquet(folder)


def keep_current(arriving: DataFrame, stage: str, version: str, read_state: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], compute: Callable[[DataFrame], DataFrame], checkpoint: str, at: str) -> StreamingQuery:
    """Run ``compute`` on papers whose content (``paper_id, input_sha``) is new to the state.

    write: gets results and the new state; being called again for a batch after a failure must do no harm, since the
    state decides what is pending. Available files are worked off, then the query ends.
    """

    def batch(df: DataFrame, _: int) -> None:
        wanted = df.dropDuplicates(["paper_id"]).withColumns({"stage": F.lit(stage), "query": F.lit(None).cast("string"), "version": F.lit(version)})
        state = read_state()
        new = pending(wanted, state, ["input_sha", "version"])
        done = new.select("paper_id", "stage", "query", F.lit(at).alias("completed_at"), "input_sha", "version")
        write(compute(new), mark_complete(state, done))

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(arriving: DataFrame, time: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """``start, n``: papers by time of arrival; rows later than ``late`` are dropped."""
    return arriving.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
