"""What has been computed for which input, so that only the rest is computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["paper_id", "stage", "query"]


def current(wanted: DataFrame, state: DataFrame, match_on: list[str]) -> DataFrame:
    """Rows of ``wanted`` that are computed already: same paper, stage and query, completed, and equal (nulls too) in ``match_on``."""
    done = state.where("completed_at is not null").alias("s")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEY + match_on]
    return wanted.alias("w").join(done, _all(same), "left_semi")


def pending(wanted: DataFrame, state: DataFrame, match_on: list[str]) -> DataFrame:
    """Rows of ``wanted`` that must be computed."""
    done = state.where("completed_at is not null").alias("s")
    return wanted.alias("w").join(done, _all([F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEY + match_on]), "left_anti")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def mark_complete(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state with the rows of ``done`` in place of older ones of the same paper, stage and query."""
    return invalidate(state, done).unionByName(done, allowMissingColumns=True)


def invalidate(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The state without the rows of these papers, stages and queries."""
    k, s = keys.select(*KEY).dropDuplicates().alias("k"), state.alias("s")
    return s.join(k, _all([F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY]), "left_anti")


#: Stages of each target of a clean.
CLEANS = {"bib": ["bib"], "md": ["md"], "figures": ["figures"], "distill": ["distill"], "state": ["bib", "md", "figures", "distill"], "all": ["bib", "md", "figures", "distill"]}


def clean(state: DataFrame, papers: DataFrame, what: str) -> DataFrame:
    """The state without a target's stages of these papers."""
    if what not in CLEANS:
        raise ValueError(f"unknown target {what!r}")
    gone = papers.select("paper_id").dropDuplicates().withColumn("stage", F.explode(F.array(*map(F.lit, CLEANS[what]))))
    return state.join(gone, ["paper_id", "stage"], "left_anti").select(*state.columns)


def bib_gate(papers: DataFrame, bib: DataFrame) -> DataFrame:
    """``paper_id, status, exit_code``: whether a paper's record exists and is reviewed."""
    known = bib.select("paper_id", F.coalesce("needs_review", F.lit(False)).alias("review"), F.lit(True).alias("has"))
    out = papers.select("paper_id").join(known, "paper_id", "left")
    status = F.when(F.col("has").isNull(), "BibMissing").when(F.col("review"), "ReviewNeeded").otherwise("ok")
    return out.select("paper_id", status.alias("status"), F.when(status == "ok", 0).otherwise(3).alias("exit_code"))


def raise_for_status(df: DataFrame, status: str = "status") -> DataFrame:
    """The same rows, or an error that names one row that isn't ok."""
    bad = df.where(F.col(status) != "ok").limit(1).collect()
    if bad:
        raise RuntimeError(f"{bad[0][status]}: {bad[0].asDict()}")
    return df


def content_hash(c: Column | str, width: int | None = None) -> Column:
    sha = F.sha2(F.col(c) if isinstance(c, str) else c, 256)
    return sha if width is None else F.left(sha, F.lit(width))
