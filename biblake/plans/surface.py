"""What users ask of stored results: listings, lookups by name, patches as they are typed, envelopes and exit codes."""

from __future__ import annotations

import json
import time
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.distill import Question
from ..operators.merge import PRIORITY

#: Fields whose origin is recorded even where no source had them.
TRACKED = ["title", "authors", "year", "publication_date", "venue", "category", "doi", "arxiv_id", "osti_id", "url", "abstract"]


def backfill_short_names(sections: DataFrame) -> DataFrame:
    """The index with a short name for every section; names that stand before a section count for its number."""
    key = F.coalesce(F.when(F.col("short_name") != "", F.col("short_name")), slug("title"))
    nth = F.row_number().over(Window.partitionBy("paper_id", "_key").orderBy("ord"))
    named = F.when(F.col("short_name") != "", F.col("short_name")).when(F.col("_nth") == 1, F.col("_key")).otherwise(F.concat("_key", F.lit("_"), F.col("_nth").cast("string")))
    return sections.withColumn("_key", key).withColumn("_nth", nth).withColumn("short_name", named).drop("_key", "_nth")


def list_questions(papers: DataFrame, questions: DataFrame, answers: DataFrame, sections: DataFrame, model: str) -> DataFrame:
    """``paper_id, name, scope, section, model, status``: cached, missing-section or never-run.

    answers: ``paper_id, name``; sections: ``paper_id, short_name``. A section is missing only where a paper has any.
    """
    known = sections.where("short_name <> ''").groupBy("paper_id").agg(F.collect_set("short_name").alias("names"))
    asked = papers.select("paper_id").join(known, "paper_id", "left").crossJoin(F.broadcast(questions))  # questions: a list its user wrote
    done = answers.select("paper_id", "name").dropDuplicates().withColumn("cached", F.lit(True))
    missing = (F.col("scope") == "section") & (F.size("names") > 0) & ~F.array_contains("names", F.col("section"))
    status = F.when(F.col("cached"), "cached").when(F.coalesce(missing, F.lit(False)), "missing-section").otherwise("never-run")
    return asked.join(done, ["paper_id", "name"], "left").select("paper_id", "name", "scope", "section", F.coalesce("model", F.lit(model)).alias("model"), status.alias("status"))


def list_answers(answers: DataFrame) -> DataFrame:
    """``paper_id, name, model, chars``: stored answers by name."""
    return answers.where("output is not null").select("paper_id", "name", "model", F.length("output").alias("chars")).orderBy("paper_id", "name")


def figure_by_id(figures: DataFrame, paper_id: str, id: str) -> DataFrame:
    """One figure; if there is none, an error names the paper's figures."""
    found = figures.where((F.col("paper_id") == paper_id) & (F.col("id") == id))
    if found.isEmpty():
        ids = figures.where(F.col("paper_id") == paper_id).agg(F.array_join(F.sort_array(F.collect_set("id")), ", ")).first()[0]
        raise LookupError(f"no figure {id!r}; there are: {ids}")
    return found


def parse_assignments(items: list[str]) -> dict[str, Any]:
    """``field=value`` pairs; values are JSON where they can be read as such, else strings."""
    out: dict[str, Any] = {}
    for item in items:
        field, sign, value = item.partition("=")
        if not sign:
            raise ValueError(f"field=value expected, not {item!r}")
        try:
            out[field.strip()] = json.loads(value)
        except ValueError:
            out[field.strip()] = value
    return out


def read_patch(path: str) -> dict[str, Any]:
    patch = json.loads(Path(path).read_text())
    if not isinstance(patch, dict):
        raise ValueError("a patch is a JSON object")
    return patch


def patch_rows(spark: SparkSession, paper_id: str, patch: dict[str, Any]) -> DataFrame:
    """One person's patch as rows for ``apply_patches``."""
    rows = [(paper_id, f, json.dumps(v, ensure_ascii=False), i) for i, (f, v) in enumerate(patch.items())]
    return spark.createDataFrame(rows, "paper_id string, field string, value string, seq int")


def load_questions(folder: str, settings: list[Question]) -> list[Question]:
    """Questions of the settings and of the folder's JSON files in order of name; later definitions win when tabled."""
    out = list(settings)
    for f in sorted(Path(folder).glob("*.json")) if Path(folder).is_dir() else []:
        for name, q in json.loads(f.read_text()).items():
            if isinstance(q, dict):
                out.append(Question(name=name, source=f.name, **{k: q.get(k) for k in ("scope", "prompt", "max_chars", "model", "section")}))
    return out


def fill_unknown(merged: DataFrame) -> DataFrame:
    """Merged fields and, for each tracked field a paper lacks, a row of source ``unknown`` without a value."""
    wanted = merged.select("paper_id").dropDuplicates().select("paper_id", F.explode(F.array(*map(F.lit, TRACKED))).alias("field"))
    gaps = wanted.join(merged.select("paper_id", "field"), ["paper_id", "field"], "left_anti").select("paper_id", "field", F.lit("unknown").alias("source"))
    return merged.unionByName(gaps, allowMissingColumns=True)


def envelope(command: str, ok: Column, *columns: str) -> Column:
    """A result row as JSON."""
    return F.to_json(F.struct(ok.alias("ok"), F.lit(command).alias("command"), *columns))


def exit_code(statuses: DataFrame) -> int:
    """0 if all is well, 3 if a record is missing or needs review, else 1."""
    kinds = {r[0] for r in statuses.select("status").dropDuplicates().collect()}
    return 3 if kinds & {"BibMissing", "ReviewNeeded"} else 1 if kinds - {"ok", "distilled", "cached", "ready"} else 0


class Pacer:
    """Keeps a task's calls to a source at least so many seconds apart; give each source one task."""

    def __init__(self, seconds: dict[str, float]):
        self.seconds, self.last = seconds, {}

    def wait(self, source: str) -> None:
        due = self.last.get(source, -1e9) + self.seconds.get(source, 0)
        time.sleep(max(0, due - time.monotonic()))
        self.last[source] = time.monotonic()


RANKED = sorted(PRIORITY, key=PRIORITY.get, reverse=True)
