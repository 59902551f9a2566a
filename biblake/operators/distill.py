"""Questions put to a language model on every paper: plans, inputs, runs, answers."""

from __future__ import annotations

import re
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bib_header, is_blank, narrative, post_process, prompt, strip, tokens_estimate, without_markers
from ..session import materialize
from .state import content_hash

SCOPES = ("abstract", "narrative", "full", "section")
#: The most that is sent, and the question that is always there.
MOST_TOKENS = 100_000
SUMMARY = "Summarize this paper in 3 sentences:\n(1) the problem or question addressed,\n(2) the approach or method used,\n(3) the key result or contribution.\nBe specific; avoid generic claims."


@dataclass(frozen=True)
class Question:
    """A question of its user: name, scope, prompt and, where wanted, length limit, model and section."""

    name: str
    scope: str
    prompt: str
    max_chars: int | None = None
    model: str | None = None
    section: str | None = None
    source: str = "config"


DEFAULT_QUESTIONS = [Question("summary", "abstract", SUMMARY, 600)]


def check_questions(questions: list[Question]) -> list[str]:
    """What is wrong with question definitions; nothing if all are right."""
    out, names = [], [q.name for q in questions]
    for q in questions:
        if not re.fullmatch(r"[a-z0-9_-]+", q.name or ""):
            out.append(f"{q.name!r}: no valid name")
        if q.scope not in SCOPES:
            out.append(f"{q.name}: unknown scope {q.scope!r}")
        if not (q.prompt or "").strip():
            out.append(f"{q.name}: empty prompt")
        if q.max_chars is not None and (not isinstance(q.max_chars, int) or q.max_chars <= 0):
            out.append(f"{q.name}: max_chars must be positive")
        if q.scope == "section" and not re.fullmatch(r"[a-z0-9_]+", q.section or ""):
            out.append(f"{q.name}: scope section needs a section's short name")
    return out + [f"{n}: defined {names.count(n)} times" for n in sorted({n for n in names if names.count(n) > 1})]


def question_table(spark: SparkSession, questions: list[Question]) -> DataFrame:
    """Definitions as a table: as many rows as a user writes by hand; of equal names the last counts."""
    rows = [(i, q.name, q.scope, q.prompt, q.max_chars, q.model, q.section, q.source) for i, q in enumerate(questions)]
    df = spark.createDataFrame(rows, "seq int, name string, scope string, prompt string, max_chars int, model string, section string, source string")
    return df.groupBy("name").agg(F.max_by(F.struct("scope", "prompt", "max_chars", "model", "section", "source"), "seq").alias("q")).select("name", "q.*")


def select_questions(questions: list[Question], only: list[str] | None) -> list[Question]:
    unknown = sorted(set(only or ()) - {q.name for q in questions})
    if unknown:
        raise ValueError(f"unknown questions: {', '.join(unknown)}")
    return [q for q in questions if not only or q.name in only]


def plan(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """Every paper with every question. The questions are a list its user wrote, not data: they go along with each row."""
    asked = questions.agg(F.collect_list(F.struct(*questions.columns)).alias("asked"))
    return papers.crossJoin(F.broadcast(asked)).select(*papers.columns, F.explode("asked").alias("q")).select(*papers.columns, "q.*")


def inputs(bib: DataFrame, md: DataFrame, sections: DataFrame, questions: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """``paper_id, name, scope, content, tokens, status, error, input_sha, prompt_sha``: what is sent for each paper and question.

    status: ``ready``, ``missing-section`` (the error lists the paper's sections) or ``error`` (no abstract, no text,
    too long). Papers meet texts and sections once each, by paper.
    """
    index = sections.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", "short_name", "title", "start_offset", "end_offset"))).alias("index"))
    all_ = bib.select("paper_id", "title", "authors", "venue", "year", "abstract").join(md.select("paper_id", "md"), "paper_id", "left").join(index, "paper_id", "left")
    asked = plan(all_.withColumnRenamed("title", "bib_title"), questions)
    hit = F.get(F.filter("index", lambda s: s["short_name"] == F.col("section")), F.lit(0))
    asked = asked.withColumn("hit", hit)
    part = F.concat(F.lit("Section: "), F.coalesce("hit.title", "section"), F.lit("\n\n"), without_markers(F.substring("md", F.col("hit.start_offset") + 1, F.col("hit.end_offset") - F.col("hit.start_offset"))))
    body = F.when(F.col("scope") == "narrative", narrative("md")).when(F.col("scope") == "full", F.col("md")).when(F.col("scope") == "section", part)
    head = bib_header("bib_title", "authors", "venue", "year")
    content = F.when(F.col("scope") == "abstract", F.concat(head, F.lit("\n\nAbstract:\n"), strip("abstract"))).otherwise(F.concat(head, F.lit("\n\n---\n\n"), body))
    names = F.array_join(F.sort_array(F.transform(F.filter("index", lambda s: s["short_name"].isNotNull()), lambda s: s["short_name"])), ", ")
    error = (
        F.when((F.col("scope") == "abstract") & is_blank("abstract"), "no abstract").when((F.col("scope") != "abstract") & F.col("md").isNull(), "no text")
        .when((F.col("scope") == "section") & F.col("hit").isNull(), F.concat(F.lit("no such section; there are: "), F.coalesce(names, F.lit("")))).when(tokens_estimate(content) > most_tokens, "too long")
    )
    status = F.when(error.isNull(), "ready").when(F.startswith(error, F.lit("no such section")), "missing-section").otherwise("error")
    return asked.select(
        "paper_id", "name", "scope", "prompt", "max_chars", "model", F.when(error.isNull(), content).alias("content"), tokens_estimate(content).alias("tokens"), status.alias("status"), error.alias("error"),
        F.when(error.isNull(), content_hash(content, 16)).alias("input_sha"), content_hash("prompt", 16).alias("prompt_sha"),
    )


def unfenced(text: str) -> str:
    """An answer without the code fence around it."""
    return re.sub(r"^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$", "", text).strip()


def current(ready: DataFrame, done: DataFrame, model: str, override: str | None = None) -> DataFrame:
    """``paper_id, name``: questions already answered from the same input, prompt and model, with an answer that is there.

    done: ``paper_id, name, model, input_sha, prompt_sha, output``.
    """
    meant = F.lit(override) if override else F.coalesce("model", F.lit(model))
    asked = ready.where("status = 'ready'").select("paper_id", "name", meant.alias("model"), "input_sha", "prompt_sha")
    return asked.join(done.where("output is not null"), ["paper_id", "name", "model", "input_sha", "prompt_sha"], "left_semi").select("paper_id", "name")


def distill(ready: DataFrame, client: Callable[[], Callable[[str, str], str]], model: str, done: DataFrame | None = None, force: bool = False, override: str | None = None, **more) -> DataFrame:
    """As ``run``, but what is current in ``done`` isn't asked again (unless ``force``) and has the status ``cached``; questions that can't be asked keep theirs.

    override: the model of all questions, whatever they name. Of ``done`` a paper's question has at most one row.
    """
    if override:
        ready = ready.withColumn("model", F.lit(override))
    held = current(ready, done, model) if done is not None and not force else ready.select("paper_id", "name").limit(0)
    asked = run(ready.join(held, ["paper_id", "name"], "left_anti"), client, model, **more)
    null = lambda kind: F.lit(None).cast(kind)
    rest = ready.where("status <> 'ready'").select("paper_id", "name", "model", null("string").alias("output"), null("boolean").alias("truncated"), null("int").alias("original_length"), "status", "error")
    out = asked.unionByName(rest)
    if done is None or force:
        return out
    kept = held.join(done.select("paper_id", "name", "model", "output"), ["paper_id", "name"])
    return out.unionByName(kept.select("paper_id", "name", "model", "output", null("boolean").alias("truncated"), null("int").alias("original_length"), F.lit("cached").alias("status"), null("string").alias("error")))


def run(ready: DataFrame, client: Callable[[], Callable[[str, str], str]], model: str, tries: int = 3, wait: float = 0.0, as_json: bool = False) -> DataFrame:
    """``paper_id, name, model, output, truncated, original_length, status, error``: answers, one call per row.

    wait: seconds before the second try, twice as many before each further one. as_json: an answer's code fence is cut
    off, and one that is no JSON counts as a failure of that try.

    client: makes, once per task, a function of model and prompt. A row's failure is its own. Answers are written
    before anything reads them, so no plan asks twice.
    """

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = client()
        for part in parts:
            out, errors = [], []
            for m, p in zip(part["model"], part["full_prompt"]):
                for left in range(tries - 1, -1, -1):
                    try:
                        text, problem = answer(m, p), None
                        if as_json:
                            text = unfenced(text)
                            json.loads(text)
                        break
                    except Exception as e:  # what a client raises is not known here
                        text, problem = None, str(e)
                        if not left:
                            break
                        time.sleep(wait * 2 ** (tries - 1 - left))
                out.append(text), errors.append(problem)
            yield part[["paper_id", "name", "model"]].assign(raw=out, error=errors, max_chars=part["max_chars"])

    asked = ready.where("status = 'ready'").select("paper_id", "name", F.coalesce("model", F.lit(model)).alias("model"), prompt("prompt", "content", "max_chars").alias("full_prompt"), "max_chars")
    got = materialize(asked.mapInPandas(ask, "paper_id string, name string, model string, raw string, error string, max_chars double"))
    done = post_process(F.coalesce("raw", F.lit("")), F.coalesce(F.col("max_chars").cast("int"), F.lit(0)))
    return got.withColumn("p", done).select("paper_id", "name", "model", F.when(F.col("error").isNull(), F.col("p.text")).alias("output"), "p.truncated", "p.original_length", F.when(F.col("error").isNull(), "distilled").otherwise("error").alias("status"), "error")
