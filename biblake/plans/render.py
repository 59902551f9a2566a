"""From extracted Markdown and records to assembled papers with section indexes; and views of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import author_line, list_preview, preview, venue_year_line
from ..operators.sections import inject_markers, parse_sections, slice_md, strip_cover
from ..operators.state import content_hash

FRONT = ["title", "authors", "year", "publication_date", "venue", "category", "doi", "arxiv_id", "osti_id", "url"]


def front_matter(sha: Column) -> Column:
    """Known fields and the record's hash; JSON, which is YAML too."""
    return F.concat(F.lit("---\n"), F.to_json(F.struct(*FRONT, F.left(sha, F.lit(12)).alias("bib_yaml_sha"))), F.lit("\n---\n\n"))


def render(bib: DataFrame, raw_md: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``paper_id, md, fallback, degraded`` and the section index: cover stripped, pages marked, title, authors and venue on top."""
    joined = raw_md.select("paper_id", "md").join(bib.select("paper_id", *FRONT), "paper_id")
    stripped = joined.select("paper_id", strip_cover("md", "title").alias("md"))
    marked = inject_markers(stripped, blocks)
    head = bib.select("paper_id", front_matter(content_hash(F.to_json(F.struct(*FRONT)))).alias("front"), F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled"))).alias("top"), author_line("authors").alias("by"), venue_year_line("venue", "year").alias("at"))
    lines = [F.col("top"), F.when(F.col("by") != "", F.col("by")), F.when(F.col("at") != "", F.col("at")), F.col("md")]
    whole = marked.join(head, "paper_id").select("paper_id", F.concat(F.col("front"), F.concat_ws("\n\n", *lines)).alias("md"), "fallback", (F.size("fallback") >= 2).alias("degraded"))
    return whole, parse_sections(whole)


def view_md(md: DataFrame, head: int | None = None, tail: int | None = None) -> DataFrame:
    """``paper_id, content, chars, requested_chars, total_chars, truncated``."""
    content = slice_md("md", head, tail) if head is not None or tail is not None else F.col("md")
    out = md.select("paper_id", content.alias("content"), F.length("md").alias("total_chars"))
    asked = head if head is not None else tail
    return out.select("paper_id", "content", F.length("content").alias("chars"), F.lit(asked).cast("int").alias("requested_chars"), "total_chars", (F.length("content") < F.col("total_chars")).alias("truncated"))


def view_section(md: DataFrame, sections: DataFrame, short_name: str) -> DataFrame:
    """``paper_id, title, content``: the first section of a short name in each paper."""
    first = sections.where(F.col("short_name") == short_name).groupBy("paper_id").agg(F.min_by(F.struct("title", "start_offset", "end_offset"), "ord").alias("s"))
    return md.join(first, "paper_id").select("paper_id", "s.title", F.substring("md", F.col("s.start_offset") + 1, F.col("s.end_offset") - F.col("s.start_offset")).alias("content"))


def view_bib(bib: DataFrame) -> DataFrame:
    """``paper_id, title, authors, abstract, needs_review``: records cut to one line each."""
    return bib.select("paper_id", preview("title").alias("title"), list_preview("authors").alias("authors"), preview("abstract").alias("abstract"), "needs_review")


def view_info(bib: DataFrame, state: DataFrame, distillations: DataFrame) -> DataFrame:
    """``paper_id, title, stages, answers``: what there is of each paper."""
    stages = state.where("completed_at is not null").groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_set("stage")), ",").alias("stages"))
    answers = distillations.groupBy("paper_id").agg(F.count("*").alias("answers"))
    return bib.select("paper_id", "title").join(stages, "paper_id", "left").join(answers, "paper_id", "left").select("paper_id", "title", "stages", F.coalesce("answers", F.lit(0)).alias("answers"))
