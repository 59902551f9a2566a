"""Files in and out: PDFs, layout JSON, BibTeX, Markdown, JSON documents."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import bibtex_authors, bibtex_date, extract_doi, null_if_empty
from ..functions.text import is_blank, strip
from ..operators.state import content_hash

BLOCK = (
    "type string, text string, text_level int, page_idx int, bbox array<double>, img_path string, image_caption array<string>, image_footnote array<string>, "
    "chart_caption array<string>, chart_footnote array<string>, table_caption array<string>, table_footnote array<string>"
)


def read_papers(spark: SparkSession, folder: str) -> DataFrame:
    """``paper_id, path, stem, content, length``: PDF files below a folder; the id is the hash of the content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.pdf$", "")
    return files.select(content_hash("content").alias("paper_id"), "path", stem.alias("stem"), "content", "length")


def first_pages(pages: DataFrame, most: int = 3) -> DataFrame:
    """``paper_id, text``: text of the first pages of each paper, blank pages left out."""
    kept = pages.where((F.col("page_idx") < most) & ~is_blank("text"))
    return kept.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda p: p["text"]), "\n\n").alias("text"))


def extract(papers: DataFrame, extractor: Callable[[], Callable[[bytes], tuple[str, str]]]) -> DataFrame:
    """``paper_id, md, blocks_json, error``: what an extractor makes of each PDF; one is made per task, a failure is one row's."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = extractor()
        for part in parts:
            rows = []
            for paper, content in zip(part["paper_id"], part["content"]):
                try:
                    rows.append((paper, *one(content), None))
                except Exception as e:  # what an extractor raises is not known here
                    rows.append((paper, None, None, str(e)[-2000:]))
            yield pd.DataFrame(rows, columns=["paper_id", "md", "blocks_json", "error"])

    return papers.select("paper_id", "content").mapInPandas(run, "paper_id string, md string, blocks_json string, error string")


def blocks_of(raw: DataFrame, column: str = "blocks_json") -> DataFrame:
    """``paper_id, ord`` and the fields of each layout block of a JSON list; the order of the list is kept."""
    return raw.select("paper_id", F.posexplode(F.from_json(column, f"array<struct<{re.sub(r'(\\w+) (string|int|array<double>|array<string>)', r'\\1: \\2', BLOCK)}>>")).alias("ord", "b")).select("paper_id", "ord", "b.*")


def parse_bibtex(text: str) -> list[dict[str, str]]:
    """Entries of a BibTeX text: ``ENTRYTYPE``, ``ID`` and lower-case fields. Braces and quotes nest; strings joined by ``#`` are concatenated."""
    entries, strings, at = [], {}, 0
    while (m := re.compile(r"@\s*(\w+)\s*[{(]").search(text, at)) is not None:
        kind, depth, end, quoted = m[1].lower(), 1, m.end(), False
        while end < len(text) and depth:
            c = text[end]
            if c == '"' and depth == 1 and text[end - 1] != "\\":
                quoted = not quoted
            elif c in "{(" and (c == "{" or not quoted and text[m.end() - 1] == "("):
                depth += 1
            elif c in "})" and (c == "}" or not quoted and text[m.end() - 1] == "("):
                depth -= 1
            end += 1
        body, at = text[m.end() : end - 1], end
        if kind in ("comment", "preamble"):
            continue
        key, _, rest = body.partition(",") if kind != "string" else ("", "", body)
        fields = {}
        for name, value in _fields(rest, strings):
            fields[name] = value
        if kind == "string":
            strings |= fields
        else:
            entries.append({"ENTRYTYPE": kind, "ID": key.strip()} | fields)
    return entries


def _fields(text: str, strings: dict[str, str]) -> Iterator[tuple[str, str]]:
    at = 0
    while (m := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at)) is not None:
        at, parts = m.end(), []
        while at < len(text):
            if text[at] in '{"':
                close, depth, begin = ("}" if text[at] == "{" else '"'), 0, at + 1
                at += 1
                while at < len(text) and (text[at] != close or depth):
                    depth += {"{": 1, "}": -1}.get(text[at], 0)
                    at += 1
                parts.append(text[begin:at])
                at += 1
            else:
                word = re.compile(r"[^\s,#]*").match(text, at)
                parts.append(strings.get(word[0].lower(), word[0]))
                at = word.end()
            glue = re.compile(r"\s*#\s*").match(text, at)
            if not glue:
                break
            at = glue.end()
        yield m[1].lower(), re.sub(r"\s+", " ", "".join(parts)).strip()
        at = re.compile(r"\s*").match(text, at).end()


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of the BibTeX files at ``path``; a path without an entry is an error."""
    texts = spark.read.option("wholetext", "true").text(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"entry": [json.dumps(e) for t in part["value"] for e in parse_bibtex(t)]}, dtype=object)

    entries = bibtex_records(texts.mapInPandas(run, "entry string").select(F.from_json("entry", "map<string, string>").alias("entry")))
    if entries.isEmpty():
        raise ValueError(f"no BibTeX entry in {path}")
    return entries


def bibtex_records(entries: DataFrame) -> DataFrame:
    """``bibtex_key, title, authors, year, publication_date, venue, doi, raw_type`` of entries (maps of fields)."""
    get = lambda k: null_if_empty(strip(F.try_element_at("entry", F.lit(k))))
    doi = F.coalesce(extract_doi(F.concat(F.lit("doi:"), get("doi"))), extract_doi(get("url")))
    date = bibtex_date(F.concat_ws(" ", get("year"), get("month")))
    return entries.select(
        get("ID").alias("bibtex_key"), F.regexp_replace(get("title"), r"^[{}]+|[{}]+$", "").alias("title"), bibtex_authors(get("author")).alias("authors"), F.left(date, F.lit(4)).cast("int").alias("year"), date.alias("publication_date"),
        F.coalesce(*(get(k) for k in ("booktitle", "journal", "publisher", "series"))).alias("venue"), doi.alias("doi"), get("ENTRYTYPE").alias("raw_type"),
    )


def document(*columns: str) -> Column:
    """A row's columns as one JSON text, nulls left out."""
    return F.to_json(F.struct(*columns))


def write_documents(df: DataFrame, path: str, key: str = "paper_id") -> None:
    """Rows as JSON lines; Spark's commit makes the folder complete or absent."""
    df.repartition(key).sortWithinPartitions(key).write.mode("overwrite").json(path)
