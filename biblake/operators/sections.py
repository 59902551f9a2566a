"""Markdown of papers: section index, cover pages, page markers, slices."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, lines, normal_title, slug, strip, title_words

HEADING = r"^#{1,6} .+$"
MARKER = r"<!--\s*page\s+\d+\s*-->"


def placed_lines(each: Column, pattern: str) -> Column:
    """Lines that match, as (line, start): ``start`` is the offset in characters. One pass; a line that doesn't match costs its length."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line: string, start: int>>").alias("kept"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.when(x.rlike(pattern), F.concat(acc["kept"], F.array(F.struct(x.alias("line"), acc["at"].alias("start"))))).otherwise(acc["kept"]).alias("kept"))
    return F.aggregate(each, begin, step, lambda acc: acc["kept"])


def headings(md: DataFrame, text: str = "md") -> DataFrame:
    """``paper_id, start, level, title, length``: heading lines with their offsets in characters.

    Offsets are counted along the lines inside the row: no window, no shuffle, and only headings are kept on the way.
    """
    out = md.select("paper_id", F.length(text).alias("length"), F.explode(placed_lines(lines(text), HEADING)).alias("h"))
    level = F.length(F.regexp_extract("h.line", r"^(#+)", 1))
    return out.select("paper_id", F.col("h.start").alias("start"), level.alias("level"), strip(F.regexp_replace("h.line", r"^#+ ", "")).alias("title"), "length")


def parse_sections(md: DataFrame, text: str = "md", include_subsections: bool = False) -> DataFrame:
    """``paper_id, ord, short_name, title, level, start_offset, end_offset`` of all headings.

    A section ends at the next heading of any level (or, with subsections, of the same or a higher one), the last at
    the end of the text. Equal short names are numbered from the second on. One shuffle by paper for all windows.
    """
    by = Window.partitionBy("paper_id").orderBy("start")
    named = headings(md, text).withColumn("base", slug("title"))
    nth = F.row_number().over(Window.partitionBy("paper_id", "base").orderBy("start"))
    # from the end backwards, the nearest heading of each level so far
    behind = Window.partitionBy("paper_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.min(F.when(F.col("level") <= k, F.col("start"))).over(behind) for k in range(1, 7)]
    after = F.lead("start").over(by) if not include_subsections else F.get(F.array(*nearest), F.col("level") - 1)
    return named.select(
        "paper_id", (F.row_number().over(by) - 1).alias("ord"), F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), nth.cast("string"))).alias("short_name"),
        "title", "level", F.col("start").alias("start_offset"), F.coalesce(after, F.col("length")).alias("end_offset"),
    )


def _line_end(text: Column, start: Column) -> Column:
    """Place of the line break behind an offset, from 1; 0 if there is none."""
    return F.call_function("locate", F.lit("\n"), text, start + 1)


def strip_cover(md: Column | str, title: Column | str, within: int = 6000, most: int = 20) -> Column:
    """Text behind the first of the leading top headings that begins with the title's first eight words; else unchanged."""
    md = col(md)
    # a heading that begins within the limit may end behind it: what tells it apart stands in its first words
    tops = F.slice(F.filter(placed_lines(lines(F.left(md, F.lit(within + 2000))), "^# .+$"), lambda x: x["start"] < within), 1, most)
    words = title_words(F.coalesce(col(title), F.lit("")), 8)
    fits = F.filter(tops, lambda x: normal_title(F.substring(x["line"], F.lit(3), F.length(x["line"]))).startswith(F.array_join(words, " ")))
    at = F.get(fits, F.lit(0))
    return F.when((F.size(words) >= 2) & at.isNotNull(), F.when(_line_end(md, at["start"]) > 0, F.substring(md, _line_end(md, at["start"]) + 1, F.length(md))).otherwise("")).otherwise(md)


def slice_md(md: Column | str, head: int | None = None, tail: int | None = None) -> Column:
    """The first or last characters, never cutting a page marker: a marker at the cut is left out whole."""
    if (head is None) == (tail is None):
        raise ValueError("give head or tail")
    md = col(md)
    n = F.length(md)
    cut = F.least(F.lit(head), n) if head is not None else F.greatest(n - tail, F.lit(0))
    # a marker is within 30 characters of the cut
    first = F.greatest(cut - 30, F.lit(0))
    near = F.substring(md, first + 1, F.least(cut + 30, n) - first)
    marks = F.regexp_extract_all(near, F.lit(f"({MARKER})"), F.lit(1))
    # offsets of the markers in the window, from the text between them
    parts = F.split(near, MARKER, -1)
    begins = F.transform(marks, lambda m, i: first + F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(marks, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)))
    over = F.get(F.filter(F.arrays_zip(marks.alias("m"), begins.alias("b")), lambda x: (x["b"] < cut) & (cut < x["b"] + F.length(x["m"]))), F.lit(0))
    if head is not None:
        return F.left(md, F.coalesce(over["b"], cut))
    return F.substring(md, F.coalesce(over["b"] + F.length(over["m"]), cut) + 1, n)


def page_markers(md: DataFrame, text: str = "md") -> DataFrame:
    """``paper_id, page, nth``: the page markers of a text in order."""
    pages = F.regexp_extract_all(text, F.lit(r"<!--\s*page\s+(\d+)\s*-->"), F.lit(1))
    return md.select("paper_id", F.posexplode(pages).alias("nth", "page")).select("paper_id", F.col("page").cast("int").alias("page"), "nth")


class Anchors:
    """Where the beginnings of blocks occur in a text."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def places(self, anchor: str) -> list[int]:
        """All offsets of an anchor, ascending; looked up once."""
        if anchor not in self.known:
            found, at = [], self.text.find(anchor)
            while at >= 0:
                found.append(at)
                at = self.text.find(anchor, at + 1)
            self.known[anchor] = found
        return self.known[anchor]

    def next(self, anchors: list[str], least: int) -> int | None:
        """The first offset from ``least`` on of the first anchor that has one."""
        later = ((p, bisect_left(p, least)) for p in map(self.places, anchors))
        return next((p[i] for p, i in later if i < len(p)), None)


def page_breaks(text: str, pages: list[tuple[int, list[str]]]) -> list[tuple[int, int, bool]]:
    """``(offset, page, stray)`` of the marker of every page that shows in the text, offsets ascending.

    pages: in reading order, each with the beginnings of its blocks. A page starts at the line of its first block found
    behind the page before; one whose blocks are found only before that is stray: its marker stands right behind the one
    before. A page none of whose blocks is in the text has no marker.
    """
    known, out, reached = Anchors(text), [], 0
    for page, anchors in pages:
        spot = known.next(anchors, reached)
        if spot is not None:
            reached = max(text.rfind("\n", reached, spot) + 1, 0) or spot
            out.append((reached, page, False))
        elif any(map(known.places, anchors)):
            out.append((reached, page, True))
    return out


def marked(text: str, pages: list[tuple[int, list[str]]]) -> tuple[str, list[int]]:
    """A text with its page markers, and the stray pages. Without any block the whole text is page 1."""
    if not pages:
        return f"\n<!-- page 1 -->\n\n{text}", []
    breaks = page_breaks(text, pages)
    # one line break is enough before the page that opens the text: the first that shows in it or has nothing to show
    shown = {page for _, page, _ in breaks}
    opening = next((page for page, anchors in pages if page in shown or not anchors), None)
    cuts = [0, *(at for at, _, _ in breaks), len(text)]
    marks = [("\n" if page == opening else "\n\n") + f"<!-- page {page + 1} -->\n\n" for _, page, _ in breaks]
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    return "".join(x for pair in zip(pieces, [*marks, ""]) for x in pair), [page for _, page, stray in breaks if stray]


def inject_markers(md: DataFrame, blocks: DataFrame, text: str = "md") -> DataFrame:
    """``paper_id, md, fallback``: texts with a page marker before each page's first content found in them.

    Only blocks of papers with a text are read, of each page the first 60 characters of its blocks: no more than the text
    they are looked for in, which is one row already. Blocks meet by page first, then by paper.
    """
    held = blocks.where("text is not null").join(md.select("paper_id").dropDuplicates(), "paper_id", "left_semi")
    begun = held.select("paper_id", F.coalesce("page_idx", F.lit(0)).alias("page"), "ord", F.substring(strip("text"), 1, 60).alias("text"))
    long = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), lambda t: F.length(t) >= 8)
    by_page = begun.groupBy("paper_id", "page").agg(F.min("ord").alias("first"), long.alias("anchors"))
    order = by_page.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("first", "page", "anchors"))).alias("pages"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [marked(t or "", [(p["page"], list(p["anchors"])) for p in b] if b is not None else []) for t, b in zip(part["md"], part["pages"])]
            yield pd.DataFrame({"paper_id": part["paper_id"], "md": [d[0] for d in done], "fallback": [d[1] for d in done]})

    return md.select("paper_id", F.col(text).alias("md")).join(order, "paper_id", "left").mapInPandas(run, "paper_id string, md string, fallback array<int>")
