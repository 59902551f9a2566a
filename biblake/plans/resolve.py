"""From text and source records to one reviewed record per paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import category
from ..functions.ids import bibtex_key, extract_arxiv_id, extract_doi
from ..functions.text import NOT_WORD
from ..functions.text import is_blank
from ..operators.conflicts import all_conflicts, review_reasons
from ..operators.merge import EDITED, FIELDS, IDENTIFIERS, PRIORITY, SEQUENCE, merge_claims, priority

#: Lines that are no title.
_NO_TITLES = [
    r"^(?:LLNL|ANL|ORNL|PNNL|SAND|NREL|BNL|SLAC|LA-UR|LA-|ORNL/TM)\b",
    r"^(?i:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}",
    r"^\d{4}[-/]",
    r"^\d+$",
    r"^(?i:doi:)",
    r"^\d+\s+[a-z]",
]
_NO_TITLE = "|".join(_NO_TITLES)
_NO_FIRST = ["abstract", "disclaimer", "preface", "contents", "acknowledgment", "acknowledgements", "acknowledgement", "introduction", "references", "appendix", "copyright", "rights"]


def heuristic_title(pages: DataFrame, text: str = "text") -> DataFrame:
    """``paper_id, title``: the line of the first thirty that looks most like a title, with the next one if it goes on in lower case.

    Higher lines, capital initials and about fifty characters count. All within the row.
    """
    each = F.slice(F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), 1, 31)
    n = F.length
    words = lambda x: F.split(x, r"(?U)\s+")
    capital = lambda x: F.size(F.filter(words(x), lambda w: w.rlike(r"^\p{Lu}"))) / F.size(words(x))
    out = lambda x: (n(x) < 10) | (n(x) > 150) | ((n(x) > 20) & (F.upper(x) == x) & x.rlike(r"\p{L}")) | F.lower(F.regexp_replace(F.get(words(x), F.lit(0)), ":+$", "")).isin(_NO_FIRST) | x.rlike(_NO_TITLE)
    score = lambda x, i: F.when(out(x), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - i / 15) * 0.5 + capital(x) * 0.3 + (1 - F.abs(n(x) - 50) / 100) * 0.2)
    scored = F.transform(F.slice(F.col("l"), 1, 30), lambda x, i: F.struct(score(x, i).alias("s"), (-i).alias("i")))
    best = F.array_max(F.filter(scored, lambda x: x["s"] > 0.1))
    held = pages.select("paper_id", each.alias("l")).withColumn("b", best)
    after = F.get("l", 1 - F.col("b.i"))
    joins = after.rlike(r"^\p{Ll}") & (n(after) < 80) & ~after.rlike(_NO_TITLE)
    return held.select("paper_id", F.concat(F.get("l", -F.col("b.i")), F.when(joins, F.concat(F.lit(" "), after)).otherwise("")).alias("title"))


def identifiers(pages: DataFrame) -> DataFrame:
    """``paper_id, doi, arxiv_id`` as they stand in the text of the first pages or in the file's name."""
    return pages.select("paper_id", extract_doi("text").alias("doi"), extract_arxiv_id("text", "stem").alias("arxiv_id"))


def resolve(claims: DataFrame, records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per paper: merged fields, category with its rule, derived key, conflicts, review.

    claims: as ``claims_of_sources`` makes them. records: the credible records (``paper_id, source, seq, title, authors,
    doi, year, venue``, and ``raw_type`` if there is one) for conflicts and, of CrossRef, for the category. The category
    and the key are derived where no better source gave one: edits of people and tools stay, and so do earlier values of
    a higher rank. A paper's winners meet by paper once; nothing is collected.
    """
    won = merge_claims(claims, existing)
    # a category of at most the rank of rules is derived anew
    won = won.where((F.col("field") != "category") | (priority("source") > PRIORITY["derived"]))
    wide = won.groupBy("paper_id").pivot("field", FIELDS + IDENTIFIERS + EDITED).agg(F.first("value"))
    type_of = F.max_by("raw_type", "seq") if "raw_type" in records.columns else F.lit(None).cast("string")
    raw = records.where("source = 'crossref'").groupBy("paper_id").agg(type_of.alias("raw_type"))
    typed = wide.withColumns({"authors": F.from_json("authors", "array<string>"), "keywords": F.from_json("keywords", "array<string>"), "year": F.col("year").try_cast("int")}).join(raw, "paper_id", "left")
    full = typed.join(all_conflicts(records).select("paper_id", "conflicts"), "paper_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>")))
    nameless = is_blank("title") & is_blank("doi") & is_blank("arxiv_id")
    reasons = review_reasons(F.col("conflicts"), F.col("title"), F.col("authors"), F.col("year"), nameless)
    kind = category("doi", "arxiv_id", "venue", "raw_type")
    return full.withColumns({
        "category": F.coalesce("category", kind["category"]), "category_rule": F.when(F.col("category").isNull(), kind["rule"]), "bibtex_key": F.coalesce("bibtex_key", bibtex_key("authors", "year", "title")), "review_reasons": reasons, "needs_review": F.size(reasons) > 0,
    })


__all__ = ["NOT_WORD", "SEQUENCE", "heuristic_title", "identifiers", "resolve"]
