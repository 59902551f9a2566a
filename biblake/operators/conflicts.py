"""Where credible sources of a paper disagree, and why a record needs review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import first_surname, normalize_doi
from ..functions.similarity import similarity
from ..functions.text import col, is_blank

#: What still counts as agreement.
TITLE_SIM, VENUE_SIM, YEAR_APART, LEAST_SIM = 0.85, 0.70, 1, 0.90


def lookup_status(found: Column | str, sim: Column | str, least: float = LEAST_SIM) -> Column:
    """``no_match``, ``hit`` or ``low_sim`` of a lookup; a similarity that is null (found by identifier) suffices."""
    return F.when(~F.coalesce(col(found), F.lit(False)), "no_match").when(col(sim).isNull() | (col(sim) >= least), "hit").otherwise("low_sim")


def plain_conflicts(records: DataFrame) -> DataFrame:
    """``paper_id, sources, conflicts``: sorted names of ``authors``, ``doi`` and ``year`` on which the records of a paper differ.

    records: one row per credible source. Fewer than two sources never conflict; nulls and empty values are no
    opinion. One aggregation, no pairs.
    """
    doi, name = normalize_doi("doi"), first_surname("authors")
    by = records.groupBy("paper_id").agg(
        F.count("*").alias("sources"),
        (F.max("year") - F.min("year")).alias("apart"),
        F.size(F.collect_set(doi)).alias("dois"),
        F.size(F.collect_set(F.when(name != "", name))).alias("names"),
    )
    found = F.array_compact(F.array(F.when(F.col("names") > 1, "authors"), F.when(F.col("dois") > 1, "doi"), F.when(F.col("apart") > YEAR_APART, "year")))
    return by.select("paper_id", "sources", F.when(F.col("sources") > 1, found).otherwise(F.array().cast("array<string>")).alias("conflicts"))


def text_conflicts(records: DataFrame, field: str, least: float) -> DataFrame:
    """``paper_id, field, lowest``: papers whose sources give texts less alike than ``least`` in the order of the sources.

    A paper has as many rows as sources (a handful), so pairs are taken inside its row, and only pairs of different
    texts reach Python.
    """
    held = records.where(~is_blank(field)).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq"), F.col(field).alias("text")))).alias("held"))
    ordered = held.where(F.size("held") > 1).select("paper_id", F.posexplode("held").alias("i", "a"), "held")
    pairs = ordered.select("paper_id", F.col("a.text").alias("a"), F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("b")).select("paper_id", "a", F.col("b.text").alias("b"))
    low = pairs.where("a <> b").withColumn("sim", similarity("a", "b")).groupBy("paper_id").agg(F.min("sim").alias("lowest"))
    return low.where(F.col("lowest") < least).select("paper_id", F.lit(field).alias("field"), "lowest")


def all_conflicts(records: DataFrame) -> DataFrame:
    """``paper_id, sources, conflicts``: sorted names of all fields on which a paper's credible sources differ.

    records: ``paper_id, seq, title, authors, year, doi, venue``, one row per credible source.
    """
    texts = text_conflicts(records, "title", TITLE_SIM).unionAll(text_conflicts(records, "venue", VENUE_SIM))
    by_text = texts.groupBy("paper_id").agg(F.collect_set("field").alias("texts"))
    both = plain_conflicts(records).join(by_text, "paper_id", "left")
    return both.select("paper_id", "sources", F.sort_array(F.concat("conflicts", F.coalesce("texts", F.array().cast("array<string>")))).alias("conflicts"))


#: Sources whose records are compared.
TIER1 = ["osti", "openalex", "crossref"]


def credible(records: DataFrame, least: float = LEAST_SIM) -> DataFrame:
    """Records of the first tier that were found by identifier or are alike enough (``source``, ``sim``)."""
    return records.where(F.col("source").isin(TIER1) & (F.col("sim").isNull() | (F.col("sim") >= least)))


def tier1_sufficient(records: DataFrame, merged: DataFrame) -> DataFrame:
    """``paper_id, sufficient``: both large sources found by identifier, none differs, and title, authors and year are known.

    records: as for ``all_conflicts`` with ``source`` and ``sim``; merged: ``paper_id, title, authors, year``.
    """
    sure = records.where(F.col("source").isin("openalex", "crossref")).groupBy("paper_id").agg((F.count_distinct("source") == 2).alias("both"), (F.min(F.coalesce("sim", F.lit(0.0))) == 1.0).alias("exact"))
    differ = all_conflicts(credible(records)).select("paper_id", (F.size("conflicts") > 0).alias("differ"))
    known = ~is_blank("title") & (F.size("authors") > 0) & (F.coalesce("year", F.lit(0)) != 0)
    held = merged.join(sure, "paper_id", "left").join(differ, "paper_id", "left")
    return held.select("paper_id", F.coalesce(F.col("both") & F.col("exact") & ~F.coalesce("differ", F.lit(False)) & known, F.lit(False)).alias("sufficient"))


def review_reasons(conflicts: Column, title: Column, authors: Column, year: Column, nameless: Column) -> Column:
    """Reasons for review: conflicts, missing core fields, and ``nameless`` (nothing to look the paper up by). None: no review."""
    none = F.coalesce(F.size(authors), F.lit(0)) <= 0
    return F.array_compact(F.array(
        F.when(F.size(conflicts) > 0, F.concat(F.lit("sources disagreed: "), F.array_join(F.sort_array(conflicts), ", "))),
        F.when(is_blank(title), "title missing"), F.when(none, "authors missing"), F.when(year.isNull() | (year == 0), "year missing"),
        F.when(nameless, "no identifiers extracted from PDF (no DOI, no arXiv ID, LLM failed)"),
    ))
