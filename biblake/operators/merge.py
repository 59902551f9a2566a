"""Merging claims of several sources into one record per paper."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import CATEGORIES
from ..functions.text import col

#: Rank of the sources; ``human`` and ``tool:<name>`` stick.
PRIORITY = {"human": 100, "osti": 80, "openalex": 70, "crossref": 65, "dblp": 60, "bibtex": 55, "arxiv": 50, "pdf": 30, "llm": 20, "semanticscholar": 15, "derived": 10, "unknown": 0}
STICKY = r"^(human|tool:[\w.-]+)$"
#: Fields taken from a source's record, and those only taken if they aren't empty.
FIELDS = ["title", "authors", "year", "publication_date", "venue", "doi", "url", "abstract", "keywords", "language", "oa_status", "isbn", "issn"]
IDENTIFIERS = ["arxiv_id", "osti_id", "bibtex_key"]
#: Fields that no source fills, only edits and rules do; order in which the sources write.
EDITED = ["category", "venue_short", "license", "references_count", "pages", "notes"]
SEQUENCE = {"pdf": 1, "llm": 2, "osti": 3, "openalex": 4, "crossref": 5, "arxiv": 6, "dblp": 7, "bibtex": 9, "semanticscholar": 10, "derived": 11}


def is_sticky(source: Column | str) -> Column:
    return F.coalesce(col(source).rlike(STICKY), F.lit(False))


def priority(source: Column | str) -> Column:
    """Rank of a source; unknown ones have 0."""
    known = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    return F.when(is_sticky(source), 100).otherwise(F.coalesce(F.try_element_at(known, col(source)), F.lit(0)))


def has_value(value: Column | str) -> Column:
    """A claim's JSON value that is no null, empty string or empty list."""
    return col(value).isNotNull() & ~col(value).isin("", "null", '""', "[]", "{}")


def claims_of(records: DataFrame, source: Column | str, seq: Column | str) -> DataFrame:
    """``paper_id, field, value, source, lookup_key, sim, seq``: one row per field that a record fills; values as JSON text.

    records: ``paper_id``, ``lookup_key``, ``sim`` and any of the known fields. A single pass, no shuffle.
    """
    present = [f for f in FIELDS + IDENTIFIERS if f in records.columns]
    text = lambda f: F.to_json(F.col(f)) if records.schema[f].dataType.typeName() in ("array", "struct", "map") else F.col(f).cast("string")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in present))
    out = records.select("paper_id", "lookup_key", "sim", col(source).alias("source"), col(seq).alias("seq"), F.explode(pairs).alias("c"))
    return out.select("paper_id", "c.field", "c.value", "source", "lookup_key", "sim", "seq").where(has_value("value"))


def claims_of_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Claims of all sources, in the order in which they write: one frame per source as ``claims_of`` takes it.

    A source that isn't known writes last. One union, no shuffle; an empty mapping is an error.
    """
    held = sorted(sources.items(), key=lambda x: (SEQUENCE.get(x[0], 99), x[0]))
    return reduce(DataFrame.unionByName, (claims_of(df, F.lit(name), F.lit(SEQUENCE.get(name, 99))) for name, df in held))


def with_provenance(won: DataFrame, at: str) -> DataFrame:
    """``paper_id, field, value, provenance`` of merged claims."""
    return won.select("paper_id", "field", "value", provenance(F.col("source"), F.col("lookup_key"), F.lit(at), F.col("sim")).alias("provenance"))


def merge_claims(claims: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``paper_id, field, value, source, lookup_key, sim``: the winner of each field.

    A later claim replaces an earlier one of at most its rank, so the latest of the highest rank wins: one partial and
    one final aggregation, whatever the order of rows; of sticky claims the earliest wins, as nothing replaces it. Claims without a value don't count, nor categories that aren't
    known. existing: rows of an earlier merge (``paper_id, field, value, source``, lookup_key and sim null or given):
    they stand first; without a source they lose to any claim; sticky ones win over all; a null value with a source still
    holds its rank.
    """
    bad = (F.col("field") == "category") & ~F.col("value").isin(CATEGORIES)
    rows = claims.where(has_value("value") & ~bad).select("paper_id", "field", "value", "source", "lookup_key", "sim", F.col("seq").cast("int").alias("seq"), priority("source").alias("rank"))
    if existing is not None:
        rank = F.when(F.col("source").isNull(), -1).when(is_sticky("source"), 1000).otherwise(priority("source"))
        lookup = F.col("lookup_key") if "lookup_key" in existing.columns else F.lit(None).cast("string")
        sim = F.col("sim") if "sim" in existing.columns else F.lit(None).cast("double")
        rows = rows.unionByName(existing.select("paper_id", "field", "value", "source", lookup.alias("lookup_key"), sim.alias("sim"), F.lit(0).alias("seq"), rank.alias("rank")))
    best = F.max_by(F.struct("value", "source", "lookup_key", F.round("sim", 4).alias("sim")), F.struct("rank", F.when(is_sticky("source"), -F.col("seq")).otherwise(F.col("seq"))))
    return rows.groupBy("paper_id", "field").agg(best.alias("w")).select("paper_id", "field", "w.*")


def provenance(source: Column, lookup_key: Column, at: Column, sim: Column | None = None, note: Column | None = None) -> Column:
    """What is kept of where a value is from."""
    empty = F.lit(None)
    return F.struct(source.alias("source"), lookup_key.alias("lookup_key"), at.alias("at"), F.round(sim if sim is not None else empty.cast("double"), 4).alias("similarity"), (note if note is not None else empty.cast("string")).alias("note"))
