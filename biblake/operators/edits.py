"""Field-level edits of merged records by people and tools."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import CATEGORIES
from ..functions.ids import valid_arxiv, valid_doi
from ..functions.text import col
from .merge import STICKY

#: Fields that may be edited and the JSON type each takes.
KINDS = {
    **dict.fromkeys("title publication_date venue venue_short category doi arxiv_id osti_id isbn issn url abstract bibtex_key language license oa_status notes".split(), "string"),
    **dict.fromkeys(("authors", "keywords"), "array"), **dict.fromkeys(("year", "references_count"), "number"), "pages": "object", "needs_review": "boolean",
}


def check_source(source: str) -> str:
    if not re.match(STICKY, source):
        raise ValueError(f"the source of an edit is 'human' or 'tool:<name>', not {source!r}")
    return source


def json_kind(value: Column | str) -> Column:
    """JSON type of a value's text; null for SQL or JSON null."""
    v = F.trim(col(value))
    return (
        F.when(v.isNull() | (v == "null"), None).when(v.startswith('"'), "string").when(v.startswith("["), "array").when(v.startswith("{"), "object")
        .when(v.isin("true", "false"), "boolean").when(v.rlike(r"^-?\d+$"), "number").otherwise("invalid")
    )


def patch_error(field: Column | str, value: Column | str) -> Column:
    """Why a patch is refused; null if it isn't. value: JSON text; null deletes the field."""
    field, value = col(field), col(value)
    kind, text = json_kind(value), F.regexp_extract(value, r'^\s*"(.*)"\s*$', 1)
    expected = F.try_element_at(F.create_map(*(F.lit(x) for p in KINDS.items() for x in p)), field)
    return (
        F.when(field.startswith("_"), "managed by the tool").when(expected.isNull(), "unknown field").when(kind.isNull(), None).when(kind != expected, F.concat(F.lit("expected "), expected))
        .when((field == "category") & ~text.isin(CATEGORIES), "no valid category").when((field == "doi") & (text != "") & ~valid_doi(text), "no DOI").when((field == "arxiv_id") & (text != "") & ~valid_arxiv(text), "no arXiv id")
        .when(field.isin("authors", "keywords") & (F.size(F.filter(F.coalesce(F.from_json(value, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) != "STRING")) > 0), "expected strings")
    )


def apply_patches(fields: DataFrame, patches: DataFrame, source: str, at: str, note: str | None = None, restamp: bool = False) -> DataFrame:
    """``paper_id, field, value, source, at, note, previous, changed``: the fields after the edit; the caller writes them.

    fields: ``paper_id, field, value`` (JSON text), ``source``. patches: ``paper_id, field, value, seq``; the last of a
    field counts. All patches of a paper are refused if one is in error. A patch that changes nothing is skipped unless
    ``restamp``; null deletes the field and where it was from. Rows of papers without patches pass unchanged.
    """
    check_source(source)
    judged = patches.withColumn("error", patch_error("field", "value"))
    good = judged.groupBy("paper_id", "field").agg(F.max_by(F.struct(F.when(F.trim("value") != "null", F.col("value")).alias("value")), "seq").alias("p"))
    refused = judged.where("error is not null").select("paper_id").dropDuplicates()
    good = good.join(refused, "paper_id", "left_anti").select("paper_id", "field", F.col("p.value").alias("new"), F.lit(True).alias("patched"))
    both = fields.join(good, ["paper_id", "field"], "full")
    change = F.coalesce(F.col("patched"), F.lit(False)) & (F.lit(restamp) | ~F.col("new").eqNullSafe(F.col("value")))
    out = both.withColumn("changed", change).select(
        "paper_id", "field", F.when(F.col("changed"), F.col("new")).otherwise(F.col("value")).alias("value"), F.when(F.col("changed"), F.lit(source)).otherwise(F.col("source")).alias("source"),
        F.when(F.col("changed"), F.lit(at)).alias("at"), F.when(F.col("changed"), F.lit(note)).alias("note"), F.when(F.col("changed"), F.col("value")).alias("previous"), "changed",
    )
    return out.where("not (changed and value is null) and (value is not null or source is not null)")


def clear_review(bib: DataFrame, edited: DataFrame, clear: bool) -> DataFrame:
    """``bib`` with ``needs_review`` and ``review_reasons`` emptied for the papers of ``edited`` if ``clear``; a call without is no change."""
    if not clear:
        return bib
    seen = edited.select("paper_id", F.lit(True).alias("_cleared")).dropDuplicates()
    out = bib.join(seen, "paper_id", "left")
    return out.withColumns({
        "needs_review": F.when(F.col("_cleared"), False).otherwise(F.col("needs_review")), "review_reasons": F.when(F.col("_cleared"), F.array().cast("array<string>")).otherwise(F.col("review_reasons")),
    }).select(*bib.columns)


def edit_diff(fields: DataFrame, patches: DataFrame) -> DataFrame:
    """``paper_id, field, before, after`` of patches that would change something: a dry run."""
    last = patches.withColumn("error", patch_error("field", "value")).groupBy("paper_id", "field").agg(F.max_by(F.struct("value", "error"), "seq").alias("p"))
    both = last.where("p.error is null").join(fields.select("paper_id", "field", F.col("value").alias("before")), ["paper_id", "field"], "left")
    after = F.when(F.trim("p.value") != "null", F.col("p.value"))
    return both.select("paper_id", "field", "before", after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def edit_log(edited: DataFrame, source: str, at: str, note: str | None = None) -> DataFrame:
    """``paper_id, at, source, fields_changed, note``: one entry per paper in which something changed."""
    changed = edited.where("changed").groupBy("paper_id").agg(F.sort_array(F.collect_set("field")).alias("fields_changed"))
    return changed.select("paper_id", F.lit(at).alias("at"), F.lit(source).alias("source"), "fields_changed", F.lit(note).alias("note"))
