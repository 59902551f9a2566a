"""The library's queries on the test tables, each beside SQL that says the same where SQL can.

Inputs are whole tables. Where the tables lack a column an operator needs (raw source JSON, patches, stage states), it
is derived from others by plain expressions that both dialects share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import ids as I
from ..functions import text as X
from ..operators import conflicts, distill, edits, figures, merge, sections, state
from ..operators.distill import Question
from ..session import table
from ..sources import files, records
from . import render, resolve, surface

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def latest_bib(spark: SparkSession, root: str) -> DataFrame:
    """One row per paper: the latest."""
    bib = table(spark, root, "bib")
    held = [c for c in bib.columns if c != "paper_id"]
    return bib.groupBy("paper_id").agg(F.max_by(F.struct(*held), F.struct("ingested_at", F.xxhash64(F.coalesce("notes", F.lit("")), "needs_review"))).alias("r")).select("paper_id", "r.*")


def latest_md(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "paper_md").groupBy("paper_id").agg(F.max_by("md", "generated_at").alias("md"))


def latest_blocks(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "paper_content_list")
    held = [c for c in blocks.columns if c not in ("paper_id", "ord")]
    return blocks.groupBy("paper_id", "ord").agg(F.max_by(F.struct(*held), F.struct("extracted_at", F.coalesce("text", F.lit("")))).alias("r")).select("paper_id", "ord", "r.*")


def latest_records(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "source_records")
    held = [c for c in r.columns if c != "record_id"]
    return r.groupBy("record_id").agg(F.max_by(F.struct(*held), F.struct("fetched_at", "title", F.coalesce("year", F.lit(0)), F.coalesce("venue", F.lit("")), F.coalesce("publication_date", F.lit("")))).alias("r")).select("record_id", "r.*")


# the same in SQL
_BIB = "b as (select * from bib qualify row_number() over (partition by paper_id order by ingested_at desc) = 1)"
_MD = "m as (select paper_id, arg_max(md, generated_at) as md from paper_md group by paper_id)"
_BLOCKS = "k as (select * from paper_content_list qualify row_number() over (partition by paper_id, ord order by extracted_at desc, coalesce(text, '') desc) = 1)"
_REC = "r as (select * from source_records qualify row_number() over (partition by record_id order by fetched_at desc, title desc, coalesce(year, 0) desc, coalesce(venue, '') desc, coalesce(publication_date, '') desc) = 1)"
_STRIP = lambda c: rf"regexp_replace({c}, '^[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_WORDS = r"[^\p{L}\p{N}_]+"
_NORMAL = lambda c: f"trim(regexp_replace(lower({c}), '{_WORDS}', ' ', 'g'))"
_JOINED = lambda c: f"array_to_string(list_slice(list_filter(string_split(regexp_replace(lower(regexp_replace({_STRIP(c)}, '^\\d+(\\.\\d+)*\\s+', '')), '{_WORDS}', '_', 'g'), '_'), lambda w: w <> ''), 1, 4), '_')"
_SLUG = lambda c: rf"case when {_JOINED(c)} = '' then 'section' when regexp_matches({_JOINED(c)}, '^\p{{Nd}}') then 's_' || {_JOINED(c)} else {_JOINED(c)} end"
_LINES = "l as (select paper_id, md, unnest(string_split(md, chr(10))) as line, unnest(range(len(string_split(md, chr(10))))) as i from m), o as (select *, cast(coalesce(sum(length(line) + 1) over (partition by paper_id order by i rows between unbounded preceding and 1 preceding), 0) as int) as start from l)"


@query(
    f"with {_MD}, {_LINES}, h as (select paper_id, start, cast(length(regexp_extract(line, '^(#+)', 1)) as int) as level, {_STRIP(chr(39).join(['regexp_replace(line, ', '^#+ ', ', ', '', ')']))} as title, length(md) as total from o where regexp_matches(line, '^#{{1,6}} .+$')), "
    f"s as (select *, {_SLUG('title')} as base from h), n as (select *, row_number() over (partition by paper_id, base order by start) as nth from s) "
    "select paper_id, cast(row_number() over (partition by paper_id order by start) - 1 as int) as ord, case when nth = 1 then base else base || '_' || nth end as short_name, title, level, start as start_offset, "
    "cast(coalesce(lead(start) over (partition by paper_id order by start), total) as int) as end_offset from n"
)
def md_sections(spark, root):
    return sections.parse_sections(latest_md(spark, root))


@query(f"select title, {_SLUG('title')} as short_name from (select distinct title from sections)")
def md_section_slugs(spark, root):
    return table(spark, root, "sections").select("title").dropDuplicates().select("title", X.slug("title").alias("short_name"))


@query(f"with {_MD}, {_LINES} select paper_id, sha256({_STRIP('string_agg(line, chr(10) order by i)')}) as sha from o where not regexp_matches(line, '^<!--\\s*page\\s+\\d+\\s*-->\\s*$') group by paper_id")
def md_strip_markers(spark, root):
    return latest_md(spark, root).select("paper_id", F.sha2(X.without_markers("md"), 256).alias("sha"))


_STOP = "(" + ", ".join("'" + h.replace("'", "''") + "'" for h in X.BACK_MATTER) + ")"


@query(
    f"with {_MD}, {_LINES}, c as (select paper_id, min(i) as cut from o where starts_with({_STRIP('line')}, '#') and regexp_replace(lower({_STRIP(chr(39).join(['regexp_replace(trim(line), ', '^#+\\s*', ', ', '', ')']))}), ':+$', '') in {_STOP} group by paper_id) "
    f"select m.paper_id, sha256(coalesce({_STRIP('string_agg(line, chr(10) order by i)')}, '')) as sha, cast(coalesce(length({_STRIP('string_agg(line, chr(10) order by i)')}), 0) as int) as chars from m left join c on c.paper_id = m.paper_id left join o on o.paper_id = m.paper_id and (cut is null or i < cut) and not regexp_matches(line, '^<!--\\s*page\\s+\\d+\\s*-->\\s*$') group by m.paper_id"
)
def md_narrative(spark, root):
    body = X.narrative("md")
    return latest_md(spark, root).select("paper_id", F.sha2(body, 256).alias("sha"), F.length(body).alias("chars"))


def _cut_sql(cut: str, part: str) -> str:
    begin = "(c + 3) - (strpos(reverse(left(md, c + 3)), '--!<') - 1) - 4"
    return (
        f"with {_MD}, p as (select paper_id, md, cast({cut} as int) as c from m), q as (select *, strpos(reverse(left(md, c + 3)), '--!<') > 0 as has, {begin} as s from p), "
        "t as (select *, case when has then length(regexp_extract(substring(md, cast(s as int) + 1, 60), '^<!--\\s*page\\s+\\d+\\s*-->')) else 0 end as n from q) "
        f"select paper_id, sha256({part}) as sha, cast(length({part}) as int) as chars from t"
    )


@query(_cut_sql("least(3100, length(md))", "left(md, cast(case when s < c and c < s + n then s else c end as int))"))
def md_head(spark, root):
    return render.view_md(latest_md(spark, root), head=3100).select("paper_id", F.sha2("content", 256).alias("sha"), "chars")


@query(_cut_sql("greatest(length(md) - 9000, 0)", "substring(md, cast(case when s < c and c < s + n then s + n else c end as int) + 1)"))
def md_tail(spark, root):
    return render.view_md(latest_md(spark, root), tail=9000).select("paper_id", F.sha2("content", 256).alias("sha"), "chars")


@query(f"with {_MD} select paper_id, cast(unnest(regexp_extract_all(md, '<!--\\s*page\\s+(\\d+)\\s*-->', 1)) as int) as page, cast(unnest(range(len(regexp_extract_all(md, '<!--\\s*page\\s+(\\d+)\\s*-->', 1)))) as int) as nth from m")
def md_pages(spark, root):
    return sections.page_markers(latest_md(spark, root))


_TITLE_PREFIX = f"array_to_string(list_slice(list_filter(string_split({_NORMAL('coalesce(title, chr(32))')}, ' '), lambda w: w <> ''), 1, 8), ' ')"


@query(
    f"with {_MD}, {_LINES}, {_BIB}, t as (select paper_id, {_TITLE_PREFIX} as prefix from b), top as (select o.*, row_number() over (partition by paper_id order by i) as nth from o where regexp_matches(line, '^# .+$') and start < 6000), "
    f"f as (select top.paper_id, min(start + length(line) + 1) as upto from top join t on t.paper_id = top.paper_id where nth <= 20 and contains(prefix, ' ') and starts_with({_NORMAL('substring(line, 3)')}, prefix) group by top.paper_id) "
    "select m.paper_id, cast(length(case when upto is null then md else substring(md, cast(upto as int) + 1) end) as int) as chars, sha256(case when upto is null then md else substring(md, cast(upto as int) + 1) end) as sha from m join b on b.paper_id = m.paper_id left join f on f.paper_id = m.paper_id"
)
def md_cover_strip(spark, root):
    joined = latest_md(spark, root).join(latest_bib(spark, root).select("paper_id", "title"), "paper_id")
    out = joined.select("paper_id", sections.strip_cover("md", "title").alias("md"))
    return out.select("paper_id", F.length("md").alias("chars"), F.sha2("md", 256).alias("sha"))


@query()
def md_page_markers(spark, root):
    bare = latest_md(spark, root).select("paper_id", X.without_markers("md").alias("md"))
    marked = sections.inject_markers(bare, latest_blocks(spark, root))
    return marked.select("paper_id", F.length("md").alias("chars"), F.size("fallback").alias("fallbacks"))


@query()
def md_render(spark, root):
    whole, _ = render.render(latest_bib(spark, root), latest_md(spark, root), latest_blocks(spark, root))
    return whole.select("paper_id", F.length("md").alias("chars"), "degraded")


@query(f"with {_MD}, s as (select paper_id, arg_min(title, ord) as title, arg_min(start_offset, ord) as a, arg_min(end_offset, ord) as z from (select distinct paper_id, ord, short_name, title, start_offset, end_offset from sections where short_name = 'methods' and end_offset is not null qualify row_number() over (partition by paper_id, ord order by start_offset, end_offset, title) = 1) group by paper_id) select m.paper_id, title, sha256(substring(md, a + 1, z - a)) as sha from m join s on s.paper_id = m.paper_id")
def show_section(spark, root):
    index = table(spark, root, "sections").where("end_offset is not null").groupBy("paper_id", "ord", "short_name").agg(F.min(F.struct("start_offset", "end_offset", "title")).alias("s")).select("paper_id", "ord", "short_name", "s.*")
    return render.view_section(latest_md(spark, root), index, "methods").select("paper_id", "title", F.sha2("content", 256).alias("sha"))


_DIRTY_DOI = "case when length(paper_id) = 0 then null when paper_id < '5' then 'https://doi.org/' || upper(doi) || ').' when paper_id < 'a' then 'DOI: ' || doi || ';' else ' ' || doi || ' ' end"


@query(rf"select paper_id, nullif(regexp_replace(lower(regexp_replace(regexp_replace(trim({_DIRTY_DOI}), '(?i)^https?://doi\.org/', ''), '(?i)^doi:\s*', '')), '[.,);]+$', ''), '') as doi from bib")
def ids_doi_normalize(spark, root):
    return table(spark, root, "bib").select("paper_id", I.normalize_doi(F.expr(_DIRTY_DOI)).alias("doi"))


@query(r"select paper_id, regexp_replace(lower(nullif(regexp_extract('As shown (doi: ' || doi || ', and others)', '(10\.\d{4,9}/[^\s,;\x22<>]+)', 1), '')), '[.,);]+$', '') as doi from bib")
def ids_doi_extract(spark, root):
    return table(spark, root, "bib").select("paper_id", I.extract_doi(F.expr("'As shown (doi: ' || doi || ', and others)'")).alias("doi"))


@query(r"select paper_id, nullif(coalesce(nullif(regexp_extract('arXiv:' || arxiv_id || 'v2 [cs]', '(\d{4}\.\d{4,5})', 1), ''), nullif(regexp_extract('arXiv:' || arxiv_id || 'v2 [cs]', '([a-z\-]+/\d{7})', 1), '')), '') as arxiv_id from bib")
def ids_arxiv(spark, root):
    return table(spark, root, "bib").select("paper_id", I.extract_arxiv_id(F.expr("'arXiv:' || arxiv_id || 'v2 [cs]'"), F.lit("paper.pdf")).alias("arxiv_id"))


@query(f"select name, lower(case when contains({_STRIP('name')}, ',') then trim(split_part({_STRIP('name')}, ',', 1)) else list_last(regexp_split_to_array({_STRIP('name')}, '\\s+')) end) as surname from (select distinct unnest(authors) as name from bib)")
def author_surname(spark, root):
    return table(spark, root, "bib").select(F.explode("authors").alias("name")).dropDuplicates().select("name", I.surname("name").alias("surname"))


@query("select paper_id, array_to_string(list_filter(list_transform(regexp_split_to_array(array_to_string(authors, ' and '), '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> ''), '|') as names from bib where len(authors) > 0")
def bibtex_authors(spark, root):
    return table(spark, root, "bib").where("size(authors) > 0").select("paper_id", F.array_join(I.bibtex_authors(F.array_join("authors", " and ")), "|").alias("names"))


_MONTHS = "case " + " ".join(f"when contains(lower(d), '{m}') then '-{n:02d}'" for m, n in I.MONTHS) + " else '' end"
_DATED = "coalesce(publication_date, '') || case when paper_id < '4' then ' March' when paper_id < '8' then ' (Sept)' else '' end"


@query(rf"select paper_id, nullif(regexp_extract(d, '\b((?:19|20)\d{{2}})\b', 1), '') || {_MONTHS} as date from (select paper_id, {_DATED} as d from bib)")
def bibtex_date(spark, root):
    return table(spark, root, "bib").select("paper_id", I.bibtex_date(F.expr(_DATED)).alias("date"))


_SMALL = "(" + ", ".join(f"'{w}'" for w in I.SMALL_WORDS) + ")"


@query(
    rf"with {_BIB} select paper_id, case when len(authors) > 0 and year <> 0 then coalesce(nullif(lower(list_last(regexp_split_to_array({_STRIP('authors[1]')}, '\s+'))), ''), 'unknown') || year || "
    rf"coalesce(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(title, '')), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+'), lambda w: regexp_matches(w, '^\p{{L}}+$') and w not in {_SMALL})[1], 'paper') end as bibtex_key from b"
)
def bibtex_key(spark, root):
    return latest_bib(spark, root).select("paper_id", I.bibtex_key("authors", "year", "title").alias("bibtex_key"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _classify_sql() -> str:
    doi, venue = "lower(trim(coalesce(doi, '')))", "trim(coalesce(venue, ''))"
    cases = [(f"trim(coalesce(arxiv_id, '')) <> '' and ({doi} = '' or starts_with({doi}, '10.48550/arxiv'))", "'arxiv preprint'", "'arxiv_id:no-real-doi'")]
    cases += [(f"starts_with({doi}, '{p}')", "'preprint'", _q(f"preprint_doi_prefix:{p}")) for p in C.PREPRINT_PREFIXES]
    cases += [(f"contains(lower({venue}), '{h}') or contains({doi}, '{h}')", "'preprint'", _q(f"preprint_host:{h}")) for h in C.PREPRINT_HOSTS]
    for types, name in ((C.BOOK_TYPES, None), (C.REPORT_TYPES, "technical report"), (C.THESIS_TYPES, "thesis")):
        cases += [(f"lower(raw_type) = '{t}'", _q(name or ("book chapter" if "chapter" in t else "book")), "'crossref_type:' || raw_type") for t in types]
    for patterns, name, rule in ((C.THESIS_VENUES, "thesis", "thesis_venue_pattern"), (C.REPORT_VENUES, "technical report", "technical_report_venue_pattern"), (C.WORKSHOP_VENUES, "workshop paper", "workshop_pattern")):
        cases += [(f"regexp_matches({venue}, {_q('(?i)' + p)})", _q(name), _q(f"{rule}:{p}")) for p in patterns]
    cases += [(f"regexp_matches({venue}, {_q('(^|[^A-Za-z])' + a + '($|[^A-Za-z])')})", "'conference paper'", _q(f"conference_acronym:{a}")) for a in C.ACRONYMS]
    cases += [(f"regexp_matches({venue}, {_q('(?i)' + p)})", "'conference paper'", _q(f"conference_venue_pattern:{p}")) for p in C.CONFERENCE_VENUES]
    cases += [(f"{venue} <> ''", "'journal article'", "'derived:venue-present-no-conference-signal'"), ("true", "'other'", "'derived:no-rule-matched'")]
    pick = lambda i: "case " + " ".join(f"when {c[0]} then {c[i]}" for c in cases) + " end"
    return f"with {_BIB}, t as (select *, {_RAW_TYPE} as raw_type from b) select paper_id, {pick(1)} as category, {pick(2)} as rule from t"


_RAW_TYPE = "case when paper_id < '1' then 'book-chapter' when paper_id < '2' then 'report' when paper_id < '25' then 'dissertation' when paper_id < '3' then 'monograph' end"


@query(_classify_sql())
def classify_category(spark, root):
    b = latest_bib(spark, root).withColumn("raw_type", F.expr(_RAW_TYPE))
    return b.select("paper_id", C.category("doi", "arxiv_id", "venue", "raw_type").alias("c")).select("paper_id", "c.category", "c.rule")


@query("select record_id, case lower(raw_type) " + " ".join(f"when '{k}' then '{v}'" for k, v in C.TYPE_MAP.items()) + " else 'other' end as category from source_records")
def type_category(spark, root):
    return table(spark, root, "source_records").select("record_id", C.type_category("raw_type").alias("category"))


_RANK = "case when source = 'human' or regexp_matches(source, '^tool:[\\w.-]+$') then 100 " + " ".join(f"when source = '{s}' then {p}" for s, p in merge.PRIORITY.items()) + " else 0 end"
_CLAIMS = f"{_REC}, c as (select cast(record_id // 4 as varchar) as paper_id, field, value, source, cast(record_id as varchar) as lookup_key, record_id as seq from (select *, 'title' as field, title as value from r union all select *, 'year', cast(year as varchar) from r union all select *, 'publication_date', publication_date from r union all select *, 'venue', venue from r) where value is not null and value <> '')"


def _claims(spark: SparkSession, root: str) -> DataFrame:
    r = latest_records(spark, root).select(F.expr("cast(record_id div 4 as string)").alias("paper_id"), F.col("record_id").cast("string").alias("lookup_key"), F.lit(None).cast("double").alias("sim"), "source", F.col("record_id").alias("seq"), "title", "year", "publication_date", "venue")
    return merge.claims_of(r, "source", "seq")


@query(f"with {_CLAIMS} select paper_id, field, arg_max(value, {_RANK} * 1000000000::bigint + seq) as value, arg_max(source, {_RANK} * 1000000000::bigint + seq) as source, arg_max(lookup_key, {_RANK} * 1000000000::bigint + seq) as lookup_key from c group by paper_id, field")
def merge_priority(spark, root):
    return merge.merge_claims(_claims(spark, root)).drop("sim")


_OLD = "cast(paper_id as bigint) % 5 in (0, 1, 2)"


@query(
    f"with {_CLAIMS}, e as (select distinct paper_id, 'title' as field, 'kept ' || paper_id as value, case cast(paper_id as bigint) % 5 when 0 then 'tool:fix' when 1 then null else 'arxiv' end as source from c where {_OLD}), "
    f"x as (select paper_id, field, value, source, {_RANK} as rank, seq from c union all select paper_id, field, value, source, case when source is null then -1 when source = 'tool:fix' then 1000 else 50 end, 0 from e) "
    "select paper_id, field, arg_max(value, rank * 1000000000::bigint + seq) as value, arg_max(coalesce(source, '-'), rank * 1000000000::bigint + seq) as source from x where field = 'title' group by paper_id, field"
)
def merge_sticky(spark, root):
    claims = _claims(spark, root)
    n = F.col("paper_id").cast("bigint") % 5
    old = claims.where(n < 3).select("paper_id").dropDuplicates().select("paper_id", F.lit("title").alias("field"), F.concat(F.lit("kept "), "paper_id").alias("value"), F.when(n == 0, "tool:fix").when(n == 2, "arxiv").alias("source"))
    return merge.merge_claims(claims.where("field = 'title'"), old).select("paper_id", "field", "value", F.coalesce("source", F.lit("-")).alias("source"))


_SRC_NAME = f"lower(case when contains({_STRIP('authors[1]')}, ',') then trim(split_part({_STRIP('authors[1]')}, ',', 1)) else list_last(regexp_split_to_array({_STRIP('authors[1]')}, '\\s+')) end)"


@query(
    f"with {_REC}, g as (select cast(record_id // 3 as varchar) as paper_id, year, {_SRC_NAME} as name, case when record_id % 2 = 0 then '10.1/' || (record_id // 6) when record_id % 3 = 0 then 'doi:10.1/' || (record_id // 6) || '.' end as doi from r), "
    "a as (select paper_id, count(*) as sources, max(year) - min(year) as apart, count(distinct regexp_replace(regexp_replace(doi, '^doi:', ''), '\\.$', '')) as dois, count(distinct nullif(name, '')) as names from g group by paper_id) "
    "select paper_id, sources, case when sources > 1 then array_to_string(list_filter([case when names > 1 then 'authors' end, case when dois > 1 then 'doi' end, case when apart > 1 then 'year' end], lambda x: x is not null), ',') else '' end as conflicts from a"
)
def conflicts_plain(spark, root):
    doi = "case when record_id % 2 = 0 then '10.1/' || (record_id div 6) when record_id % 3 = 0 then 'doi:10.1/' || (record_id div 6) || '.' end"
    r = latest_records(spark, root).select(F.expr("cast(record_id div 3 as string)").alias("paper_id"), "year", "authors", F.expr(doi).alias("doi"))
    return conflicts.plain_conflicts(r).select("paper_id", "sources", F.array_join("conflicts", ",").alias("conflicts"))


@query()
def conflicts_title(spark, root):
    r = latest_records(spark, root).select(F.expr("cast(record_id div 3 as string)").alias("paper_id"), F.col("record_id").alias("seq"), "title")
    return conflicts.text_conflicts(r, "title", conflicts.TITLE_SIM).select("paper_id", "field", F.round("lowest", 4).alias("lowest"))


@query(
    f"with {_BIB} select paper_id, array_to_string(list_filter([case when paper_id < '4' then 'sources disagreed: doi, year' end, case when coalesce({_STRIP('title')}, '') = '' then 'title missing' end, case when coalesce(len(authors), 0) = 0 then 'authors missing' end, case when year is null or year = 0 then 'year missing' end, "
    f"case when coalesce({_STRIP('doi')}, '') = '' and coalesce({_STRIP('arxiv_id')}, '') = '' then 'no identifiers extracted from PDF (no DOI, no arXiv ID, LLM failed)' end], lambda x: x is not null), '; ') as reasons from b"
)
def review_reasons(spark, root):
    differ = F.expr("case when paper_id < '4' then array('year', 'doi') else cast(array() as array<string>) end")
    nameless = X.is_blank("doi") & X.is_blank("arxiv_id")
    return latest_bib(spark, root).select("paper_id", F.array_join(conflicts.review_reasons(differ, F.col("title"), F.col("authors"), F.col("year"), nameless), "; ").alias("reasons"))


@query("select record_id, case when record_id % 3 = 0 then 'no_match' when record_id % 5 = 0 or (record_id % 100) / 100.0 >= 0.9 then 'hit' else 'low_sim' end as status from source_records")
def lookup_status(spark, root):
    sim = F.when(F.col("record_id") % 5 != 0, (F.col("record_id") % 100) / 100)
    return table(spark, root, "source_records").select("record_id", conflicts.lookup_status(F.col("record_id") % 3 != 0, sim).alias("status"))


@query(f"with {_BIB}, s as (select lower(doi) as k, min(paper_id) as found from b where doi is not null and paper_id >= '4' group by 1) select b.paper_id, found, case when found is not null then 1.0::double end as sim from b left join s on s.k = lower(b.doi)")
def lookup_doi(spark, root):
    b = latest_bib(spark, root)
    snapshot = b.where("paper_id >= '4' and doi is not null").select(F.col("paper_id").alias("found"), "doi")
    asked = b.select("paper_id", F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"))
    return records.lookup_by(asked, snapshot, "doi").select("paper_id", "rec.found", "sim")


@query(
    f"with {_BIB}, s as (select paper_id as found, doi, arxiv_id from b where paper_id >= '4'), d as (select lower(doi) as k, min(found) as found from s where doi is not null group by 1), a as (select arxiv_id as k, min(found) as found from s where arxiv_id is not null group by 1) "
    "select b.paper_id, coalesce(d.found, a.found) as found, case when d.found is not null then 'doi' when a.found is not null then 'arxiv' end as kind from b left join d on d.k = lower(b.doi) left join a on a.k = b.arxiv_id"
)
def lookup_cascade(spark, root):
    b = latest_bib(spark, root)
    snapshot = b.where("paper_id >= '4'").select(F.col("paper_id").alias("found"), "doi", "arxiv_id")
    return records.cascade(b.select("paper_id", "doi", "arxiv_id"), snapshot).select("paper_id", "rec.found", "kind")


@query()
def fuzzy_title_top1(spark, root):
    return records.fuzzy_top1(latest_bib(spark, root).select("paper_id", "title", "year"), latest_records(spark, root).select("record_id", "title", "year"))


def _raw(spark: SparkSession, root: str, json: str) -> DataFrame:
    return latest_bib(spark, root).select("paper_id", F.expr(f"to_json({json})").alias("json"))


_FILLED = "array_to_string(list_filter(authors, lambda x: x <> ''), '|')"


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("paper_id", *(F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) if c in ("authors", "keywords") else F.col(c) for c in columns))


@query(f"with {_BIB} select paper_id, title, coalesce({_FILLED}, '') as authors, year, venue, lower(doi) as doi, coalesce(array_to_string(keywords, '|'), '') as keywords, nullif(array_to_string(list_filter(string_split(coalesce(title, ''), ' '), lambda w: w <> ''), ' '), '') as abstract from b")
def source_openalex(spark, root):
    words = "filter(split(coalesce(title, ''), ' '), w -> w <> '')"
    inverted = f"map_from_entries(transform(array_distinct({words}), w -> struct(w, filter(sequence(0, size({words})), p -> get({words}, p) = w))))"
    raw = _raw(spark, root, f"struct(title as display_name, doi, year as publication_year, struct(struct(venue as display_name) as source) as primary_location, transform(authors, a -> struct(struct(a as display_name) as author)) as authorships, transform(keywords, k -> struct(k as display_name)) as keywords, {inverted} as abstract_inverted_index)")
    return _flat(records.project(raw, "openalex"), "title", "authors", "year", "venue", "doi", "keywords", "abstract")


@query(f"with {_BIB} select paper_id, title, coalesce(array_to_string(list_filter(list_transform(authors, lambda a: case when a <> '' then 'A ' || a else a end), lambda x: x <> ''), '|'), '') as authors, year, case when year is not null then year || '-03' end as publication_date, nullif(venue, '') as venue, lower(doi) as doi, trim(abstract) as abstract from b")
def source_crossref(spark, root):
    raw = _raw(spark, root, "struct(array(title) as title, doi as DOI, array(venue) as `container-title`, transform(authors, a -> struct('A' as given, a as family)) as author, case when year is not null then struct(array(array(year, 3)) as `date-parts`) end as published, '<p>' || abstract || '</p>' as abstract)")
    return _flat(records.project(raw, "crossref"), "title", "authors", "year", "publication_date", "venue", "doi", "abstract")


@query(f"with {_BIB} select paper_id, title, coalesce(array_to_string(list_filter(list_transform(authors, lambda a: trim(split_part(a, '[', 1))), lambda x: x <> ''), '|'), '') as authors, try_cast(left(publication_date, 4) as int) as year, nullif(venue, '') as venue, lower(doi) as doi, osti_id from b")
def source_osti(spark, root):
    raw = _raw(spark, root, "struct(title, osti_id, doi, transform(authors, a -> a || ' [Somewhere]') as authors, publication_date, venue as journal_name)")
    return _flat(records.project(raw, "osti"), "title", "authors", "year", "venue", "doi", "osti_id")


@query(f"with {_BIB} select paper_id, regexp_replace(title, '\\.$', '') as title, coalesce(array_to_string(list_filter(list_transform(case when paper_id < '8' then authors else authors[1:1] end, lambda a: regexp_replace(a, '\\s\\d{{4}}$', '')), lambda x: x <> ''), '|'), '') as authors, year, venue, lower(doi) as doi from b")
def source_dblp(spark, root):
    # several authors are a list of objects, one author is an object
    author = "case when paper_id < '8' then to_json(transform(authors, a -> struct(a as text))) when size(authors) > 0 then to_json(struct(authors[0] as text)) end"
    raw = latest_bib(spark, root).select("paper_id", F.expr(f"regexp_replace(to_json(struct(struct(title, cast(year as string) as year, venue, doi, struct('@@' as author) as authors) as info)), '\"@@\"', replace(replace(coalesce({author}, 'null'), '\\\\', '\\\\\\\\'), '$', '\\\\$'))").alias("json"))
    return _flat(records.project(raw, "dblp"), "title", "authors", "year", "venue", "doi")


@query(f"with {_BIB} select paper_id, trim(title) as title, coalesce({_FILLED}, '') as authors, try_cast(left(publication_date, 4) as int) as year, left(publication_date, 10) as publication_date, arxiv_id from b")
def source_arxiv(spark, root):
    raw = _raw(spark, root, "struct('http://arxiv.org/abs/' || arxiv_id || 'v3' as id, '  ' || title || '\\n ' as title, publication_date as published, transform(authors, a -> struct(a as name)) as author)")
    return _flat(records.project(raw, "arxiv"), "title", "authors", "year", "publication_date", "arxiv_id")


@query(f"with {_BIB} select paper_id, title, coalesce({_FILLED}, '') as authors, year, nullif(venue, '') as venue, lower(doi) as doi, arxiv_id, case when paper_id < '5' then 'journal-article' when paper_id < '9' then 'proceedings-article' end as raw_type from b")
def source_semanticscholar(spark, root):
    kinds = "case when paper_id < '5' then array('JournalArticle', 'Review') when paper_id < '9' then array('Conference') end"
    raw = _raw(spark, root, f"struct(title, transform(authors, a -> struct(a as name)) as authors, year, venue, struct(doi as DOI, arxiv_id as ArXiv) as externalIds, {kinds} as publicationTypes)")
    return _flat(records.project(raw, "semanticscholar"), "title", "authors", "year", "venue", "doi", "arxiv_id", "raw_type")


_JOIN = lambda c: f"nullif(array_to_string(list_filter({c}, lambda s: {_STRIP('s')} <> ''), chr(10)), '')"
_FIGURES = (
    f"{_BLOCKS}, f as (select *, row_number() over (partition by paper_id, page_idx order by ord) as nth from k where type in ('image', 'chart', 'table') and img_path <> ''), "
    "g as (select paper_id, printf('page%03d_img%d', page_idx + 1, nth) as id, cast(page_idx + 1 as int) as page, type, cast(case when len(bbox) = 4 then round_even(bbox[3] - bbox[1], 0) else 0 end as int) as width_pt, cast(case when len(bbox) = 4 then round_even(bbox[4] - bbox[2], 0) else 0 end as int) as height_pt, "
    f"case type when 'image' then {_JOIN('image_caption')} when 'chart' then {_JOIN('chart_caption')} else {_JOIN('table_caption')} end as caption, case type when 'image' then {_JOIN('image_footnote')} when 'chart' then {_JOIN('chart_footnote')} else {_JOIN('table_footnote')} end as footnote, "
    "regexp_replace(list_last(string_split(img_path, '/')), '\\.[^.]*$', '') as source_sha from f)"
)


@query(f"with {_FIGURES} select * from g")
def figures_all(spark, root):
    return figures.extract_figures(latest_blocks(spark, root)).drop("page_idx", "bbox", "img_path")


@query(f"with {_BLOCKS} select paper_id, printf('page%03d_img%d', page_idx + 1, row_number() over (partition by paper_id, page_idx order by ord)) as id from k where type = 'table' and img_path <> ''")
def figures_tables(spark, root):
    return figures.extract_figures(latest_blocks(spark, root), ["table"]).select("paper_id", "id")


@query(f"with {_FIGURES} select paper_id, count(*) as n, string_agg(id, ',' order by id) as ids from g group by paper_id")
def figures_manifest(spark, root):
    m = figures.manifest(figures.extract_figures(latest_blocks(spark, root)).select("paper_id", "id", "page", "caption"))
    read = F.from_json("manifest", "count bigint, figures array<struct<id: string>>")
    return m.select("paper_id", read.alias("m")).select("paper_id", F.col("m.count").alias("n"), F.array_join(F.sort_array(F.transform("m.figures", lambda f: f["id"])), ",").alias("ids"))


@query(f"with {_BLOCKS} select paper_id, sha256(string_agg(text, chr(10) || chr(10) order by page_idx, text)) as sha from (select paper_id, page_idx, text from k where page_idx < 3 and coalesce({_STRIP('text')}, '') <> '') group by paper_id")
def first_pages(spark, root):
    return files.first_pages(latest_blocks(spark, root)).select("paper_id", F.sha2("text", 256).alias("sha"))


@query()
def title_heuristic(spark, root):
    return resolve.heuristic_title(files.first_pages(latest_blocks(spark, root)))


@query(f"with {_BLOCKS} select paper_id, cast(row_number() over (partition by paper_id order by ord) - 1 as int) as ord, type, cast(length(text) as int) as chars from k")
def blocks_json(spark, root):
    fields = ["type", "text", "text_level", "page_idx", "bbox", "img_path"]
    listed = latest_blocks(spark, root).withColumn("text", F.coalesce("text", F.lit(None).cast("string"))).withColumn("part", F.expr("cast(ord div 500 as int)"))
    # a list per 500 blocks: a volume's blocks never meet in one row
    packed = listed.groupBy("paper_id", "part").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", *fields))), lambda b: F.struct(*(b[c].alias(c) for c in fields)))).alias("blocks_json"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(_before("paper_id", "part")), F.lit(0))
    numbered = packed.select(F.concat_ws("#", "paper_id", "part").alias("paper_id"), "blocks_json", before.alias("before"))
    out = files.blocks_of(numbered).join(numbered.select("paper_id", "before"), "paper_id")
    return out.select(F.substring_index("paper_id", "#", 1).alias("paper_id"), (F.col("ord") + F.col("before")).cast("int").alias("ord"), "type", F.length("text").alias("chars"))


def _before(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


ASKED = [
    Question("summary", "abstract", distill.SUMMARY, 600), Question("methods", "section", "How was it done?", 300, section="methods"), Question("gist", "narrative", "What is it about?"),
    Question("whole", "full", "List the data used.", 1000, model="other-model"), Question("summary", "abstract", "Summarize.", 400),
]


def _asked(spark: SparkSession) -> DataFrame:
    return distill.question_table(spark, ASKED)


@query(f"with {_BIB} select paper_id, name, scope, cast(most as int) as max_chars, coalesce(model, 'default-model') as model from b cross join (values ('summary', 'abstract', 400, null), ('methods', 'section', 300, null), ('gist', 'narrative', null, null), ('whole', 'full', 1000, 'other-model')) q(name, scope, most, model)")
def distill_plan(spark, root):
    return distill.plan(latest_bib(spark, root).select("paper_id"), _asked(spark)).select("paper_id", "name", "scope", "max_chars", F.coalesce("model", F.lit("default-model")).alias("model"))


def _inputs(spark: SparkSession, root: str) -> DataFrame:
    md = latest_md(spark, root)
    return distill.inputs(latest_bib(spark, root), md, sections.parse_sections(md), _asked(spark))


_HEAD = "array_to_string(list_filter([case when title <> '' then 'Title: ' || title end, case when len(authors) > 0 then 'Authors: ' || array_to_string(authors[1:5], ', ') || case when len(authors) > 5 then ' et al.' else '' end end, case when venue <> '' then 'Venue: ' || venue end, case when year <> 0 then 'Year: ' || year end], lambda x: x is not null), chr(10))"


@query(
    f"with {_BIB}, {_MD}, x as (select b.paper_id, {_HEAD} as head, {_STRIP('abstract')} as abstract, md from b left join m on m.paper_id = b.paper_id), "
    "y as (select paper_id, 'summary' as name, case when coalesce(abstract, '') <> '' then head || chr(10) || chr(10) || 'Abstract:' || chr(10) || abstract end as content from x union all select paper_id, 'whole', head || chr(10) || chr(10) || '---' || chr(10) || chr(10) || md from x) "
    "select paper_id, name, case when content is null then 'error' else 'ready' end as status, sha256(content) as sha, cast(floor(length(content) / 4) as int) as tokens from y"
)
def distill_inputs(spark, root):
    return _inputs(spark, root).where("name in ('summary', 'whole')").select("paper_id", "name", "status", F.sha2("content", 256).alias("sha"), F.when(F.col("status") == "ready", F.col("tokens")).alias("tokens"))


@query(SQL["md_sections"].replace("select paper_id, cast(row_number()", "select paper_id, short_name from (select paper_id, cast(row_number()", 1).replace("as end_offset from n", "as end_offset from n)"))
def distill_sections(spark, root):
    return sections.parse_sections(latest_md(spark, root)).select("paper_id", "short_name")


@query()
def distill_missing_section(spark, root):
    return _inputs(spark, root).where("status = 'missing-section'").select("paper_id", "name", "error")


@query(
    "with d as (select doc_id, text, left(text, 200) as cut from documents where text is not null), e as (select *, strpos(reverse(cut), ' ') as back from d), "
    rf"f as (select doc_id, length(text) > 200 as truncated, case when length(text) > 200 then regexp_replace(case when back > 0 and length(cut) - back > 160 then left(cut, length(cut) - back) else cut end, '[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '') || '…' else text end as body from e) "
    rf"select doc_id, {_STRIP('array_to_string(list_transform(string_split(body, chr(10)), lambda l: regexp_replace(l, ' + chr(39) + r'[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$' + chr(39) + ', ' + chr(39) * 2 + ')), chr(10))')} as text, truncated from f"
)
def distill_post_process(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", X.post_process("text", 200).alias("p")).select("doc_id", "p.text", "p.truncated")


@query("select doc_id, case when floor(length(text) / 4) > 1000 then 'too long' else 'ok' end as status, sha256('Why?' || chr(10) || chr(10) || 'Your response MUST be at most 90 characters. Be concise.' || chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || chr(10) || text) as sha from documents where text is not null")
def distill_prompt(spark, root):
    d = table(spark, root, "documents").where("text is not null").withColumn("most", F.lit(90))
    return d.select("doc_id", F.when(X.tokens_estimate("text") > 1000, "too long").otherwise("ok").alias("status"), F.sha2(X.prompt(F.lit(" Why? "), "text", "most"), 256).alias("sha"))


def _echo() -> Callable[[str, str], str]:
    return lambda model, prompt: f"{model}: {prompt[-80:]}"


@query()
def distill_run(spark, root):
    return distill.run(_inputs(spark, root).where("name = 'summary'"), _echo, "default-model").select("paper_id", "name", "model", "output", "status")


_FIELDS = "f as (select paper_id, 'title' as field, to_json(title)::varchar as value, 'osti' as source from b where title is not null union all select paper_id, 'year', cast(year as varchar), 'crossref' from b where year is not null)"
_PATCHES = "p as (select paper_id, 'year' as field, case when paper_id < '4' then '1999' when paper_id < '6' then 'null' else cast(year as varchar) end as value from b where paper_id < '8' union all select paper_id, 'category', case when paper_id >= '1' then '\"other\"' else '\"no such\"' end from b where paper_id < '2')"
_REFUSED = "p2 as (select * from p where paper_id not in (select paper_id from p where field = 'category' and value = '\"no such\"'))"


def _fields_and_patches(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    b = latest_bib(spark, root)
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("title").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    held = b.where("title is not null").select("paper_id", F.lit("title").alias("field"), quoted.alias("value"), F.lit("osti").alias("source"))
    held = held.unionAll(b.where("year is not null").select("paper_id", F.lit("year"), F.col("year").cast("string"), F.lit("crossref")))
    y = b.where("paper_id < '8'").select("paper_id", F.lit("year").alias("field"), F.expr("case when paper_id < '4' then '1999' when paper_id < '6' then 'null' else cast(year as string) end").alias("value"), F.lit(1).alias("seq"))
    c = b.where("paper_id < '2'").select("paper_id", F.lit("category").alias("field"), F.expr("case when paper_id >= '1' then '\"other\"' else '\"no such\"' end").alias("value"), F.lit(2).alias("seq"))
    return held, y.unionAll(c)


@query(
    f"with {_BIB}, {_FIELDS}, {_PATCHES}, {_REFUSED}, j as (select coalesce(f.paper_id, p2.paper_id) as paper_id, coalesce(f.field, p2.field) as field, f.value, f.source, nullif(p2.value, 'null') as new, p2.paper_id is not null as patched from f full join p2 on p2.paper_id = f.paper_id and p2.field = f.field), "
    "c as (select *, patched and new is distinct from value as changed from j) select paper_id, field, case when changed then new else value end as value, case when changed then 'human' else source end as source, case when changed then value end as previous, changed from c where not (changed and new is null) and (value is not null or new is not null)"
)
def bib_edit(spark, root):
    held, patches = _fields_and_patches(spark, root)
    return edits.apply_patches(held, patches, "human", "2025-01-01T00:00:00+00:00").select("paper_id", "field", "value", "source", "previous", "changed")


@query(f"with {_BIB}, {_FIELDS}, {_PATCHES} select p.paper_id, p.field, f.value as before, nullif(p.value, 'null') as after from p left join f on f.paper_id = p.paper_id and f.field = p.field where not (p.field = 'category' and p.value = '\"no such\"') and f.value is distinct from nullif(p.value, 'null')")
def bib_edit_diff(spark, root):
    return edits.edit_diff(*_fields_and_patches(spark, root))


@query(f"with {_BIB}, {_PATCHES} select paper_id, field, case when value = '\"no such\"' then 'no valid category' end as error from p")
def bib_edit_errors(spark, root):
    return _fields_and_patches(spark, root)[1].select("paper_id", "field", edits.patch_error("field", "value").alias("error"))


_WANTED = "w as (select cast(doc_id as varchar) as paper_id, 'md' as stage, sha256(coalesce(text, '')) as input_sha from documents), s as (select cast(doc_id as varchar) as paper_id, 'md' as stage, case when doc_id % 3 = 0 then sha256(coalesce(text, '')) else 'old' end as input_sha from documents where doc_id % 2 = 0)"


def _stage(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, root, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    none = F.lit(None).cast("string").alias("query")
    wanted = d.select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("md").alias("stage"), none, sha.alias("input_sha"))
    done = d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("md").alias("stage"), none, F.lit("t").alias("completed_at"), F.when(F.col("doc_id") % 3 == 0, sha).otherwise("old").alias("input_sha"))
    return wanted, done


@query(f"with {_WANTED} select paper_id, stage, input_sha from w where not exists (select 1 from s where s.paper_id = w.paper_id and s.stage = w.stage and s.input_sha = w.input_sha)")
def stage_pending(spark, root):
    wanted, done = _stage(spark, root)
    return state.pending(wanted, done, ["input_sha"]).select("paper_id", "stage", "input_sha")


@query(f"with {_WANTED} select paper_id, stage, input_sha from s where not exists (select 1 from w where w.paper_id = s.paper_id and w.input_sha <> s.input_sha) union all select paper_id, stage, input_sha from w where exists (select 1 from s where s.paper_id = w.paper_id and w.input_sha <> s.input_sha)")
def stage_mark(spark, root):
    wanted, done = _stage(spark, root)
    redone = state.pending(wanted, done, ["input_sha"]).join(done.select("paper_id"), "paper_id", "left_semi").withColumn("completed_at", F.lit("t"))
    return state.mark_complete(done, redone).select("paper_id", "stage", "input_sha")


@query(f"with {_WANTED} select paper_id, stage from s where cast(paper_id as bigint) % 4 <> 0")
def stage_clean(spark, root):
    _, done = _stage(spark, root)
    return state.clean(done, done.where("cast(paper_id as bigint) % 4 = 0"), "md").select("paper_id", "stage")


@query(f"with {_BIB}, p as (select distinct paper_id from paper_md union select 'nowhere') select p.paper_id, case when b.paper_id is null then 'BibMissing' when b.needs_review then 'ReviewNeeded' else 'ok' end as status, cast(case when b.paper_id is not null and not b.needs_review then 0 else 3 end as int) as exit_code from p left join b on b.paper_id = p.paper_id")
def bib_gate(spark, root):
    papers = table(spark, root, "paper_md").select("paper_id").union(spark.range(1).select(F.lit("nowhere"))).dropDuplicates()
    return state.bib_gate(papers, latest_bib(spark, root))


@query("select doc_id, sha256(text) as sha, left(sha256(text), 12) as short from documents where text is not null")
def content_hash(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", state.content_hash("text").alias("sha"), state.content_hash("text", 12).alias("short"))


@query(f"with {_BIB} select paper_id, case when length(title) > 80 then left(title, 77) || '...' else title end as title, case when len(authors) > 3 then array_to_string(authors[1:3], '; ') || ' (+' || (len(authors) - 3) || ')' else array_to_string(authors, '; ') end as authors, case when length(abstract) > 80 then left(abstract, 77) || '...' else abstract end as abstract, needs_review from b")
def show_bib(spark, root):
    return render.view_bib(latest_bib(spark, root))


@query(f"with {_BIB} select paper_id, case when coalesce(len(authors), 0) = 0 then '' when len(authors) <= 3 then array_to_string(authors, ', ') else authors[1] || ' et al.' end as by_line, array_to_string(list_filter([nullif(venue, ''), cast(nullif(year, 0) as varchar)], lambda x: x is not null), ' · ') as at_line from b")
def author_venue_lines(spark, root):
    return latest_bib(spark, root).select("paper_id", X.author_line("authors").alias("by_line"), X.venue_year_line("venue", "year").alias("at_line"))


@query(f"with {_BIB}, s as (select distinct paper_id, 'md' as stage from paper_md), t as (select distinct paper_id, 'figures' as stage from paper_content_list), u as (select paper_id, string_agg(stage, ',' order by stage) as stages from (select * from s union all select * from t) group by paper_id) select b.paper_id, b.title, stages, cast(0 as bigint) as answers from b left join u on u.paper_id = b.paper_id")
def show_info(spark, root):
    done = table(spark, root, "paper_md").select("paper_id", F.lit("md").alias("stage")).unionAll(table(spark, root, "paper_content_list").select("paper_id", F.lit("figures"))).dropDuplicates().withColumn("completed_at", F.lit("t"))
    return render.view_info(latest_bib(spark, root), done, spark.createDataFrame([], "paper_id string")).withColumn("answers", F.col("answers").cast("bigint"))


@query()
def resolve_papers(spark, root):
    r = latest_records(spark, root).withColumns({"paper_id": F.expr("cast(record_id div 4 as string)"), "doi": F.lit(None).cast("string"), "seq": F.col("record_id")})
    out = resolve.resolve(_claims(spark, root), r.select("paper_id", "source", "seq", "title", "authors", "doi", "year", "venue", "raw_type"))
    return out.select("paper_id", "title", "year", "category", "category_rule", "needs_review", F.array_join("review_reasons", "; ").alias("reasons"))


_EDITS = "select distinct paper_id, 'category' as field, case cast(paper_id as bigint) % 4 when 0 then 'thesis' when 1 then 'book' else 'preprint' end as value, case cast(paper_id as bigint) % 4 when 0 then 'human' when 1 then 'tool:fix' else 'derived' end as source from c where cast(paper_id as bigint) % 4 < 3"
_WON = f"arg_max(value, {_RANK} * 1000000000::bigint + seq)"


@query(
    f"with {_CLAIMS}, e as ({_EDITS}), k as (select paper_id, arg_max(raw_type, record_id) filter (where source = 'crossref' and raw_type is not null) as raw_type from (select cast(record_id // 4 as varchar) as paper_id, * from r) group by paper_id), "
    f"w as (select paper_id, {_WON} filter (where field = 'title') as title, {_WON} filter (where field = 'year') as year, {_WON} filter (where field = 'venue') as venue from c group by paper_id), "
    "b as (select w.*, null::varchar as doi, null::varchar as arxiv_id, raw_type from w left join k on k.paper_id = w.paper_id), "
    f"t as ({_classify_sql().split(' as raw_type from b) ', 1)[1]}) "
    "select b.paper_id, b.title, try_cast(b.year as int) as year, case when e.source in ('human', 'tool:fix') then e.value else t.category end as category, case when e.source in ('human', 'tool:fix') then null else t.rule end as category_rule "
    "from b join t on t.paper_id = b.paper_id left join e on e.paper_id = b.paper_id".replace(" from t)", " from b)")
)
def resolve_fields(spark, root):
    """Merged fields and category of papers that were resolved and partly edited before."""
    r = latest_records(spark, root).withColumns({"paper_id": F.expr("cast(record_id div 4 as string)"), "doi": F.lit(None).cast("string"), "seq": F.col("record_id")})
    claims = _claims(spark, root)
    n = F.col("paper_id").cast("bigint") % 4
    old = claims.where(n < 3).select("paper_id").dropDuplicates().select(
        "paper_id", F.lit("category").alias("field"), F.when(n == 0, "thesis").when(n == 1, "book").otherwise("preprint").alias("value"), F.when(n == 0, "human").when(n == 1, "tool:fix").otherwise("derived").alias("source")
    )
    out = resolve.resolve(claims, r.select("paper_id", "source", "seq", "title", "authors", "doi", "year", "venue", "raw_type"), old)
    return out.select("paper_id", "title", "year", "category", "category_rule")


_INDEX = "x as (select paper_id, ord, title, short_name from sections qualify row_number() over (partition by paper_id, ord order by generated_at desc, title desc, coalesce(short_name, '') desc) = 1)"


def _index(spark: SparkSession, root: str) -> DataFrame:
    late = F.struct("generated_at", "title", F.coalesce("short_name", F.lit("")))
    return table(spark, root, "sections").groupBy("paper_id", "ord").agg(F.max_by(F.struct("title", "short_name"), late).alias("r")).select("paper_id", "ord", "r.*")


@query(f"with {_INDEX}, y as (select *, coalesce(nullif(short_name, ''), {_SLUG('title')}) as k from x), z as (select *, row_number() over (partition by paper_id, k order by ord) as nth from y) select paper_id, ord, case when short_name <> '' then short_name when nth = 1 then k else k || '_' || nth end as short_name from z")
def sections_backfill(spark, root):
    return surface.backfill_short_names(_index(spark, root)).select("paper_id", "ord", "short_name")


@query(
    f"with {_BIB}, {_INDEX}, h as (select paper_id, count(*) filter (where short_name = 'methods') as hit, count(*) filter (where short_name <> '') as n from x group by paper_id) "
    "select b.paper_id, name, case when name = 'summary' and b.paper_id < '8' then 'cached' when name = 'methods' and n > 0 and hit = 0 then 'missing-section' else 'never-run' end as status from b left join h on h.paper_id = b.paper_id cross join (values ('summary'), ('methods'), ('gist'), ('whole')) q(name)"
)
def distill_list(spark, root):
    b = latest_bib(spark, root)
    answers = b.where("paper_id < '8'").select("paper_id", F.lit("summary").alias("name"))
    return surface.list_questions(b, _asked(spark), answers, _index(spark, root), "default-model").select("paper_id", "name", "status")


@query(f"with {_CLAIMS}, w as (select distinct paper_id, field from c), p as (select distinct paper_id from c) select paper_id, t.field, 'unknown' as source from p cross join (values " + ", ".join(f"('{f}')" for f in surface.TRACKED) + ") t(field) where not exists (select 1 from w where w.paper_id = p.paper_id and w.field = t.field)")
def merge_unknown(spark, root):
    return surface.fill_unknown(merge.merge_claims(_claims(spark, root))).where("source = 'unknown'").select("paper_id", "field", "source")


@query(f"with {_MD} select paper_id, cast(length(md) as int) as chars, cast(greatest(length(md) - 3000, 0) as int) as rest from m")
def md_lengths(spark, root):
    return render.view_md(latest_md(spark, root)).select("paper_id", "chars", F.greatest(F.col("total_chars") - 3000, F.lit(0)).alias("rest"))
