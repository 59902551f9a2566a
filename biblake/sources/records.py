"""Records of outside bibliographic sources: projections of their JSON, and lookups in snapshots of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.ids import affiliation_cut, bare_arxiv, is_arxiv_doi, normalize_doi, null_if_empty, partial_date
from ..functions.similarity import may_match, ratio

#: Titles a side that meet at once.
CELL = 4096
#: What is read of each source's JSON.
SCHEMAS = {
    "openalex": "display_name string, type string, doi string, publication_year int, publication_date string, id string, primary_location struct<source: struct<display_name: string>, landing_page_url: string>, "
    "authorships array<struct<author: struct<display_name: string>>>, keywords array<struct<display_name: string>>, open_access struct<oa_status: string>, abstract_inverted_index map<string, array<int>>, language string",
    "crossref": "type string, DOI string, title array<string>, `container-title` array<string>, publisher string, author array<struct<given: string, family: string>>, published struct<`date-parts`: array<array<int>>>, "
    "`published-print` struct<`date-parts`: array<array<int>>>, `published-online` struct<`date-parts`: array<array<int>>>, created struct<`date-parts`: array<array<int>>>, URL string, abstract string, ISSN array<string>, ISBN array<string>",
    "osti": "osti_id string, doi string, title string, authors array<string>, publication_date string, journal_name string, publisher string, links array<struct<rel: string, href: string>>",
    "dblp": "info struct<title: string, type: string, year: string, venue: string, doi: string, ee: string, url: string, authors: struct<author: string>>",
    "arxiv": "id string, title string, summary string, published string, author array<struct<name: string>>",
    "semanticscholar": "title string, authors array<struct<name: string>>, year int, publicationDate string, venue string, externalIds struct<DOI: string, ArXiv: string>, abstract string, openAccessPdf struct<url: string>, publicationTypes array<string>",
}


def filled(array: Column) -> Column:
    return F.filter(array, lambda x: F.coalesce(x != "", F.lit(False)))


def openalex(r: Column) -> dict[str, Column]:
    words = F.flatten(F.transform(F.map_entries(r["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    ordered = F.array_sort(words)
    # of words at one place the last counts
    kept = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["at"] != x["at"], F.lit(True)))
    doi = normalize_doi(r["doi"])
    return {
        "title": r["display_name"], "authors": filled(F.transform(r["authorships"], lambda a: a["author"]["display_name"])), "year": r["publication_year"], "publication_date": r["publication_date"],
        "venue": r["primary_location"]["source"]["display_name"], "doi": F.when(~is_arxiv_doi(r["doi"]), doi), "url": F.coalesce(r["primary_location"]["landing_page_url"], r["id"]),
        "abstract": null_if_empty(F.array_join(F.transform(kept, lambda x: x["word"]), " ")), "keywords": filled(F.transform(r["keywords"], lambda k: k["display_name"])), "oa_status": r["open_access"]["oa_status"], "raw_type": r["type"],
    }


def crossref(r: Column) -> dict[str, Column]:
    dates = [F.get(r[k]["date-parts"], F.lit(0)) for k in ("published", "published-print", "published-online", "created")]
    first = F.coalesce(*(F.when(F.get(d, F.lit(0)).isNotNull(), d) for d in dates))
    names = F.transform(r["author"], lambda a: F.when((a["given"] != "") & (a["family"] != ""), F.concat(a["given"], F.lit(" "), a["family"])).otherwise(a["family"]))
    doi = normalize_doi(r["DOI"])
    return {
        "title": F.get(r["title"], F.lit(0)), "authors": filled(names), "year": F.get(first, F.lit(0)), "publication_date": partial_date(first), "venue": F.coalesce(null_if_empty(F.get(r["container-title"], F.lit(0))), r["publisher"]),
        "doi": doi, "url": F.coalesce(r["URL"], F.concat(F.lit("https://doi.org/"), doi)), "abstract": null_if_empty(F.trim(F.regexp_replace(r["abstract"], "<[^>]+>", " "))),
        "issn": F.get(r["ISSN"], F.lit(0)), "isbn": F.get(r["ISBN"], F.lit(0)), "raw_type": r["type"],
    }


def osti(r: Column) -> dict[str, Column]:
    whole = lambda a: F.coalesce(null_if_empty(F.get_json_object(a, "$.name")), null_if_empty(F.trim(F.concat_ws(" ", F.get_json_object(a, "$.first_name"), F.get_json_object(a, "$.last_name")))))
    names = F.transform(r["authors"], lambda a: F.when(F.startswith(a, F.lit("{")), whole(a)).otherwise(affiliation_cut(a)))
    link = F.get(F.filter(r["links"], lambda x: x["rel"] == "citation"), F.lit(0))["href"]
    return {
        "title": r["title"], "authors": filled(names), "year": F.left(r["publication_date"], F.lit(4)).try_cast("int"), "publication_date": r["publication_date"], "venue": F.coalesce(null_if_empty(r["journal_name"]), null_if_empty(r["publisher"])),
        "doi": normalize_doi(r["doi"]), "osti_id": r["osti_id"], "url": F.coalesce(link, F.concat(F.lit("https://www.osti.gov/biblio/"), r["osti_id"])),
    }


def dblp(r: Column) -> dict[str, Column]:
    # one author is an object or a string, several are a list of them
    raw = r["info"]["authors"]["author"]
    items = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    names = F.transform(items, lambda a: F.regexp_replace(F.when(F.startswith(a, F.lit("{")), F.get_json_object(a, "$.text")).otherwise(a), r"\s\d{4}$", ""))
    i = r["info"]
    return {"title": F.regexp_replace(i["title"], r"\.$", ""), "authors": filled(names), "year": i["year"].try_cast("int"), "venue": i["venue"], "doi": normalize_doi(i["doi"]), "url": F.coalesce(i["ee"], i["url"]), "raw_type": i["type"]}


def arxiv(r: Column) -> dict[str, Column]:
    one_line = lambda c: F.trim(F.regexp_replace(c, r"\s*\n\s*", " "))
    return {
        "title": one_line(r["title"]), "authors": filled(F.transform(r["author"], lambda a: a["name"])), "year": F.left(r["published"], F.lit(4)).try_cast("int"), "publication_date": F.left(r["published"], F.lit(10)),
        "abstract": one_line(r["summary"]), "arxiv_id": bare_arxiv(F.substring_index(r["id"], "/abs/", -1)), "url": r["id"],
    }


def semanticscholar(r: Column) -> dict[str, Column]:
    kind = F.when(F.array_contains(r["publicationTypes"], "JournalArticle"), "journal-article").when(F.array_contains(r["publicationTypes"], "Conference"), "proceedings-article")
    return {
        "title": r["title"], "authors": filled(F.transform(r["authors"], lambda a: a["name"])), "year": r["year"], "publication_date": r["publicationDate"], "venue": null_if_empty(r["venue"]),
        "doi": normalize_doi(r["externalIds"]["DOI"]), "arxiv_id": r["externalIds"]["ArXiv"], "abstract": r["abstract"], "url": r["openAccessPdf"]["url"], "raw_type": kind,
    }


PROJECTIONS = {f.__name__: f for f in (openalex, crossref, osti, dblp, arxiv, semanticscholar)}


def project(raw: DataFrame, source: str, column: str = "json") -> DataFrame:
    """Other columns of ``raw`` and the record of a source's JSON text; what can't be read becomes nulls."""
    r = raw.withColumn("_r", F.from_json(column, SCHEMAS[source]))
    return r.select(*(c for c in raw.columns if c != column), *(c.alias(n) for n, c in PROJECTIONS[source](F.col("_r")).items()))


def lookup_by(papers: DataFrame, records: DataFrame, key: str, normal=normalize_doi) -> DataFrame:
    """Papers with the record of equal identifier (``rec``), null if there is none; of several the first by content. Similarity is 1."""
    named = records.withColumn("_k", normal(F.col(key))).where("_k is not null")
    one = named.groupBy("_k").agg(F.min(F.struct(*(c for c in records.columns))).alias("rec"))
    return papers.withColumn("_k", normal(F.col(key))).join(one, "_k", "left").drop("_k").withColumn("sim", F.when(F.col("rec").isNotNull(), F.lit(1.0)))


def fuzzy_top1(papers: DataFrame, records: DataFrame, least: float = 0.9, most: int = 5) -> DataFrame:
    """``paper_id, record_id, sim``: the most alike title, if it reaches ``least``.

    papers: ``paper_id, title, year``; records: ``record_id, title, year``. Where the paper has a year, it is the
    record's. No pair that could reach ``least`` is lost: titles of a year meet in cells of bounded size, where pairs of
    lengths and letter pairs that can't reach it (``similarity.may_match``) are left out and the others are compared.
    Each cell gives a paper's ``most`` most alike records. Ties go to the smaller id.
    """
    p, r = (df.where("title is not null").select(F.col(key).alias("id"), "title", F.col("year").cast("int").alias("year")) for df, key in ((papers, "paper_id"), (records, "record_id")))
    schema = StructType([StructField("paper_id", papers.schema["paper_id"].dataType), StructField("record_id", records.schema["record_id"].dataType), StructField("sim", DoubleType())])

    def meet(p: DataFrame, r: DataFrame, year: bool) -> DataFrame:
        """Every p with every r, of the same year or of any: in cells of about ``CELL`` rows a side."""
        on = ["year"] if year else []
        rows = lambda df: (df.groupBy(*on).count() if on else df.select(F.count("*").alias("count"))).agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        n, m = (max(1, -(-rows(df) // CELL)) for df in (p, r))
        at = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
        each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        left = p.select("id", "title", *on, at(n).alias("i")).withColumn("j", each(m))
        right = r.select("id", "title", *on, at(m).alias("j")).withColumn("i", each(n))
        return left.groupBy(*on, "i", "j").cogroup(right.groupBy(*on, "i", "j")).applyInArrow(lambda a, b: _alike(a, b, least, most, schema), schema)

    near = meet(p.where("year is not null"), r.where("year is not null"), True).unionAll(meet(p.where("year is null"), r, False))
    best = near.groupBy("paper_id").agg(F.min(F.struct((-F.col("sim")).alias("less"), "record_id")).alias("b"))
    return best.select("paper_id", "b.record_id", F.round(-F.col("b.less"), 4).alias("sim")).where(F.col("sim") >= least)


def _alike(a: pa.Table, b: pa.Table, least: float, most: int, schema: StructType) -> pa.Table:
    """The ``most`` most alike of the titles ``b`` for each of ``a``."""
    out = []
    p, r = ((t.column("id").to_pylist(), t.column("title").to_pylist()) for t in (a, b))
    for i, near in enumerate(may_match(p[1], r[1], least - 1e-4)):  # the similarity is rounded to four digits
        sims = sorted((-ratio(p[1][i], r[1][j]), r[0][j]) for j in near)
        out += [(p[0][i], record, -s) for s, record in sims[:most]]
    kinds = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(kinds)], schema=kinds)


def by_title(papers: DataFrame, records: DataFrame, least: float = 0.9, kind: str = "title", strict: bool = False) -> DataFrame:
    """``paper_id, rec, kind, sim``: the record of the most alike title, null where none reaches ``least`` (``strict``: exceeds it).

    papers: ``paper_id, title, year``; records: any columns, ``title`` and ``year`` among them. A record is known by its
    content, so equal records count once.
    """
    told = records.withColumn("record_id", F.xxhash64(*records.columns))
    near = fuzzy_top1(papers.select("paper_id", "title", "year"), told.select("record_id", "title", "year"), least)
    near = near.where(F.col("sim") > least) if strict else near
    held = told.groupBy("record_id").agg(F.min(F.struct(*records.columns)).alias("rec"))
    found = papers.select("paper_id").join(near.join(held, "record_id"), "paper_id", "left")
    return found.select("paper_id", "rec", F.when(F.col("rec").isNotNull(), F.lit(kind)).alias("kind"), "sim")


def lookup_bibtex(papers: DataFrame, entries: DataFrame, least: float = 0.85) -> DataFrame:
    """``paper_id, rec, kind, sim``: a paper's entry in a BibTeX file, by DOI, else by a title of at least ``least``."""
    first = lookup_by(papers, entries, "doi")
    found = first.where("rec is not null").select("paper_id", "rec", F.lit("doi").alias("kind"), "sim")
    return found.unionByName(by_title(first.where("rec is null").drop("rec", "sim"), entries, least))


def cascade(papers: DataFrame, records: DataFrame, titles: bool = False, least: float = 0.9) -> DataFrame:
    """``paper_id, rec, kind, sim``: by DOI, else by arXiv id, else, with ``titles``, by title. A lookup sees only what those before left."""
    by_doi = lookup_by(papers, records, "doi")
    found = by_doi.where("rec is not null").select("paper_id", "rec", F.lit("doi").alias("kind"), "sim")
    rest = lookup_by(by_doi.where("rec is null").drop("rec", "sim"), records, "arxiv_id", lambda c: null_if_empty(bare_arxiv(c)))
    second = rest.select("paper_id", "rec", F.when(F.col("rec").isNotNull(), F.lit("arxiv")).alias("kind"), "sim")
    if not titles:
        return found.unionByName(second)
    left = rest.where("rec is null").drop("rec", "sim")
    return found.unionByName(second.where("rec is not null")).unionByName(by_title(left, records, least))
