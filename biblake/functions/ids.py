"""Column expressions on identifiers, names and dates of publications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WORD, col, strip

#: Where a DOI and arXiv identifiers stand in running text.
DOI = r"""(?i)(?:https?://doi\.org/|doi:\s*)(10\.\d{4,9}/[^\s,;"'<>]+)|(?<![\p{L}\p{N}_])(10\.\d{4,9}/[-._;()/:A-Z0-9]+)(?![\p{L}\p{N}_])"""
ARXIV_NEW, ARXIV_OLD = r"(?<![\p{L}\p{N}_])(\d{4}\.\d{4,5})(?:v\d+)?(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_])([a-z\-]+/\d{7})(?:v\d+)?(?![\p{L}\p{N}_])"
#: Months as they are looked for, in this order.
MONTHS = [("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("may", 5), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("oct", 10), ("nov", 11), ("dec", 12)]
SMALL_WORDS = ["a", "an", "the", "of", "in", "on", "for", "with", "and", "or"]


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_doi(c: Column | str) -> Column:
    """Bare, lower-case DOI; null for none."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^https?://doi\.org/", ""), r"(?i)^doi:\s*", "")
    return null_if_empty(F.regexp_replace(F.lower(bare), r"[.,);]+\z", ""))


def is_arxiv_doi(c: Column | str) -> Column:
    return F.coalesce(normalize_doi(c).startswith("10.48550/arxiv"), F.lit(False))


def extract_doi(c: Column | str) -> Column:
    """The first DOI of a text, normalised."""
    found = F.coalesce(null_if_empty(F.regexp_extract(col(c), DOI, 1)), null_if_empty(F.regexp_extract(col(c), DOI, 2)))
    return normalize_doi(found)


def bare_arxiv(c: Column | str) -> Column:
    """An arXiv id without its version."""
    return F.regexp_replace(col(c), r"v\d+\z", "")


def extract_arxiv_id(text: Column | str, filename: Column | str) -> Column:
    """The first arXiv id of the file name, else of the text; new numbers before old ones, versions dropped."""
    return F.coalesce(*(null_if_empty(F.regexp_extract(col(c), p, 1)) for c in (filename, text) for p in (ARXIV_NEW, ARXIV_OLD)))


def surname(name: Column | str) -> Column:
    """Before the comma, else the last word; lower case."""
    name = strip(name)
    return F.lower(F.when(F.contains(name, F.lit(",")), F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(name, r"\s+"), -1)))


def first_surname(authors: Column | str) -> Column:
    return surname(F.get(col(authors), F.lit(0)))


def bibtex_authors(c: Column | str) -> Column:
    """Names of a BibTeX author field."""
    return F.filter(F.transform(F.split(col(c), r"(?i)\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


def bibtex_date(c: Column | str) -> Column:
    """``YYYY-MM`` if a month's name stands beside the year, else ``YYYY``; null without a year."""
    year = null_if_empty(F.regexp_extract(col(c), r"\b((?:19|20)\d{2})\b", 1))
    month = F.coalesce(*(F.when(F.contains(F.lower(col(c)), F.lit(m)), F.lit(f"-{n:02d}")) for m, n in MONTHS), F.lit(""))
    return F.concat(year, month)


def bibtex_key(authors: Column | str, year: Column | str, title: Column | str) -> Column:
    """Surname of the first author, year and first significant word of the title; null without authors or year."""
    last = F.lower(F.element_at(F.split(strip(F.get(col(authors), F.lit(0))), r"\s+"), -1))
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"[^\p{L}\p{N}_\s]+", " "), r"\s+"), lambda w: w.rlike(r"^\p{L}+$") & ~w.isin(SMALL_WORDS))
    named = F.concat(F.when(last != "", last).otherwise("unknown"), col(year).cast("string"), F.coalesce(F.get(words, F.lit(0)), F.lit("paper")))
    return F.when((F.size(col(authors)) > 0) & (col(year) != 0), named)


def partial_date(parts: Column | str) -> Column:
    """``YYYY[-MM[-DD]]`` of date parts."""
    p = col(parts)
    piece = lambda i: F.get(p, F.lit(i))
    return F.when(F.size(p) >= 3, F.format_string("%d-%02d-%02d", piece(0), piece(1), piece(2))).when(F.size(p) == 2, F.format_string("%d-%02d", piece(0), piece(1))).when(F.size(p) == 1, piece(0).cast("string"))


def valid_doi(c: Column | str) -> Column:
    return col(c).rlike(r"^10\.\d{4,}/\S+$")


def valid_arxiv(c: Column | str) -> Column:
    return col(c).rlike(r"^\d{4}\.\d{4,5}(v\d+)?$|^[a-z\-]+/\d{7}(v\d+)?$")


def affiliation_cut(c: Column | str) -> Column:
    """A name without the bracketed affiliation behind it."""
    return F.trim(F.substring_index(col(c), "[", 1))


__all__ = ["NOT_WORD", *(n for n, v in list(globals().items()) if callable(v) and not n.startswith("_"))]
