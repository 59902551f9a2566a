"""Category of a publication: the first rule that fits, with the rule's name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: The lists of the rules, in the order in which they are tried.
PREPRINT_PREFIXES = ["10.1101", "10.26434", "10.31219", "10.2139", "10.21203"]
PREPRINT_HOSTS = ["biorxiv.org", "medrxiv.org", "chemrxiv.org", "ssrn.com", "osf.io/preprints", "researchsquare.com", "techrxiv.org"]
BOOK_TYPES = ["book-chapter", "book", "monograph", "edited-book"]
REPORT_TYPES = ["report", "report-component"]
THESIS_TYPES = ["dissertation"]
THESIS_VENUES = [r"\b(PhD|Ph\.D\.|MS|M\.S\.|Master'?s|Doctoral)\s+(Thesis|Dissertation)\b"]
REPORT_VENUES = ["Technical Report", r"Tech\. Rep\.", "Lab(oratory)? Report", "ANL-", "ORNL/TM-", "LA-UR-", r"SAND\d{4}", "LBNL-", "PNNL-", "NASA[/-]TM"]
WORKSHOP_VENUES = [r"\bWorkshop\b", r"\bWksp\b", r"\bWS\b"]
CONFERENCE_VENUES = ["^Proceedings of", r"\bConf\.\b", r"\bConference\b", r"\bSymposium\b"]
ACRONYMS = (
    "SC;PPoPP;HPDC;ICS;SOSP;OSDI;NSDI;EuroSys;ASPLOS;ISCA;MICRO;HPCA;FAST;ATC;USENIX Security;SIGMOD;VLDB;SIGCOMM;NeurIPS;NIPS;ICML;ICLR;AAAI;IJCAI;CVPR;ICCV;ECCV;ACL;EMNLP;NAACL;"
    "SIGGRAPH;VIS;IEEE VIS;IPDPS;Euro-Par;cluster;CCGrid;PACT;CGO;DAC;DATE;PLDI;POPL;OOPSLA;FSE;ICSE;ASE;ISSTA"
).split(";")
#: Types of sources and the category each stands for.
TYPE_MAP = {
    "journal-article": "journal article", "article": "journal article", "proceedings-article": "conference paper", "inproceedings": "conference paper", "posted-content": "preprint", "preprint": "preprint",
    "book-chapter": "book chapter", "incollection": "book chapter", "inbook": "book chapter", "book": "book", "monograph": "book", "dissertation": "thesis", "phdthesis": "thesis", "mastersthesis": "thesis",
    "report": "technical report", "techreport": "technical report",
}
CATEGORIES = ["journal article", "conference paper", "workshop paper", "arxiv preprint", "preprint", "book chapter", "book", "technical report", "thesis", "other"]


def _first(cases: list[tuple[Column, str, Column | str]]) -> Column:
    """struct(category, rule) of the first case that holds, else null."""
    out = F.lit(None)
    for holds, category, rule in reversed(cases):
        out = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(category).alias("category"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))).otherwise(out)
    return out


def category(doi: Column | str, arxiv_id: Column | str, venue: Column | str, raw_type: Column | str) -> Column:
    """struct(category, rule). Nulls count as empty; without any sign the category is ``other``."""
    doi, arxiv, venue = (F.coalesce(strip(c), F.lit("")) for c in (doi, arxiv_id, venue))
    doi, raw_type = F.lower(doi), col(raw_type)
    kind = F.lower(raw_type)
    named = F.concat(F.lit("crossref_type:"), raw_type)
    cases: list[tuple[Column, str, Column | str]] = [((arxiv != "") & ((doi == "") | doi.startswith("10.48550/arxiv")), "arxiv preprint", "arxiv_id:no-real-doi")]
    cases += [(doi.startswith(p), "preprint", f"preprint_doi_prefix:{p}") for p in PREPRINT_PREFIXES]
    cases += [(F.contains(F.lower(venue), F.lit(h)) | F.contains(doi, F.lit(h)), "preprint", f"preprint_host:{h}") for h in PREPRINT_HOSTS]
    cases += [(kind == t, "book chapter" if "chapter" in t else "book", named) for t in BOOK_TYPES]
    cases += [(kind == t, "technical report", named) for t in REPORT_TYPES] + [(kind == t, "thesis", named) for t in THESIS_TYPES]
    cases += [(venue.rlike(f"(?i){p}"), "thesis", f"thesis_venue_pattern:{p}") for p in THESIS_VENUES]
    cases += [(venue.rlike(f"(?i){p}"), "technical report", f"technical_report_venue_pattern:{p}") for p in REPORT_VENUES]
    cases += [(venue.rlike(f"(?i){p}"), "workshop paper", f"workshop_pattern:{p}") for p in WORKSHOP_VENUES]
    cases += [(venue.rlike(rf"(?<![A-Za-z]){re.escape(a)}(?![A-Za-z])"), "conference paper", f"conference_acronym:{a}") for a in ACRONYMS]
    cases += [(venue.rlike(f"(?i){p}"), "conference paper", f"conference_venue_pattern:{p}") for p in CONFERENCE_VENUES]
    cases += [(venue != "", "journal article", "derived:venue-present-no-conference-signal"), (F.lit(True), "other", "derived:no-rule-matched")]
    return _first(cases)


def type_category(raw_type: Column | str) -> Column:
    """The category that a source's type stands for, ``other`` if it stands for none."""
    known = F.create_map(*(F.lit(x) for pair in TYPE_MAP.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(col(raw_type))), F.lit("other"))
