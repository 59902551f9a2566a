"""Column expressions on text: normal forms, slugs, previews, headings, prompts and answers.

All work on code points, inside whole-stage code generation; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is no part of a word. Java's ``\w`` is narrower than letters, numbers and ``_``.
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Fixed value: headings that end the narrative of a paper.
BACK_MATTER = ["references", "bibliography", "acknowledgments", "acknowledgements", "funding", "author contributions", "conflict of interest", "generative ai statement", "publisher's note", "appendix", "supplementary"]
MARKER_LINE = r"^<!--\s*page\s+\d+\s*-->\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+\z", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and blank strings."""
    return F.coalesce(strip(c) == "", F.lit(True))


def normal_title(c: Column | str) -> Column:
    """Lower case, everything between words one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), NOT_WORD, " "))


def title_words(c: Column | str, most: int | None = None) -> Column:
    words = F.filter(F.split(normal_title(c), " "), lambda w: w != "")
    return words if most is None else F.slice(words, 1, most)


def slug(c: Column | str) -> Column:
    """Short name of a heading: number dropped, four words at most, ``section`` if nothing is left, ``s_`` before a digit."""
    bare = F.regexp_replace(strip(c), r"^\d+(\.\d+)*\s+", "")
    joined = F.regexp_replace(F.lower(bare), NOT_WORD, "_")
    words = F.slice(F.filter(F.split(joined, "_"), lambda w: w != ""), 1, 4)
    name = F.array_join(words, "_")
    return F.when(name == "", "section").when(name.rlike(r"^\p{Nd}"), F.concat(F.lit("s_"), name)).otherwise(name)


def preview(c: Column | str, width: int = 80) -> Column:
    """At most ``width`` characters; what is cut ends in three dots."""
    c = col(c)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c)


def list_preview(c: Column | str, shown: int = 3) -> Column:
    """The first elements joined by ``; `` and how many more there are."""
    c = col(c)
    head = F.array_join(F.slice(c, 1, shown), "; ")
    return F.when(F.size(c) > shown, F.concat(head, F.lit(" (+"), (F.size(c) - shown).cast("string"), F.lit(")"))).otherwise(head)


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def without_markers(c: Column | str) -> Column:
    """Text without the lines that are page markers."""
    return strip(F.array_join(F.filter(lines(c), lambda x: ~x.rlike(MARKER_LINE)), "\n"))


def narrative(c: Column | str, headings: list[str] = BACK_MATTER) -> Column:
    """Text before the first back-matter heading, without page markers."""
    each = lines(c)
    name = lambda x: F.regexp_replace(F.lower(strip(F.regexp_replace(strip(x), r"^#+\s*", ""))), r":+$", "")
    stops = F.transform(each, lambda x: strip(x).startswith("#") & name(x).isin(headings))
    at = F.array_position(stops, True)
    return without_markers(F.array_join(F.when(at > 0, F.slice(each, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(each), "\n"))


def without_fence(c: Column | str) -> Column:
    """An answer without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[ \t]*(?:json|JSON|markdown|md|text)?[ \t]*\r?\n?", ""), r"\s*```\z", ""))


def post_process(c: Column | str, most: Column | int) -> Column:
    """struct(text, truncated, original_length): an answer cut to ``most`` characters at a space in its last fifth, ends of lines trimmed."""
    c, most = col(c), F.lit(most) if isinstance(most, int) else most
    cut = F.substring(c, F.lit(1), most)
    back = F.locate(" ", F.reverse(cut))
    at = F.length(cut) - back
    at_space = F.when((back > 0) & (at > most * 0.8), F.substring(cut, F.lit(1), at)).otherwise(cut)
    long = F.coalesce((most > 0) & (F.length(c) > most), F.lit(False))
    body = F.when(long, F.concat(F.regexp_replace(at_space, r"(?U)\s+\z", ""), F.lit("…"))).otherwise(c)
    trimmed = strip(F.array_join(F.transform(lines(body), lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")), "\n"))
    return F.struct(trimmed.alias("text"), long.alias("truncated"), F.when(long, F.length(c)).alias("original_length"))


def prompt(question: Column | str, content: Column | str, most: Column | str) -> Column:
    """Question, length limit if there is one, a rule and the content, joined by blank lines."""
    limit = F.when(col(most) > 0, F.format_string("Your response MUST be at most %d characters. Be concise.", col(most)))
    return F.concat_ws("\n\n", strip(question), limit, F.lit("\n---\n"), col(content))


def tokens_estimate(c: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(col(c)) / 4).cast("int")


def author_line(c: Column | str) -> Column:
    """Up to three authors, else the first and ``et al.``."""
    c = col(c)
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "").when(F.size(c) <= 3, F.array_join(c, ", ")).otherwise(F.concat(F.get(c, F.lit(0)), F.lit(" et al.")))


def venue_year_line(venue: Column | str, year: Column | str) -> Column:
    return F.concat_ws(" · ", F.when(col(venue) != "", col(venue)), F.when(col(year) != 0, col(year).cast("string")))


def bib_header(title: Column | str, authors: Column | str, venue: Column | str, year: Column | str) -> Column:
    """What precedes the content of a question on a paper: title, up to five authors, venue and year, where known."""
    authors = col(authors)
    names = F.concat(F.array_join(F.slice(authors, 1, 5), ", "), F.when(F.size(authors) > 5, " et al.").otherwise(""))
    known = lambda label, c, empty: F.when(c != empty, F.concat(F.lit(f"{label}: "), c.cast("string")))
    return F.concat_ws("\n", known("Title", col(title), ""), F.when(F.size(authors) > 0, F.concat(F.lit("Authors: "), names)), known("Venue", col(venue), ""), known("Year", col(year), 0))


def joined_or_null(c: Column | str) -> Column:
    """Captions or notes joined by line; null if all are blank."""
    joined = F.array_join(F.filter(col(c), lambda x: ~is_blank(x)), "\n")
    return F.when(joined != "", joined)
