"""Mapping freely typed values to the entries of a reference list.

Method: symmetric deletes. Every dictionary word is stored under all strings that deleting up to two of its letters
gives; a typed word is looked up by its own deletes, so no word is compared with the whole dictionary. Candidates are
ranked by weighted Damerau-Levenshtein distance, ties by how often the entry is typed exactly. Multi-word names match
word by word (typed abbreviations are prefixes of words), so a name that differs in a whole word stays unmatched.
The dictionary is made of the reference list alone: it is broadcast, and its size is that of the list.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

MISS = 0
#: How kinds of work are also called. A kind that is no entry and no alias is a miss, never `other`.
ALIASES = {
    "journal article": ["journal paper", "article in journal", "research article", "research article journal", "jnl article", "jnl paper", "article", "journal"],
    "conference paper": ["conf paper", "paper in conference proceedings", "proceedings article", "proceedings paper", "inproceedings", "paper conference", "conference article", "conference"],
    "workshop paper": ["workshop", "paper workshop", "wkshp paper", "workshop article"],
    "arxiv preprint": ["arxiv", "arxiv e print", "arxiv eprint", "arxiv pre print", "arxiv paper"],
    "preprint": ["pre print", "preprint not peer reviewed", "posted content", "e print"],
    "book chapter": ["chapter", "chapter in book", "chapter book", "bk chapter", "inbook", "incollection"],
    "book": ["monograph", "book whole", "whole book", "edited book"],
    "technical report": ["tech report", "tech rep", "techreport", "report technical", "report", "tr"],
    "thesis": ["phd thesis", "ph d thesis", "doctoral thesis", "dissertation", "phd dissertation", "ph d dissertation", "doctoral dissertation", "m sc thesis", "msc thesis", "masters thesis", "master s thesis", "phdthesis", "mastersthesis"],
    "other": ["misc", "miscellaneous"],
}
#: Abbreviations of words of venue names that are no prefixes of them, and words that names are compared without.
SHORTHAND = {"j": "journal", "jnl": "journal", "intl": "international", "int": "international", "natl": "national", "conf": "conference", "rept": "reports"}
LITTLE = frozenset("a an and for in of on the to".split())
_TAIL = re.compile(r"(?:[\s,]+vol(?:ume)?\.?\s*\d+|[\s,]+\d+\s*\(\d+\)|[\s,]*(?:['’]\d{2}|[-\s]?(?:19|20)\d{2})|\s*\([A-Z][A-Z .]{2,}\))\s*$")
_ORDINAL = re.compile(r"\(?\b\d+(?:st|nd|rd|th)\b\)?", re.I)


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    if text.isascii():
        return text.casefold()
    text = unicodedata.normalize("NFKD", text.translate({0xF8: "o", 0xD8: "O", 0x142: "l", 0x141: "L", 0xDF: "ss", 0x131: "i"}))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def deletes(word: str, most: int) -> Iterator[str]:
    """``word`` and all it can become when up to ``most`` letters are deleted."""
    n = len(word)
    for k in range(min(most, n - 1) + 1):
        for gone in combinations(range(n), k):
            at, kept = 0, []
            for g in gone:
                kept.append(word[at:g])
                at = g + 1
            yield "".join(kept) + word[at:]


def allowed(word: str) -> int:
    """How many edits a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def distance(a: str, b: str, most: float = 9.0) -> float:
    """Weighted Damerau-Levenshtein: swapped neighbours cost 0.7, a doubled letter 0.6, all else 1."""
    before, row = [], [float(j) for j in range(len(b) + 1)]
    for j in range(1, len(b) + 1):
        row[j] = row[j - 1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1)
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [before[0] + (0.6 if i > 1 and x == a[i - 2] else 1)]
        for j, y in enumerate(b, 1):
            best = before[j - 1] + (x != y)
            best = min(best, before[j] + (0.6 if i > 1 and x == a[i - 2] else 1), row[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 1))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 0.7)
            row.append(best)
        if min(row) > most:
            return most + 1
    return row[-1]


class Speller:
    """Words within a bounded edit distance, by symmetric deletes."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        self.under: dict[str, list[str]] = {}
        for word in sorted(self.words):
            for d in deletes(word, allowed(word)):
                self.under.setdefault(d, []).append(word)

    def near(self, typed: str) -> dict[str, float]:
        """Words and their distances; only the word itself if it is known."""
        if typed in self.words:
            return {typed: 0.0}
        most = allowed(typed)
        found = {w for d in deletes(typed, most) for w in self.under.get(d, ())} if most or typed in self.under else set()
        scored = {w: distance(typed, w, most) for w in found}
        return {w: d for w, d in scored.items() if d <= min(most, allowed(w) or 0)}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", fold(text))


class Names:
    """Multi-word names with codes: the list of venues."""

    def __init__(self, entries: Iterable[tuple[int, str, str | None]], used: dict[int, int]):
        self.used, self.codes, self.names, self.joined = used, {}, {}, {}
        vocabulary = set()
        for ref, name, code in entries:
            if code:
                self.codes[code.strip().upper()] = ref
            if name:
                content = tuple(w for w in words_of(name) if w not in LITTLE)
                self.names[content] = ref
                self.joined["".join(content)] = ref
                vocabulary |= set(content)
        self.speller, self.whole = Speller(vocabulary), Speller(self.joined)
        #: names by their length, a place in them and the word there
        self.at: dict[tuple[int, int, str], set[tuple[str, ...]]] = {}
        for content in self.names:
            for i, w in enumerate(content):
                self.at.setdefault((len(content), i, w), set()).add(content)
        self.prefixes: dict[str, set[str]] = {}
        for w in vocabulary:
            for n in range(3, len(w)):
                self.prefixes.setdefault(w[:n], set()).add(w)

    def word(self, typed: str) -> dict[str, float]:
        found = self.speller.near(typed)
        if 0.0 not in found.values():
            for w in self.prefixes.get(typed, ()):
                found[w] = min(0.3, found.get(w, 9))
            if (w := SHORTHAND.get(typed)) in self.speller.words:
                found[w] = 0.2
        return found

    def __call__(self, typed: str) -> int:
        text = typed.strip()
        while True:
            code = re.sub(r"[.\s]", "", text.strip("()[] ")).upper()
            if code in self.codes:
                return self.codes[code]
            cut = _TAIL.sub("", text).rstrip(" .,;")
            if cut == text:
                break
            text = cut
        text = re.sub(r"^\s*in:\s*", "", _ORDINAL.sub(" ", text), flags=re.I)
        best: tuple[float, int, int] | None = None
        for order in {text, " ".join(reversed(text.split(",", 1)))}:
            words = [w for w in words_of(order) if w not in LITTLE]
            options = [self.word(w) for w in words]
            if words and all(options):
                # names that have an option of each typed word at its place
                fits: set[tuple[str, ...]] | None = None
                for i, o in enumerate(options):
                    here = set().union(*(self.at.get((len(words), i, w), ()) for w in o))
                    fits = here if fits is None else fits & here
                    if not fits:
                        break
                for chosen in fits or ():
                    ref = self.names[chosen]
                    key = (sum(o[c] for o, c in zip(options, chosen)), -self.used.get(ref, 0), ref)
                    best = key if best is None else min(best, key)
            if best is None:
                for w, d in self.whole.near("".join(words)).items():
                    key = (d, -self.used.get(self.joined[w], 0), self.joined[w])
                    best = key if best is None else min(best, key)
        return best[2] if best else MISS


class Labels:
    """Short labels with aliases: the list of categories."""

    def __init__(self, entries: Iterable[tuple[int, str]], used: dict[int, int]):
        self.used, self.known = used, {}
        own = {" ".join(words_of(name)): ref for ref, name in entries if name}
        for name, ref in own.items():
            for alias in ALIASES.get(name, ()):
                self.known.setdefault(alias, ref)
        self.known |= own
        self.speller = Speller(self.known)

    def __call__(self, typed: str) -> int:
        label = " ".join(words_of(typed))
        near = self.speller.near(label)
        return min(((d, -self.used.get(self.known[w], 0), self.known[w]) for w, d in near.items()), default=(0, 0, MISS))[2]


def typed_exactly(bib: DataFrame, venues: DataFrame, categories: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How often each entry is typed exactly: one row per entry comes to the driver."""
    out = []
    for key, pairs, refs in (("venue_id", (("venue", "name"), ("venue_short", "short_name")), venues), ("category_id", (("category", "name"),), categories)):
        counts: dict[int, int] = {}
        for typed, name in pairs:
            entry = refs.select(key, F.col(name).alias("typed")).where("typed is not null").dropDuplicates()
            for r in bib.groupBy(F.col(typed).alias("typed")).count().join(F.broadcast(entry), "typed").groupBy(key).agg(F.sum("count").alias("n")).collect():
                counts[r[0]] = counts.get(r[0], 0) + r.n
        out.append(counts)
    return out[0], out[1]


def map_values(bib: DataFrame, venues: DataFrame, categories: DataFrame) -> DataFrame:
    """``paper_id, field, value, ref_id`` of every value of ``venue``, ``venue_short`` and ``category`` that is neither null nor blank.

    ``ref_id`` is the entry meant, or 0 where none is: such values are reported, not dropped. Repeated rows give
    repeated rows; ties go to the entry typed exactly more often, then to the smaller id. Null names or codes in the
    lists are never meant; empty lists leave all values unmatched; an empty table gives no rows. Rows are mapped where
    they are, without a shuffle, so a very frequent value costs nothing but its rows.
    """
    fields = ("venue", "venue_short", "category")
    used_venues, used_categories = typed_exactly(bib, venues, categories)
    # reference lists: fixed in size, the venues 240 rows and the categories 10
    lists = (
        [(r[0], r[1], r[2]) for r in venues.select("venue_id", "name", "short_name").collect()],
        [(r[0], r[1]) for r in categories.select("category_id", "name").collect()],
    )
    shared = bib.sparkSession.sparkContext.broadcast((*lists, used_venues, used_categories))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        venue_list, category_list, uv, uc = shared.value
        names, labels = Names(venue_list, uv), Labels(category_list, uc)
        known: dict[tuple[bool, str], int] = {}
        for batch in batches:
            papers, field, value, refs = [], [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for f, name in enumerate(fields, 1):
                ask = labels if name == "category" else names
                for paper, typed in zip(columns[0], columns[f]):
                    if typed is None or not typed.strip():
                        continue
                    key = (f == 3, typed)
                    if key not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[key] = ask(typed)
                    papers.append(paper), field.append(name), value.append(typed), refs.append(known[key])
            yield pa.RecordBatch.from_arrays([pa.array(papers, pa.string()), pa.array(field, pa.string()), pa.array(value, pa.string()), pa.array(refs, pa.int32())], names=["paper_id", "field", "value", "ref_id"])

    return bib.select("paper_id", *fields).mapInArrow(run, "paper_id string, field string, value string, ref_id int")


def _mapped(spark: SparkSession, root: str) -> DataFrame:
    return map_values(table(spark, root, "bib"), table(spark, root, "venues"), table(spark, root, "categories"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The entry that each venue, short venue and category of a paper means."""
    return _mapped(spark, root).select("paper_id", "field", "ref_id").dropDuplicates()


def p4_misses(spark: SparkSession, root: str) -> DataFrame:
    """Values that mean no entry, and in how many rows they stand."""
    return _mapped(spark, root).where(f"ref_id = {MISS}").groupBy("field", "value").agg(F.count("*").alias("rows"))
