"""Matching papers with outside records that share no identifier.

Method: cross-table retrieval with an inverted index. Rows become sets of terms over all attributes: title words, authors'
surnames, numbers of parts, the year. Rare terms that are one slip away from a frequent one count as that one. Papers are
ranked for each record by BM25; a paper is retrieved if the terms in common carry at least ``COVER`` of the weight of
the record. That bound prunes exactly: of a record's terms, from the rarest on, so many are opened that what is left can't
reach it, so a paper that shares none of these needn't be looked at. Short lists are opened alone; of long ones two,
three or four are opened together, since a paper must share as many of the opened terms as the bound demands; a long
list whose terms alone reach the bound is opened as it is. What is found by the opened lists, and a signature of each
paper's terms, bound its score from below and above, and only papers that can still be retrieved are scored in full.
They are ranked after checks of numbers, titles and authors, so that what fails these takes no place among the best.

A record goes to its best paper if the record is also near the paper's best one; the confidence is a logistic function
of the share in common and of its gap to the second best paper. It is calibrated on the venues, which retrieval doesn't see.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, table
from .canonical import fold
from .names import PARTICLES, parse

#: A term weighs at most as much as one in a row of ``HOT``; BM25's saturation and length parameters, and the range of lengths
#: (in mean lengths) that counts.
HOT, K1, B, LENGTHS = 1000, 1.2, 0.3, (0.25, 2.0)
#: Share of a record's weight that a paper must have in common; papers kept per record (a match is told by the first two, the
#: others only teach the calibration).
COVER, TOP = 0.55, 5
#: Lists of at most so many papers are opened alone; lists of several terms with more are opened with one more term, or
#: as they are where they must be. What such a list finds for a record is pruned in so many parts.
SHORT, LONG, DEEPEST, PARTS = 30, 100, 4, 64
#: Lists are counted in so many buckets (a fixed size); a full bucket only means that a term more is looked at.
BUCKETS = 1 << 22
#: How many times as frequent the term is that a rare one may be a slip of.
RATIO = 8
#: Rows the calibration is fitted on, at most.
SAMPLE = 20_000
#: Words that titles are compared without.
LITTLE = frozenset("a an the of for and in on with from to by at as is are their its or".split())
#: Stands for authors that are not listed.
MORE = "*"
_TAGS, _NOTE = re.compile(r"<[^>]{1,20}>"), re.compile(r"\((?:preprint|extended abstract|draft|accepted manuscript)\)", re.I)
_SUBTITLE = re.compile(r"\s*[:.–—‐-]\s+|\s+[:–—‐-]\s*")
_PART = re.compile(r"\b(?:part|pt|vol|volume|no)\b\.?\s*([ivxl]+|\d+)\b")
_NUMERAL = re.compile(r"[ivxl]+|\d+")


def title_terms(title: str | None) -> tuple[list[str], list[str], list[str]]:
    """Words of a title, words of its main part (before a subtitle), and its numbers: parts and years of a series."""
    text = _NOTE.sub(" ", _TAGS.sub(" ", html.unescape(title or "")))
    plain = fold(text)
    words = re.findall(r"[^\W_]+", plain)
    numbers = sorted({*(m[1] for m in _PART.finditer(plain)), *(w for w in words if w.isdigit()), *(w for w in words[-1:] if re.fullmatch("[ivx]{2,}", w))})
    drop = LITTLE | set(numbers) | {"part", "pt"}
    content = list(dict.fromkeys(w for w in words if w not in drop))
    main = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", _SUBTITLE.split(plain.strip(), maxsplit=1)[0]) if w not in drop))
    return content, main if len(main) < len(content) else [], numbers


def surnames(authors: list[str | None] | None) -> list[str]:
    """Folded surnames, particles and marks left out; a collaboration's name counts as one."""
    out = []
    for name in authors or ():
        if not name or not name.strip():
            continue
        if re.fullmatch(r"\W*(?:et al|and others)\W*", name.strip(), re.I):
            out.append(MORE)
            continue
        _, left, _, _ = parse(name)
        full = [w for w in left if w not in PARTICLES and len(w) > 1]
        if full:
            last = full[-1] if not (len(left[-1]) == 1 and len(left) > 1) else full[0]
            out.append(last.replace("-", ""))
    return list(dict.fromkeys(out))


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffled by keys into as many partitions as the session asks for: what Python does next must not be coalesced by bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tuples(column: pa.Array, *fields: str) -> Iterator[list[tuple]]:
    """Each row's structs as tuples of the fields, without a dictionary for each."""
    flat, ends = column.flatten(), column.offsets.to_pylist()
    values = [flat.field(f).to_pylist() for f in fields]
    for a, b in zip(ends, ends[1:]):
        yield list(zip(*(v[a - ends[0] : b - ends[0]] for v in values)))


def prepared(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """``id, venue, terms`` of the latest row of each id; nulls give no terms, a year missing is read from the date.

    Terms begin with a letter that says what they are: t word of the title, a surname, n number in the title, y year.
    """
    year = F.coalesce("year", F.expr("try_cast(regexp_extract(publication_date, '^(\\d{4})', 1) as int)"))
    venue = F.col("venue") if "venue" in df.columns else F.lit(None).cast("string")
    some = df.where(F.col(key).isNotNull()).withColumns({"id": F.col(key).cast("string"), "year": year, "venue": venue}).select("id", "title", "authors", "year", "venue", F.col(stamp).alias("stamp"))
    latest = wide(some, "id").groupBy("id").agg(F.max_by(F.struct("title", "authors", "year", "venue"), F.struct("stamp", F.xxhash64("title", "authors"))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, names, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                words, _, numbers = title_terms(t)
                out.append([*("t" + w for w in words), *("n" + n for n in numbers), *("a" + a for a in surnames(names) if a != MORE), *([f"y{y}"] if y is not None else [])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["id", "venue", "terms"])

    plain = F.regexp_replace(F.lower("r.venue"), r"[^\p{L}]+", "").alias("venue")
    return materialize(latest.select("id", plain, "r.title", "r.authors", "r.year").mapInArrow(run, "id string, venue string, terms array<string>"))


def vocabulary(papers: DataFrame, records: DataFrame, total: int) -> DataFrame:
    """``term, h, w, df``: the hash and weight of what each term counts as, and in how many papers that is.

    A rare word or surname that is one slip (a letter lost, added, changed, or two swapped) away from one ``RATIO`` times
    as frequent counts as that one. Found by symmetric deletes of one letter, joined; nothing is broadcast.
    """
    side = lambda x, n: x.select(F.explode("terms").alias("term"), F.lit(n).alias("p"))
    known = materialize(side(papers, 1).unionAll(side(records, 0)).groupBy("term").agg(F.count("*").alias("n"), F.sum("p").alias("df")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, at = [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                if len(t) >= 6 and t[0] in "ta":
                    mine = {t, *(t[:k] + t[k + 1 :] for k in range(1, len(t)))}
                    cut += mine
                    at += [i] * len(mine)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), batch.column(0).take(rows), batch.column(1).take(rows)], names=["cut", "term", "n"])

    cuts = known.select("term", "n").mapInArrow(run, "cut string, term string, n bigint")
    a, b = cuts.select("cut", "term", "n"), cuts.select("cut", F.col("term").alias("to"), F.col("n").alias("m"))
    swapped = (F.length("term") == F.length("to")) & (F.array_sort(F.split("term", "")) == F.array_sort(F.split("to", "")))
    near = a.join(b, "cut").where(f"m >= {RATIO} * n").where((F.levenshtein("term", "to", 1) >= 0) | (swapped & (F.levenshtein("term", "to", 2) >= 0)))
    fixed = materialize(near.groupBy("term").agg(F.max_by("to", F.struct("m", "to")).alias("to")))
    again = fixed.select(F.col("term").alias("to"), F.col("to").alias("then"))  # a slip of a slip
    meant = known.join(fixed, "term", "left").join(again, "to", "left").select("term", F.coalesce("then", "to", "term").alias("meant"), "df")
    counts = meant.groupBy("meant").agg(F.sum("df").alias("df"))
    idf = F.least(F.log1p(F.lit(float(HOT))), F.log1p((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # the last two bits say what the term is
    kind = F.expr("shiftleft(shiftright(xxhash64(meant), 2), 2) + case left(meant, 1) when 't' then 0 when 'a' then 1 when 'n' then 2 else 3 end")
    return materialize(meant.select("term", "meant").join(counts, "meant").select("term", kind.alias("h"), idf.alias("w"), "df"))


def indexed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``at, id, venue, terms, total``: terms as (df, h, w), the rarest first; total: their weight, of unknown ones too. ``at`` is a hash of the id."""
    each = rows.select("id", F.explode("terms").alias("term")).join(words, "term")
    sets = each.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("df", "h", "w"))).alias("terms"))
    return materialize(rows.select("id", "venue").join(sets, "id").select(F.xxhash64("id").alias("at"), "id", "venue", "terms", weight("terms").alias("total")))


def weight(terms: Column | str) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["w"])


def without_authors(rows: DataFrame) -> DataFrame:
    """The rows with all terms but authors, for papers that list none."""
    rest = F.filter("terms", lambda t: t["h"].bitwiseAND(3) != 1)
    return rows.withColumn("terms", rest).withColumn("total", weight("terms"))


class Opener:
    """Which lists are opened for a record, and in which lists a paper stands; lists are of one term or of several."""

    def __init__(self, full: list[np.ndarray], whole: np.ndarray | None = None):
        #: by number of terms from two on: buckets whose lists are too long; buckets of long lists that are opened nevertheless
        self.full, self.whole = full, whole

    def wanted(self, key: int) -> bool:
        return self.whole is not None and bool(self.whole[key & (BUCKETS - 1)])

    def long(self, key: int, terms: int) -> bool:
        return terms < DEEPEST and terms - 2 < len(self.full) and bool(self.full[terms - 2][key & (BUCKETS - 1)])

    @staticmethod
    def key(terms: tuple[int, ...], variant: int) -> int:
        return hash((variant, *terms)) if variant or len(terms) > 1 else terms[0]

    def grown(self, sets: set[tuple[int, ...]], more: list[int]) -> set[tuple[int, ...]]:
        return {tuple(sorted((*s, t))) for s in sets for t in more if t not in s}

    def paper(self, terms: list[tuple[int, int]], variant: int) -> list[int]:
        """Keys of the lists that a paper with terms (df, h) stands in."""
        out = [self.key((h,), variant) for df, h in terms if df <= SHORT]
        many = sorted(h for df, h in terms if df > SHORT)
        out += [k for k in (self.key((h,), variant) for h in many) if self.wanted(k)]
        sets = set(combinations(many, 2))
        for n in range(2, DEEPEST + 1):
            keys = {s: self.key(s, variant) for s in sets}
            sets = {s for s, k in keys.items() if self.long(k, n)}
            out += [k for s, k in keys.items() if s not in sets or self.wanted(k)]
            if not sets:
                break
            sets = self.grown(sets, many)
        return out

    def counted(self, terms: list[tuple[int, int]], variant: int, n: int) -> list[int]:
        """Keys of ``n`` terms of a paper, whether or not their lists are too long."""
        many = sorted(h for df, h in terms if df > SHORT)
        sets = set(combinations(many, 2))
        for k in range(2, n):
            sets = self.grown({s for s in sets if self.long(self.key(s, variant), k)}, many)
        return [self.key(s, variant) for s in sets]

    @staticmethod
    def opened(terms: list[tuple[int, int, float]], least: float, n: int) -> int:
        """How many terms are opened so that a paper with less than ``n`` of these carries less than ``least``."""
        left, most, k = sum(w for df, _, w in terms if df), 0.0, 0
        for df, _, w in terms:
            if left + (n - 1) * most < least:
                break
            if df:
                left, most = left - w, max(most, w)
            k += 1
        return k

    def record(self, terms: list[tuple[int, int, float]], variant: int, least: float) -> tuple[list[tuple[int, int]], list[int], int, int, int]:
        """Lists opened for a record with terms (df, h, w): (key, its terms as bits), the keys of long ones, and bits of: lists of one term opened, long ones opened first, long ones then told."""
        place = {h: i for i, (_, h, _) in enumerate(terms)}
        weights = {h: w for _, h, w in terms}
        bits = lambda hs: sum(1 << place[h] for h in hs if place[h] < 62)
        # a paper may have these terms and no other in common
        heavy = lambda hs: sum(weights[h] for h in hs) >= least
        if sum(w for df, _, w in terms if df) < least:
            return [], [], 0, 0, 0
        first = terms[: self.opened(terms, least, 1)]
        alone = [h for df, h, _ in first if df and (df <= SHORT or heavy([h]))]
        start = [h for df, h, _ in first if df > SHORT and not heavy([h])]
        whole = [self.key((h,), variant) for df, h, _ in first if df > SHORT and heavy([h])]
        out = [(self.key((h,), variant), bits([h])) for h in alone]
        wide = [[h for df, h, _ in terms[: self.opened(terms, least, n)] if df > SHORT and h not in alone] for n in range(2, DEEPEST + 1)]
        sets = {tuple(sorted((t, u))) for t in start for u in wide[0] if t != u}
        told = bits(wide[0])
        for n in range(2, DEEPEST + 1):
            keys = {s: self.key(s, variant) for s in sets}
            long = {s for s, k in keys.items() if self.long(k, n)}
            sets = {s for s in long if not heavy(s)}
            out += [(k, bits(s)) for s, k in keys.items() if s not in sets]
            whole += [keys[s] for s in long - sets]
            if not sets:
                break
            told = 0
            sets = self.grown(sets, wide[n - 1])
        return out, whole, bits(alone), bits(start), told


def sign_of(h: int) -> int:
    """One of 63 bits for a term: a paper without the bit hasn't the term."""
    return 1 << ((h >> 2) * 0x9E3779B97F4A7C15 >> 17) % 63


def full_buckets(papers: DataFrame) -> list[np.ndarray]:
    """Which buckets of lists of two, three, ... terms have more than ``LONG`` papers; flags of a fixed number of buckets reach the driver."""

    def counting(shared: Broadcast, n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opener = Opener(shared.value)
            for batch in batches:
                keys = [k & (BUCKETS - 1) for terms, v in zip(tuples(batch.column(0), "df", "h"), batch.column(1).to_pylist()) for k in opener.counted(terms, v, n)]
                buckets, counts = np.unique(np.array(keys, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts.astype(np.int64))], names=["bucket", "n"])

        return run

    full: list[np.ndarray] = []
    for n in range(2, DEEPEST):
        flags = np.zeros(BUCKETS, bool)
        rows = papers.select("terms", "variant").mapInArrow(counting(papers.sparkSession.sparkContext.broadcast(full), n), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(f"n > {LONG}").select("bucket").toArrow()
        flags[rows.column(0).to_numpy()] = True
        full.append(flags)
        if not flags.any():
            break
    return full


def candidates(papers: DataFrame, records: DataFrame, cover: float = COVER, top: int | None = TOP) -> DataFrame:
    """``r_at, p_at``: for each record the papers that may be among its best ``top`` (None: all) of those with at least ``cover`` of its weight in common.

    Papers without authors are held against what records say besides, in lists of their own (variant 1).
    """
    nameless = papers.where(F.forall("terms", lambda t: t["h"].bitwiseAND(3) != 1))
    papers = papers.select("at", "terms", F.lit(0).alias("variant")).unionAll(nameless.select("at", "terms", F.lit(1)))
    records = records.select("at", "terms", "total", F.lit(0).alias("variant")).unionAll(without_authors(records).select("at", "terms", "total", F.lit(1)))
    packed = [np.packbits(f) for f in full_buckets(papers)]
    shared = papers.sparkSession.sparkContext.broadcast(packed)
    opener = lambda: Opener([np.unpackbits(f).astype(bool) for f in shared.value])

    def stands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = opener()
        o.whole = np.unpackbits(asked_whole.value).astype(bool)
        for batch in batches:
            at, keys, signs = [], [], []
            for i, (terms, v) in enumerate(zip(tuples(batch.column(1), "df", "h"), batch.column(2).to_pylist())):
                mine, sign = o.paper(terms, v), 0
                for _, h in terms:
                    sign |= sign_of(h)
                at += [i] * len(mine)
                keys += mine
                signs += [sign] * len(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.int64()), pa.array(signs, pa.int64())], names=["p_at", "key", "sign"])

    lists = pa.list_(pa.int64())

    def opens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = opener()
        for batch in batches:
            keys, masks, wholes, rest, weights, signs, bars = [], [], [], [], [], [], []
            for terms, total, v in zip(tuples(batch.column(1), "df", "h", "w"), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                mine, whole, *told = o.record(terms, v, cover * total - 1e-9)
                keys.append([k for k, _ in mine]), masks.append([m for _, m in mine]), wholes.append(whole), rest.append(told)
                signs.append([sign_of(h) for _, h, _ in terms])
                weights.append([w if df else 0.0 for df, _, w in terms]), bars.append(cover * total)
            arrays = [batch.column(0), batch.column(3), pa.array(keys, lists), pa.array(masks, lists), pa.array(wholes, lists), *(pa.array([t[k] for t in rest], pa.int64()) for k in range(3)), pa.array(weights, pa.list_(pa.float64())), pa.array(signs, lists), pa.array(bars, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["r_at", "variant", "keys", "masks", "whole", "alone", "start", "told", "weights", "signs", "bar"])

    schema = "r_at bigint, variant int, keys array<bigint>, masks array<bigint>, whole array<bigint>, alone bigint, start bigint, told bigint, weights array<double>, signs array<bigint>, bar double"
    opened = materialize(records.mapInArrow(opens, schema).where("size(keys) > 0"))
    flags = np.zeros(BUCKETS, bool)  # as in full_buckets
    flags[opened.select(F.explode("whole").alias("key")).select(F.col("key").bitwiseAND(BUCKETS - 1).alias("bucket")).distinct().toArrow().column(0).to_numpy()] = True
    asked_whole = papers.sparkSession.sparkContext.broadcast(np.packbits(flags))
    in_lists = papers.mapInArrow(stands, "p_at bigint, key bigint, sign bigint")
    asked = opened.select("r_at", "variant", F.expr("size(whole) > 0").alias("much"), F.explode(F.arrays_zip("keys", "masks")).alias("k")).select("r_at", "variant", "much", F.col("k.keys").alias("key"), F.col("k.masks").alias("mask"))
    part = F.expr(f"if(much, pmod(p_at, {PARTS}), 0)").alias("part")
    met = wide(asked.join(in_lists, "key").select("r_at", "variant", part, "p_at", "mask", "sign"), "r_at", "variant").groupBy("r_at", "variant", "part").agg(F.collect_list(F.struct("p_at", "mask", "sign")).alias("met"))
    rows = opened.select("r_at", "variant", "alone", "start", "told", "weights", "signs", "bar").join(met, ["r_at", "variant"])
    lightest, heaviest = ((K1 + 1) / (1 + K1 * (1 - B + B * x)) for x in reversed(LENGTHS))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(7)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            flat = found.flatten()
            p, mask, sign = (flat.field(f).to_numpy() for f in ("p_at", "mask", "sign"))
            if not len(p):
                continue
            order = np.lexsort((p, owner))
            owner, p, mask, sign = owner[order], p[order], mask[order], sign[order]
            new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (p[1:] != p[:-1])))
            owner, p, sign, mask = owner[new], p[new], sign[new], np.bitwise_or.reduceat(mask, new)
            alone, start, told, bar = (batch.column(i).to_numpy() for i in (1, 2, 3, 6))
            sizes = np.diff(batch.column(4).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat = batch.column(4).flatten().to_numpy()
            seen = np.bincount(row, flat, batch.num_rows)
            width = min(62, int(sizes.max()))
            weights = np.zeros((batch.num_rows, width))
            weights[row[place < width], place[place < width]] = flat[place < width]
            signs = np.zeros((batch.num_rows, width), np.int64)
            signs[row[place < width], place[place < width]] = batch.column(5).flatten().to_numpy()[place < width]
            of = lambda bits, at: ((bits[:, None] >> np.arange(width) & 1) * weights[at]).sum(1)
            held, most = np.zeros(len(p)), np.zeros(len(p))
            for a in range(0, len(p), 100_000):
                c = slice(a, a + 100_000)
                o = owner[c]
                held[c] = of(mask[c], o)
                # what a paper surely lacks: terms of short lists, of long ones once one of the first is shared, and terms
                # whose sign it hasn't
                gone = ~mask[c] & (alone[o] | np.where(mask[c] & start[o], told[o], 0))
                lacks = (gone[:, None] >> np.arange(width) & 1).astype(bool) | (sign[c, None] & signs[o] == 0)
                most[c] = seen[o] - (lacks * weights[o]).sum(1)
            bars = bar.copy()
            if top is not None:
                best = np.lexsort((-held, owner))
                counts = np.bincount(owner, minlength=batch.num_rows)
                last = np.cumsum(counts) - counts + top - 1
                enough = counts >= top
                bars[enough] = np.maximum(bars[enough], held[best[last[enough]]] * lightest / heaviest)
            keep = most >= bars[owner] - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), pa.array(p[keep])], names=["r_at", "p_at"])

    return rows.select("r_at", "alone", "start", "told", "weights", "signs", "bar", "met").mapInArrow(prune, "r_at bigint, p_at bigint")


SCORES = ("score", "share", "title", "author", "numbers")


def scored(pairs: DataFrame, papers: DataFrame, records: DataFrame, mean: float, cover: float = COVER) -> DataFrame:
    """``p, r, p_venue, r_venue`` and: BM25 score, share of the lighter row's weight in common, the same of titles and of authors (-1: one side has none), and whether the numbers are the same."""
    side = lambda x, n: x.select(F.col("at").alias(f"{n}_at"), F.col("id").alias(n), F.col("venue").alias(f"{n}_venue"), F.transform("terms", lambda t: F.struct(t["h"], t["w"])).alias(f"{n}_terms"), F.col("total").alias(f"{n}_total"))
    both = wide(pairs.join(side(papers, "p"), "p_at"), "r_at").join(side(records, "r"), "r_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue

            def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                flat = column.flatten()
                return np.repeat(np.arange(n), np.diff(column.offsets.to_numpy())), flat.field("h").to_numpy(), flat.field("w").to_numpy()

            (pi, ph, pw), (ri, rh, rw) = terms(batch.column(4)), terms(batch.column(5))
            # the same term of the same pair, told by a hash of both
            mix = lambda i, h: (h ^ (i * np.int64(-7046029254386353131))) * np.int64(-4658895280553007687)
            with np.errstate(over="ignore"):
                common = np.isin(mix(ri, rh), mix(pi, ph))
            kinds = lambda i, h, w, k, on: np.bincount(i[on & (h & 3 == k)], w[on & (h & 3 == k)], n)
            yes = np.ones(len(rh), bool), np.ones(len(ph), bool)
            shared = np.bincount(ri[common], rw[common], n)
            length = np.clip(np.bincount(pi, minlength=n) / max(mean, 1e-9), *LENGTHS)
            part = []
            for k in (0, 1, 2):
                mine, theirs, both_ = kinds(ri, rh, rw, k, yes[0]), kinds(pi, ph, pw, k, yes[1]), kinds(ri, rh, rw, k, common)
                lighter = np.minimum(mine, theirs)
                part.append(np.where(lighter > 0, np.minimum(both_ / np.maximum(lighter, 1e-9), 1.0), -1.0))
            same = (np.bincount(ri[rh & 3 == 2], minlength=n) == np.bincount(ri[common & (rh & 3 == 2)], minlength=n)) & (np.bincount(pi[ph & 3 == 2], minlength=n) == np.bincount(ri[common & (rh & 3 == 2)], minlength=n))
            r_total, p_total = batch.column(7).to_numpy(), batch.column(6).to_numpy()
            values = [shared * (K1 + 1) / (1 + K1 * (1 - B + B * length)), np.minimum(shared / np.maximum(np.minimum(r_total, p_total), 1e-9), 1.0), part[0], part[1]]
            out = [*batch.columns[:4], *(pa.array(v) for v in values), pa.array(same)]
            # a paper without authors is held against the rest of the record
            own = r_total - np.where(kinds(pi, ph, pw, 1, yes[1]) > 0, 0.0, kinds(ri, rh, rw, 1, yes[0]))
            yield pa.RecordBatch.from_arrays(out, names=["p", "r", "p_venue", "r_venue", *SCORES]).filter(pa.array(shared >= cover * own - 1e-9))

    columns = both.select("p", "r", "p_venue", "r_venue", "p_terms", "r_terms", "p_total", "r_total")
    return columns.mapInArrow(run, "p string, r string, p_venue string, r_venue string, score double, share double, title double, author double, numbers boolean")


def retrieve(bib: DataFrame, records: DataFrame, cover: float = COVER, top: int = TOP, where: str | None = None) -> DataFrame:
    """Each record's best ``top`` papers of those with at least ``cover`` of its weight in common (without authors, of its other weight): ``p, r, p_venue, r_venue, rank`` and their scores.

    With ``where``, a condition on the scores, the best of those that it holds for, however many are better otherwise.
    """
    papers, found = prepared(bib, "paper_id", "ingested_at"), prepared(records, "record_id", "fetched_at")
    total = papers.count()
    words = vocabulary(papers, found, total)
    papers, found = indexed(papers, words), indexed(found, words)
    mean = papers.agg(F.coalesce(F.avg(F.size("terms")), F.lit(1.0))).first()[0]
    by_record = Window.partitionBy("r").orderBy(F.desc("score"), F.desc("share"), "p")
    held = scored(candidates(papers, found, cover, None if where else top).dropDuplicates(), papers, found, mean, cover)
    return (held.where(where) if where else held).withColumn("rank", F.row_number().over(by_record)).where(f"rank <= {top}")


#: Weights of constant, share and gap that calibration starts from, and how firmly it holds to them.
PRIOR, FIRM = np.array([-10.0, 12.0, 4.0]), 2.0


def calibrated(sample: np.ndarray) -> np.ndarray:
    """Weights of the logistic function from rows of (share, gap, venues agree), rank 1 first; the last column is the rank.

    Venues agree by chance at the rate of runners-up, and at that of the clearest pairs if the works are the same: what
    lies between tells how many are.
    """
    first, rest = sample[sample[:, 3] == 1], sample[sample[:, 3] > 1]
    clear = first[(first[:, 0] >= 0.95) & (first[:, 1] >= 0.3)]
    if len(clear) < 50 or len(rest) < 50 or clear[:, 2].mean() <= rest[:, 2].mean() + 0.05:
        return PRIOR
    chance, same = rest[:, 2].mean(), min(clear[:, 2].mean(), 0.999)
    x, y, w = np.column_stack([np.ones(len(first)), first[:, :2]]), first[:, 2], PRIOR.copy()
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        q = np.clip(chance + (same - chance) * p, 1e-4, 1 - 1e-4)
        slope = (y - q) / (q * (1 - q)) * (same - chance) * p * (1 - p)
        w = w + 0.5 * (x.T @ slope / len(x) * 10 - FIRM * (w - PRIOR) / len(x))
    return w


def match(bib: DataFrame, records: DataFrame, least: float = 0.5, near: float = 0.7) -> DataFrame:
    """``paper_id, record_id, score, share, second, confidence, title, author``: each record with the paper it describes, if there is one.

    Of rows with the same id the latest counts (ties by content). A record has at most one paper; a paper may have
    many records, each with at least ``near`` of the share of the paper's best one. Rows without a term match nothing and
    give no rows; null authors or years count as unknown, neither for nor against; ties in the score go to the smaller
    ``paper_id``. Equal numbers in titles are demanded: parts and years of a series are different works; so is an author
    in common where both list any, and where one doesn't, a title that is one paper's alone. Empty tables give no rows;
    other columns are ignored.
    """
    # other parts and years of a series are other works, and so are works of nobody in common: they stand behind no one
    same = "numbers and title >= 0.6 and (author > 0.2 or author < 0)"
    top = materialize(retrieve(bib, records, where=same).drop("numbers"))
    by_record = Window.partitionBy("r").orderBy("rank")
    ranked = top.withColumn("rank", F.row_number().over(by_record)).withColumn("second", F.coalesce(F.lead("share").over(by_record), F.lit(0.0)))
    agree = (F.col("p_venue") == F.col("r_venue")).cast("double")
    taught = ranked.where("p_venue <> '' and r_venue <> ''").select("share", (F.col("share") - F.col("second")).alias("gap"), agree.alias("agree"), F.col("rank").cast("double"), F.xxhash64("r", "rank").alias("h"))
    rows = taught.orderBy("h").limit(SAMPLE).collect()
    w = calibrated(np.array([[r.share, r.gap, r.agree, r.rank] for r in rows]).reshape(-1, 4))
    best = ranked.where("rank = 1").withColumn("confidence", 1 / (1 + F.exp(-(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("share") + F.lit(float(w[2])) * (F.col("share") - F.col("second"))))))
    # the other direction: a record that has much less in common than the paper's best one is not near it
    mutual = best.withColumn("most", F.max("share").over(Window.partitionBy("p"))).where(F.col("share") >= F.lit(near) * F.col("most"))
    checked = mutual.where("author > 0 or title > 0.8 and second < share - 0.05")
    out = checked.where(F.col("confidence") >= F.lit(least))
    return out.select(F.col("p").alias("paper_id"), F.col("r").cast(records.schema["record_id"].dataType).alias("record_id"), "score", "share", "second", "confidence", "title", "author")


def _matched(spark: SparkSession, root: str) -> DataFrame:
    return match(table(spark, root, "bib"), table(spark, root, "source_records"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Papers and the outside records that describe them."""
    return _matched(spark, root).select("paper_id", "record_id")


def p1_confidence(spark: SparkSession, root: str) -> DataFrame:
    """The same with scores and confidence."""
    return _matched(spark, root).select("paper_id", "record_id", "score", "second", "confidence")
