"""Repairing the text of scanned pages.

Method: skip-gram vectors are learned from the corpus; rare words are linked to more frequent ones that plausible
glyph edits make of them, and the context decides between several. Then page furniture (running headers, footers, page
numbers) is removed, hyphenated words are joined and blocks are reflowed into paragraphs.

Scale: all joins are on (paper, block), (paper, line key), or words. A volume that holds a large share of all blocks is
ordered in chunks of ``CHUNK`` blocks; what a chunk hands to the next one is one row per chunk. What is broadcast is
bounded: words with at least a fixed share of all tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, spread, table
from .canonical import fold

CHUNK = 512
#: Share of all tokens of a frequent word (at most 20,000 words) and of a context word of the vectors (at most 1,000).
FREQUENT, CONTEXT = 5e-5, 1e-3
#: A word is misread only if the word it is linked to is so many times as frequent.
RATIO = 8
DIMENSIONS, REACH = 24, 2
#: A link is refused where the word fits its context so much worse (in nats a context word) than words do on average.
MISFIT = 1.0
#: Margins of a page where the corpus has no labelled furniture to learn them from.
TOP, BOTTOM = 60.0, 780.0
#: Lines are alike if they have at most so many slips and so many letters in a row in common.
SLIPS, RUN = 3, 5
#: Block types that are running text or furniture; others are read too but are no paragraphs.
FLOW = ("text", "header", "page_number")
_LINES = re.compile(r"\r\n|\r|\n| | |\x0b|\x0c|\x85")
_DIGIT_LIKE = str.maketrans("OoDQlISBZi|", "00001158211")
_D = r"[\dOolISBZi|]"
_NUMBER = re.compile(rf"^(?:[-–—\[(.~*\s]*)(?:(?:page|pg|seite|p)\b\.?\s*)?(?:[A-Z]\s?[-–.])?\s?({_D}{{1,5}})(?:\s*(?:of|/)\s*{_D}{{1,5}})?(?:[-–—\]).~*\s]*)$", re.I)
_ROMAN = re.compile(r"^[-–—\[(.~*\s]*([ivx]{1,6})[-–—\]).~*\s]*$")
_LEFT, _RIGHT = re.compile(rf"^((?:[A-Z]-)?{_D}{{1,5}})\s{{2,}}(\S.*)$"), re.compile(rf"^(.*\S)\s{{2,}}((?:[A-Z]-)?{_D}{{1,5}})$")
_CAPTION = re.compile(r"^(?:fig(?:ure)?|table|tab|plate|scheme)\b\.?\s*\d+\s*[.:]", re.I)
_HEADING = re.compile(r"^(?:(?:\d+(?:\.\d+)*|[IVX]+)\.?\s+)?[^\W\d_][\w&'’\- ]{2,60}$")
_BREAK = re.compile(r"([^\W_]+)(?:[-‐‑¬­][^\S\r\n]*(?:\r\n|\r|\n| | |\x0b|\x0c|\x85)[^\S\r\n]*|[-‐‑¬­][^\S\r\n]+|[­¬])([^\W_]+)")
_BREAKS = re.compile(r"[-‐‑¬­]\s|[¬­]")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
#: A paragraph's block goes on with one before if it begins in lower case, or, where the one before is open, with no capital.
GOES_ON = "lower or (coalesce(before.open, false) and not coalesce(rlike(head, '^\\\\p{Lu}'), false))"
_OPEN_END = re.compile(r"[^.!?:…\"”’)\]]$")


def letters_of(line: str) -> str:
    """Letters of a line, folded: what a running header shares on all pages, however its numbers and case change."""
    return re.sub(r"[^a-z]", "", fold(line))


def line_key(line: str) -> str:
    """The first letters of a line: a title is often cut where it is a running header."""
    return letters_of(line)[:24]


def number_of(text: str) -> int | None:
    """The number of a line that is a page number, its letters misread for digits put right."""
    if m := _ROMAN.match(text):
        return sum({"i": 1, "v": 5, "x": 10}[c] for c in m[1])
    m = _NUMBER.match(text.strip())
    if re.match(r"^\((?:19|20)\d\d\)", text.strip()):  # the year of a citation
        return None
    if not m or not re.search(r"\d|^[lIO]+$", m[1]):
        return None
    return int(m[1].translate(_DIGIT_LIKE))


def parts_of(line: str) -> tuple[str, int | None]:
    """A line's running text (empty if none) and page number (None if none)."""
    line = line.strip()
    if (n := number_of(line)) is not None:
        return "", n
    for pattern, n, text in ((_LEFT, 1, 2), (_RIGHT, 2, 1)):
        if m := pattern.match(line):
            if (page := number_of(m[n])) is not None:
                return m[text].strip(), page
    return line, None


def latest_blocks(blocks: DataFrame) -> DataFrame:
    """One row per block: the latest, of equally late ones the greatest text; rows without a key are left out."""
    row = F.struct("type", "text", "text_level", "page_idx", F.get("bbox", F.lit(1)).alias("y"))
    late = F.struct("extracted_at", F.xxhash64("text"))
    one = blocks.where("paper_id is not null and ord is not null").groupBy("paper_id", "ord").agg(F.max_by(row, late).alias("b"))
    return one.where("b.text is not null and b.text <> ''").select("paper_id", "ord", "b.*")


def margins(base: DataFrame) -> tuple[float, float]:
    """Where the top margin ends and the bottom one begins: halfway between labelled furniture and labelled body blocks of all pages."""
    at = lambda cond, q: F.percentile_approx(F.when(F.expr(cond), F.col("y")), q)
    body = f"type not in {FLOW}"
    head, first, last, number = base.agg(at("type = 'header'", 0.9), at(body, 0.01), at(body, 0.99), at("type = 'page_number'", 0.1)).first()
    top = (head + first) / 2 if head is not None and first is not None and head < first else TOP
    return top, (last + number) / 2 if number is not None and last is not None and last < number else BOTTOM


def _candidates(base: DataFrame, top: float, bottom: float) -> DataFrame:
    """Lines that may be furniture: ``paper_id, ord, place, i, key, off, size``; off: the line's page number less the page; size: number of letters; place: margin, unknown, body, title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for paper, ord_, kind, text, page, y in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [x for x in _LINES.split(text)]
                margin = kind in ("header", "page_number") or (y is not None and not top <= y <= bottom)
                place = "margin" if margin else "unknown" if y is None else "body"
                if ord_ == 0 and not margin:
                    out.append((paper, ord_, "title", 0, line_key(text), None, len(letters_of(text))))
                    continue
                if place == "unknown" and len(lines) > 1:
                    place = "body"
                if place == "body" and len(lines) == 1:
                    continue
                for i, line in enumerate(lines):
                    running, n = parts_of(line)
                    letters = letters_of(running)
                    key = letters[:24]
                    if len(key) >= 5 or n is not None:
                        out.append((paper, ord_, place, i, key if len(key) >= 5 else None, n - page if n is not None and page is not None else None, len(letters)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["paper_id", "ord", "place", "i", "key", "off", "size"])

    return base.select("paper_id", "ord", "type", "text", "page_idx", "y").mapInArrow(run, "paper_id string, ord int, place string, i int, key string, off int, size int")


def furniture(base: DataFrame, top: float = TOP, bottom: float = BOTTOM) -> DataFrame:
    """``paper_id, ord, headers, numbers``: line numbers of running headers and of page numbers in blocks whose place on the page doesn't tell."""
    lines = materialize(_candidates(base, top, bottom))
    # each of a paper's lines is held against all headers of the paper and its title, wherever they stand; lines of the same
    # letters once. Headers are cut into all runs of RUN letters. So is a line, unless it is long: SLIPS slips leave one of
    # SLIPS + 1 runs that don't overlap. A line that goes on where the header ends is none
    runs = lambda starts: F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("key"), i, F.lit(RUN))))).alias("run")
    every = F.sequence(F.lit(1), F.length("key") - (RUN - 1))
    apart = F.array(*(F.lit(1 + RUN * k) for k in range(SLIPS + 1)))
    whole = F.length("key") >= RUN
    known = lines.where("place in ('margin', 'title')").where(whole).groupBy("paper_id", "key").agg(F.max("size").alias("size"))
    asked = lines.where("place in ('unknown', 'body')").where(whole).select("paper_id", "ord", "i", "key", "size")
    cut = asked.select("paper_id", "key").distinct().select("paper_id", "key", runs(F.when(F.length("key") >= RUN * (SLIPS + 1), apart).otherwise(every)))
    met = cut.join(known.select("paper_id", F.col("key").alias("known"), F.col("size").alias("longest"), runs(every)), ["paper_id", "run"])
    alike = met.where(F.levenshtein("key", "known", SLIPS) >= 0).groupBy("paper_id", "key").agg(F.max("longest").alias("longest"))
    heads = asked.join(alike, ["paper_id", "key"]).where(f"size <= longest + {SLIPS}").select("paper_id", "ord", "i", F.lit(None).cast("int").alias("n"))
    offsets = lines.where("place = 'margin' and off is not null").groupBy("paper_id", "off").agg(F.count("*").alias("c"))
    usual = offsets.groupBy("paper_id").agg(F.max_by("off", F.struct("c", -F.col("off"))).alias("off"))
    numbers = lines.where("place in ('unknown', 'body') and off is not null").join(usual, ["paper_id", "off"]).select("paper_id", "ord", F.lit(None).cast("int").alias("i"), F.col("i").alias("n"))
    return heads.unionByName(numbers).groupBy("paper_id", "ord").agg(F.collect_set("i").alias("headers"), F.collect_set("n").alias("numbers"))


def bodies(base: DataFrame, found: DataFrame, top: float = TOP, bottom: float = BOTTOM) -> DataFrame:
    """``paper_id, ord, page, header, page_number, body, paragraph, head, tail, open, lower``: each block without its furniture.

    paragraph: running text, no heading or caption; head and tail: first word, and the last one if it ends in a hyphen;
    open: no mark ends the text; lower: it begins in lower case.
    """
    fields = "paper_id string, ord int, page int, header boolean, page_number boolean, body string, paragraph boolean, head string, tail string, open boolean, lower boolean"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for paper, ord_, kind, text, level, page, y, heads, pages in zip(*(c.to_pylist() for c in batch.columns)):
                lines = _LINES.split(text)
                heads, pages = set(heads or ()), set(pages or ())
                if ord_ != 0 and (kind in ("header", "page_number") or (y is not None and not top <= y <= bottom)):
                    parsed = [parts_of(x) for x in lines if x.strip()]
                    header, number, body = any(r for r, _ in parsed), any(n is not None for _, n in parsed), ""
                else:
                    if y is None and len(lines) == 1 and ord_ != 0 and kind in FLOW and parts_of(text)[1] is not None:
                        pages |= {0}  # a number alone, whose place is unknown
                    header = bool(heads)
                    number = bool(pages) or any(parts_of(lines[i])[1] is not None for i in heads)
                    if not header and any(parts_of(lines[i])[0] for i in pages):
                        header = True  # a running text beside the page number
                    gone = heads | pages
                    body = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone).strip()
                flat = body.strip()
                single = not _LINES.search(flat)
                heading = level is not None or (single and len(flat.split()) <= 6 and bool(_HEADING.match(flat)) and flat[:1] == flat[:1].upper())
                para = bool(flat) and not (single and _CAPTION.match(flat)) and not heading and ord_ != 0 and kind in FLOW
                words = _TOKEN.findall(flat[:80])
                tail = re.search(r"([^\W_]+)[-‐‑¬­]$", flat)
                out.append((paper, ord_, page, header, number, body if flat else None, para, words[0] if words else None, tail[1] if tail else None, bool(_OPEN_END.search(flat)), bool(words) and flat[:1].islower()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    joined = base.join(found, ["paper_id", "ord"], "left").select("paper_id", "ord", "type", "text", "text_level", "page_idx", "y", "headers", "numbers")
    return materialize(joined.mapInArrow(run, fields))


def preceding(body: DataFrame) -> DataFrame:
    """Paragraph blocks with the one before: ``..., before`` (struct of ord, tail, open). Ordered by chunks of a paper."""
    paragraphs = body.where("paragraph").withColumn("chunk", F.expr(f"cast(floor(ord / {CHUNK}) as int)"))
    me = F.struct("ord", "tail", "open")
    inside = Window.partitionBy("paper_id", "chunk").orderBy("ord")
    ends = paragraphs.groupBy("paper_id", "chunk").agg(F.max_by(me, "ord").alias("last"))
    handed = ends.withColumn("handed", F.lag("last").over(Window.partitionBy("paper_id").orderBy("chunk"))).select("paper_id", "chunk", "handed")
    return paragraphs.withColumn("near", F.lag(me).over(inside)).join(handed, ["paper_id", "chunk"]).withColumn("before", F.coalesce("near", "handed")).drop("near", "handed")


#: Letters as the strokes they are read from; letters of equal strokes are misread for each other
#: (rn for m, in for m, ri for n, ii for u, li for h, cl for d, vv for w, c for e, 0 for o, 5 for s, ...).
STROKES = {
    **dict.fromkeys("il1r|j", "i"), **dict.fromkeys("nuhb6", "ii"), "m": "iii", "8": "ii", "v": "v", "y": "v", "w": "vv", "d": "ci", "e": "c", "c": "c",
    **dict.fromkeys("ao0", "o"), **dict.fromkeys("tf", "t"), **dict.fromkeys("s5", "s"), **dict.fromkeys("g9q", "g"), "2": "z",
}
_STROKES = str.maketrans(STROKES)


def skeleton(word: str) -> str:
    """What a word's glyphs look like: words of the same strokes may be misread for each other."""
    return word.lower().translate(_STROKES)


def joined_breaks(text: str, known: frozenset[str]) -> tuple[str, bool]:
    """The text with broken words joined, and whether there were any. A hyphen stays where the word is written with it."""
    found = False
    if not _BREAKS.search(text):
        return text, found

    def join(m: re.Match) -> str:
        nonlocal found
        a, b, whole = m[1], m[2], m[1] + m[2]
        low = whole.lower()
        at_line = bool(_LINES.search(m[0]))
        if low in known:
            broken = True
        elif f"{a}-{b}".lower() in known or b[0].isupper() and not a.isupper() or not b[0].isalnum():
            broken = False
        elif at_line or m[0][len(a)] in "¬­":
            broken = not (a.lower() in known and b.lower() in known) and not (a.isdigit() or b.isdigit())
        else:
            broken = b[0].islower() and b.lower() not in known and not a.isdigit()
        if broken:
            found = True
            return whole
        return f"{a}-{b}" if at_line else m[0]

    for _ in range(2):  # a word may be broken twice, and matches share no word
        text = _BREAK.sub(join, text)
    return text, found


def token_counts(body: DataFrame) -> DataFrame:
    """``word, n`` over all blocks, counted before the shuffle; parts of broken words don't count, compounds count whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_TOKEN.findall((_BREAK.sub(" ", text) if _BREAKS.search(text) else text).lower()))
            if len(counts) > 500_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return body.where("body is not null").select("body").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _likelihood(z: np.ndarray) -> np.ndarray:
    return -np.log1p(np.exp(-np.clip(z, -30, 30)))


class Vectors:
    """Skip-gram vectors with negative sampling: input vectors of frequent words, output vectors of context words."""

    def __init__(self, words: dict[str, int], contexts: dict[str, int], inputs: np.ndarray, outputs: np.ndarray):
        self.words, self.contexts, self.inputs, self.outputs = words, contexts, inputs, outputs
        self.means: np.ndarray | None = None

    def fit(self, word: str, near: list[str]) -> float:
        """Mean log-likelihood of the words around ``word``; the least for an unknown word, 0 where nothing around is known."""
        if word not in self.words:
            return -30.0
        ids = [self.contexts[w] for w in near if w in self.contexts]
        if not ids:
            return 0.0
        z = self.outputs[ids] @ self.inputs[self.words[word]]
        return float(_likelihood(z).mean())

    def usual(self, near: list[str]) -> float:
        """What ``fit`` is on average over all words."""
        if self.means is None:
            self.means = _likelihood(self.outputs @ self.inputs.T).mean(1) if len(self.words) else np.zeros(len(self.contexts))
        ids = [self.contexts[w] for w in near if w in self.contexts]
        return float(self.means[ids].mean()) if ids else 0.0

    def choose(self, options: list[str], near: list[str]) -> str | None:
        """The option that fits best of those that don't misfit; words without a vector are judged by their glyphs alone and come last."""
        least = self.usual(near) - MISFIT
        fits = [(self.fit(o, near), -i, o) for i, o in enumerate(options)]
        good = [(f - 0.05 * -i, i, o) for f, i, o in fits if o in self.words and f >= least]
        return max(good)[2] if good else next((o for o in options if o not in self.words), None)


def learn_vectors(body: DataFrame, words: list[str], contexts: list[str], steps: int = 120, negatives: int = 5, seed: int = 7) -> Vectors:
    """Trained on the counts of all pairs of a frequent word and a context word up to ``REACH`` words apart.

    The counts of all data decide; the objective is that of skip-gram with negative sampling, summed by pair.
    """
    w_of, c_of = {w: i for i, w in enumerate(words)}, {w: i for i, w in enumerate(contexts)}
    if not w_of or not c_of:
        return Vectors(w_of, c_of, np.zeros((len(w_of), DIMENSIONS)), np.zeros((len(c_of), DIMENSIONS)))
    shared = body.sparkSession.sparkContext.broadcast((w_of, c_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_of, c_of = shared.value
        width = max(len(c_of), 1)
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            ws, cs = [], []
            for text in batch.column(0).to_pylist():
                tokens = _TOKEN.findall(text.lower())
                ws += [w_of.get(t, -1) for t in tokens] + [-1] * REACH
                cs += [c_of.get(t, -1) for t in tokens] + [-1] * REACH
            w, c = np.array(ws, np.int64), np.array(cs, np.int64)
            keys = [total[0]]
            for gap in range(1, REACH + 1):
                for a, b in ((w[gap:], c[:-gap]), (w[:-gap], c[gap:])):
                    both = (a >= 0) & (b >= 0)
                    keys.append(a[both] * width + b[both])
            counts = np.concatenate([total[1], np.ones(sum(map(len, keys[1:])), np.int64)])
            seen, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = seen, np.bincount(at, counts, len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((total[0] // width).astype(np.int32)), pa.array((total[0] % width).astype(np.int32)), pa.array(total[1])], names=["w", "c", "n"])

    pairs = body.where("body is not null").select("body").mapInArrow(run, "w int, c int, n bigint").groupBy("w", "c").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(w_of), len(c_of)), np.float32)  # bounded by FREQUENT and CONTEXT
    n[pairs.w.to_numpy(), pairs.c.to_numpy()] = pairs.n.to_numpy()
    rng = np.random.default_rng(seed)
    u, v = (rng.normal(0, 0.3, (k, DIMENSIONS)).astype(np.float32) for k in n.shape)
    context = n.sum(0) ** 0.75
    expected = negatives * n.sum(1, keepdims=True) * (context / max(context.sum(), 1))[None]
    scale = 1 / np.maximum(n.sum(1, keepdims=True) + expected.sum(1, keepdims=True), 1)
    columns = 1 / np.maximum(n.sum(0) + expected.sum(0), 1)[:, None]
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(u @ v.T, -30, 30)))
        g = n * (1 - p) - expected * p
        rate = 4.0 * (1 - 0.8 * t / steps)
        u, v = u + rate * ((g * scale) @ v - 1e-3 * u), v + rate * ((g * columns.T).T @ u - 1e-3 * v)
    return Vectors(w_of, c_of, u, v)


def links(counts: DataFrame) -> DataFrame:
    """``word, options``: rare words and the more frequent words of the same skeleton, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, skeleton(w)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(w) >= 3 and re.search(r"[^\W\d_]", w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["word", "n", "shape"])

    shaped = counts.mapInArrow(run, "word string, n bigint, shape string")
    # a word is joined with all words of its strokes that are RATIO times as frequent
    heads = shaped.select("shape", F.col("word").alias("to"), F.col("n").alias("m")).where(f"m >= {RATIO}")
    pairs = shaped.join(heads, "shape").where(f"m >= {RATIO} * n and word <> to and abs(length(word) - length(to)) <= 3").select("word", "to", "m").dropDuplicates()
    return pairs.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "to")), False), lambda x: x["to"]).alias("options"))


class Repair:
    """All that is learned of a corpus of blocks, and its blocks by parts; each step is computed once."""

    def __init__(self, blocks: DataFrame):
        self.base = materialize(spread(latest_blocks(blocks), ["paper_id", "ord"]))
        around = margins(self.base)
        self.body = bodies(self.base, furniture(self.base, *around), *around)
        self.counts = materialize(token_counts(self.body))
        total = self.counts.agg(F.sum("n")).first()[0] or 0
        frequent = [r.word for r in self.counts.where(F.col("n") >= max(3, FREQUENT * total)).orderBy("word").collect()]
        contexts = [r.word for r in self.counts.where(F.col("n") >= max(3, CONTEXT * total)).orderBy("word").collect()]
        self.known = frozenset(frequent)
        self.vectors = learn_vectors(self.body, frequent, contexts)
        self.links = materialize(links(self.counts))
        self.ordered = materialize(preceding(self.body))

    def broken(self) -> DataFrame:
        """``paper_id, ord, hyphen, suspects, text``: broken words joined, and words that are not frequent with those around them."""
        shared = self.base.sparkSession.sparkContext.broadcast(self.known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                hyphen, suspects, texts = [], [], []
                for text in batch.column(2).to_pylist():
                    joined, found = joined_breaks(text, known)
                    low = _TOKEN.findall(joined.lower())
                    hyphen.append(found), texts.append(joined)
                    suspects.append([{"word": w, "near": low[max(0, i - REACH) : i] + low[i + 1 : i + 1 + REACH]} for i, w in enumerate(low) if w not in known and len(w) >= 3])
                kind = pa.list_(pa.struct([("word", pa.string()), ("near", pa.list_(pa.string()))]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hyphen, pa.bool_()), pa.array(suspects, kind), pa.array(texts, pa.string())], names=["paper_id", "ord", "hyphen", "suspects", "text"])

        rows = self.body.where("body is not null").select("paper_id", "ord", "body")
        return materialize(rows.mapInArrow(run, "paper_id string, ord int, hyphen boolean, suspects array<struct<word: string, near: array<string>>>, text string"))

    def misread(self, broken: DataFrame) -> DataFrame:
        """``paper_id, ord, word, to``: misread words of a block and what they were, chosen by context."""
        vectors = self.vectors
        shared = self.base.sparkSession.sparkContext.broadcast((vectors.words, vectors.contexts, vectors.inputs, vectors.outputs))
        asked = broken.select("paper_id", "ord", F.explode("suspects").alias("s")).select("paper_id", "ord", "s.word", "s.near").join(self.links, "word")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Vectors(*shared.value)
            for batch in batches:
                chosen = []
                for near, options in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    chosen.append(model.choose(options, near))
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(chosen, pa.string())], names=["paper_id", "ord", "word", "to"])
                yield out.filter(pa.array([c is not None for c in chosen], pa.bool_()))

        return asked.select("paper_id", "ord", "word", "near", "options").mapInArrow(run, "paper_id string, ord int, word string, to string")


def noise(blocks: DataFrame) -> DataFrame:
    """``paper_id, ord, noise``: every kind of noise of every block, once.

    Blocks without a text have none; of repeated and late rows of a block the latest counts; blocks without a place on
    the page are judged by type, words and the paper's other pages; an empty table gives no rows. A paper's first
    block is its title, no header.
    """
    r = Repair(blocks)
    broken = r.broken()
    shared = r.base.sparkSession.sparkContext.broadcast(r.known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keep = [joined_breaks(f"{a}-\n{b}", known)[1] for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["paper_id", "ord"])

    continued = r.ordered.where(GOES_ON)
    ends = r.ordered.where("before.tail is not null and head is not null and (lower or before.open)").select("paper_id", F.col("before.ord").alias("ord"), "before.tail", "head").mapInArrow(cut, "paper_id string, ord int")
    kind = lambda df, name: df.select("paper_id", "ord", F.lit(name).alias("noise"))
    out = kind(r.body.where("header"), "header")
    for df, name in (
        (r.body.where("page_number"), "page_number"),
        (broken.where("hyphen").select("paper_id", "ord").unionAll(ends), "hyphen"),
        (r.misread(broken), "misread"),
        (continued, "continued"),
    ):
        out = out.unionAll(kind(df, name))
    return out.dropDuplicates()


def paragraphs(blocks: DataFrame) -> DataFrame:
    """``paper_id, first_ord, blocks, text``: the repaired paragraphs of the papers, in order of ``first_ord``.

    Furniture is gone, broken words are joined, misread words put right in the case they had, lines reflowed, and
    blocks that go on with a paragraph are joined to it. Cases as for ``noise``.
    """
    r = Repair(blocks)
    broken = r.broken()
    fixes = r.misread(broken).groupBy("paper_id", "ord").agg(F.collect_set(F.struct("word", "to")).alias("fixes"))
    starts = r.ordered.withColumn("goes_on", F.expr(GOES_ON))
    chunked = starts.select("paper_id", "ord", "chunk", "goes_on")
    inside = Window.partitionBy("paper_id", "chunk").orderBy("ord")
    begun = chunked.withColumn("here", F.last(F.when(~F.col("goes_on"), F.col("ord")), ignorenulls=True).over(inside))
    ends = begun.groupBy("paper_id", "chunk").agg(F.max(F.when(~F.col("goes_on"), F.col("ord"))).alias("last"))
    handed = ends.withColumn("handed", F.last("last", ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).select("paper_id", "chunk", "handed")
    first = begun.join(handed, ["paper_id", "chunk"]).select("paper_id", "ord", F.coalesce("here", "handed", "ord").alias("first_ord"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, fixes in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                to = {f["word"]: f["to"] for f in fixes or ()}

                def put(m: re.Match) -> str:
                    new = to.get(m[0].lower())
                    return m[0] if new is None else new.capitalize() if m[0][:1].isupper() or text[: m.start()].rstrip()[-1:] in (".", "!", "?") else new

                out.append(re.sub(r"\s+", " ", _TOKEN.sub(put, text) if to else text).strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["paper_id", "ord", "first_ord", "text"])

    rows = broken.join(first, ["paper_id", "ord"]).join(fixes, ["paper_id", "ord"], "left").select("paper_id", "ord", "first_ord", "text", "fixes")
    fixed = rows.mapInArrow(run, "paper_id string, ord int, first_ord int, text string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return fixed.groupBy("paper_id", "first_ord").agg(F.count("*").alias("blocks"), F.regexp_replace(whole, r"(\p{L})[-‐‑¬\x{ad}] (?=\p{Ll})", "$1").alias("text"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of scanned papers with the kinds of noise in them."""
    return noise(table(spark, root, "paper_content_list"))


def p2_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The repaired, continuous paragraphs of all papers."""
    return paragraphs(table(spark, root, "paper_content_list"))
