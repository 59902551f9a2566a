"""Scoring abusive, hateful and sexually explicit passages.

Method: a classifier chain. One linear model per category, in a fixed order; each sees the words, neighbouring words and
word classes of a passage (``abuse_words``), which classes meet in it, and the probabilities of the categories before it.
In training those probabilities come from models that haven't seen the passage (out-of-fold), so that a later model
doesn't trust an earlier one more than it may.
Nobody labelled the corpus for this. The models learn from sentences made of the patterns in ``abuse_grammar``, innocent ones
among them (reports, quotations, technical and medical uses, harsh criticism), and then from passages of a bounded sample
of the corpus that have no suspicious word or on which the first models are sure (self-training); what was learned from the corpus is kept only if
it is no worse on held-out patterns.
Texts are read as a person reads them: spaced, masked, elongated and look-alike spellings are undone first.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, spread, table
from .abuse_grammar import ABUSIVE, INNOCENT
from .abuse_words import CLASSES

CATEGORIES = ("obscene", "insult", "threat", "hate", "sexual")
#: Self-training takes about ``SAMPLE`` documents, and of their passages at most ``PASSAGES`` with a suspicious word and
#: as many without, by hash.
SAMPLE, PASSAGES = 20_000, 4_000
#: Sentences made of each pattern; folds of the training; every how many-th pattern is held out.
EACH, FOLDS, HELD = 8, 2, 7
#: Ridge of single words and of classes: what holds for a class is to be learned for the class.
RIDGE = (1.0, 0.1)
#: Above the first the seed models are sure of a passage, below the second too; what is between teaches nothing.
SURE, CLEAR = 0.9, 0.05
THRESHOLD = 0.5
LONGEST, WINDOW, STEP = 26, 20, 8
#: Words scored at a time within a batch.
BLOCK = 200_000

#: The classes, and one more for passages with two words of reports or more.
NAMES = [*CLASSES, "REPORTS"]
#: Classes whose words speak of abuse, and those whose words are undone when disguised.
HOT = ("DEHUMAN", "INSULT", "SCORN", "PROFANE", "VIOLENCE", "DEATH", "SEXACT", "BODY", "NAKED", "LUST", "PORN", "MASK", "EXPLICIT", "PLACE", "GROUP")
DISGUISED = ("INSULT", "SCORN", "PROFANE", "VIOLENCE", "DEATH", "SEXACT", "BODY", "NAKED", "LUST", "PORN", "EXPLICIT", "DEHUMAN")
_MARKS = re.compile(r"[̀-ͯ]")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def folded(text: str) -> str:
    """Lower case, compatible forms unified, without marks and invisible signs."""
    text = text.lower()
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).replace("ß", "ss")
    return _MARKS.sub("", text).lower()


def _words(names: Iterable[str], languages: Iterable[str] | None = None) -> list[str]:
    return sorted({w for n in names for lang, ws in CLASSES[n].items() if languages is None or lang in languages for w in folded(ws).split() if not w.endswith("*")})


WORDS = frozenset(w for w in _words(DISGUISED) if w.isascii() and len(w) > 2)
MASKS: dict[str, int] = {}
STEMS: dict[str, int] = {}
for _bit, _name in enumerate(CLASSES):
    for _text in CLASSES[_name].values():
        for _w in folded(_text).split():
            held = STEMS if _w.endswith("*") else MASKS
            held[_w.rstrip("*")] = held.get(_w.rstrip("*"), 0) | 1 << _bit
HOT_MASK, REPORT_MASK = sum(1 << NAMES.index(n) for n in HOT), 1 << NAMES.index("REPORT")
#: Terms of scripts that are written without spaces.
_UNSPACED = re.compile("|".join(sorted((w for w in MASKS if re.search("[㐀-鿿]", w)), key=lambda w: (-len(w), w))))

#: Look-alike letters of other scripts, and signs written for letters.
_ALIKE = str.maketrans("аеорсухіјѕкмтвнԁɡαοερικν", "aeopcyxijskmtbhdgaoepikv")
_SIGNS = str.maketrans("013457@$!|", "oieastasil")
_MIXED, _MIXED_HINT = re.compile(r"[^\W\d_]+"), re.compile("[a-z][а-яёіјѕԁα-ω]|[а-яёіјѕԁα-ω][a-z]")
_CODE_HINT, _CODED = re.compile(r"[013457@$!|][a-z]|(?<=[a-z]{2})[013457@$]"), re.compile(r"[\w@$!|]+")
_SPACED_HINT = re.compile(r" [^\W\d_] [^\W\d_]")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?: [^\W\d_]){2,}(?!\w)")
_DOTTED_HINT = re.compile(r"[.\-_][^\W\d_][.\-_]")
_DOTTED = re.compile(r"(?<!\w)[^\W\d_](?:[.\-_][^\W\d_]){2,}(?!\w)|(?<!\w)(?:[^\W\d_]\.){2,}[^\W\d_]{2,}")
_MASKED = re.compile(r"(?<!\w)[^\W\d_]*\*+[^\W\d_*]*(?!\w)")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"(?<=[.!?。！？…])[\"'”’)\]]*\s+|(?<=[。！？])|\n\s*\n\s*")
_BY_SHAPE: dict[tuple[str, int, str], list[str]] = {}
for _w in sorted(WORDS):
    _BY_SHAPE.setdefault((_w[0], len(_w), _w[-1]), []).append(_w)


@lru_cache(maxsize=50_000)
def _decode(word: str) -> str:
    """A word with signs or digits for letters, if that gives a word of the lexicon or signs stand for most of it."""
    plain = word.strip("!|").translate(_SIGNS)
    if not re.search(r"[\d@$!|]", word.strip("!|")) or not re.fullmatch(r"[a-z]+", plain):
        return word
    for guess in (plain, plain.replace("v", "u"), plain.replace("i", "l"), plain.replace("z", "s")):
        if guess in WORDS or guess.rstrip("s") in WORDS:
            return guess
    return plain if len(word) > 3 and "$" in word else word


def _unspace(m: re.Match) -> str:
    joined = m[0].replace(" ", "")
    if joined in WORDS or joined[0] not in "ai":
        return joined
    return f"{joined[0]} {joined[1:]}" if joined[1:] in WORDS else joined


def _unmask(m: re.Match) -> str:
    word = m[0]
    shape = re.compile(word.replace("*", "[^\\W\\d_]"))
    if word[0] != "*" and word[-1] != "*":
        fits = [w for w in _BY_SHAPE.get((word[0], len(word), word[-1]), ()) if shape.fullmatch(w)]
    else:
        fits = [w for w in sorted(WORDS) if len(w) == len(word) and shape.fullmatch(w)]
    return f"{fits[0]} maskedword" if fits else "maskedword"


def _decoded(text: str) -> str:
    """The text with its coded words decoded; only these are looked at."""
    out, done = [], 0
    for m in _CODE_HINT.finditer(text):
        if m.start() < done:
            continue
        begin = max(done, text.rfind(" ", 0, m.start()) + 1, text.rfind("\n", 0, m.start()) + 1)
        end = min((e for e in (text.find(" ", m.end()), text.find("\n", m.end())) if e >= 0), default=len(text))
        out += [text[done:begin], _CODED.sub(lambda w: _decode(w[0]), text[begin:end])]
        done = end
    return "".join([*out, text[done:]])


def read(text: str) -> str:
    """The text as it is meant to be read, in lower case without marks, its ends of sentences kept."""
    low = text.lower()
    if not low.isascii():
        low = _INVISIBLE.sub("", low)
        if _MIXED_HINT.search(low):
            low = _MIXED.sub(lambda m: m[0].translate(_ALIKE) if _MIXED_HINT.search(m[0]) else m[0], low)
        low = folded(low)
        if re.search("[㐀-鿿]", low):
            low = _UNSPACED.sub(r" \g<0> ", low)
    if "  " in low:
        low = re.sub(r"[^\S\n]+", " ", low)
    if "*" in low:
        low = _MASKED.sub(_unmask, low)
    if _SPACED_HINT.search(low):
        low = _SPACED.sub(_unspace, low)
    if _DOTTED_HINT.search(low):
        low = _DOTTED.sub(lambda m: re.sub(r"[.\-_]", "", m[0]), low)
    if _CODE_HINT.search(low):
        low = _decoded(low)
    return _LONG.sub(r"\1", low)


_SYMBOL = re.compile("[\U0001f300-\U0001faff☀-➿]+")
#: A sentence that begins in lower case and runs, without a mark, into one that begins with a capital.
_RUN_ON = re.compile(r"((?:^|[.!?\n]\s*)[a-zà-öø-ÿ$@*][^.!?\n]*?\s)(?=[A-ZÀ-ÖØ-Þ])")
_WORD = re.compile(r"\w+")


def unmerged(text: str) -> str:
    """The text with marks where sentences run into each other."""
    if not text.isascii():
        text = _SYMBOL.sub(" . ", text)
    return _RUN_ON.sub(r"\1. ", text)


def passages(text: str) -> Iterator[list[str]]:
    """Words of each sentence; sentences of more than ``LONGEST`` words, whose ends may be missing, in overlapping windows."""
    for sentence in _END.split(read(unmerged(text))):
        words = _WORD.findall(sentence)
        if len(words) <= LONGEST:
            if words:
                yield words
            continue
        for at in range(0, len(words) - WINDOW + STEP, STEP):
            yield words[at : at + WINDOW]


def class_mask(word: str) -> int:
    """The classes of a word, as bits."""
    mask = MASKS.get(word, 0)
    if STEMS:
        for n in range(4, len(word)):
            mask |= STEMS.get(word[:n], 0)
    return mask


def suspicious(words: list[str]) -> bool:
    """Whether any word speaks of abuse in some company."""
    return any(MASKS.get(w, 0) & HOT_MASK for w in words)


_SLOT = re.compile(r"\{([^{}]+)\}")
#: Words that sentences begin or end with and that mean nothing here.
_BEFORE = ("honestly", "by the way", "as always", "well", "in my opinion", "today", "and", "so", "after reading this {CRIT}", "when {PERSON} reads this", "about the {CRIT}", "i have seen the {CRIT}")
_AFTER = (
    "at the {conference|institute|seminar|banquet}", "so i reject {your|their} {CRIT}", "before submitting {this|that} {CRIT}", "during the {talk|coffee break}", "in the {corridor|office|lab}", "on {any|their} {CRIT}", "of {our|that} {institute|department}",
    "says the {PERSON}", "with {their|our} {TECH}", "and {PERSON} {saw|filmed} it", "for {good|ever}", "instead of {publishing|reading}",
)


_SYLLABLES = ("ka", "zo", "mir", "ba", "tel", "du", "vor", "sha", "pel", "qui")


def _made(pattern: str, language: str, rng: random.Random, company: float = 0.3) -> list[str]:
    """Words of a sentence made of a pattern; English ones often in the company of other words that change nothing."""
    if language == "en":
        pattern = f"{rng.choice(_BEFORE)} {pattern}" if rng.random() < company else pattern
        pattern = f"{pattern} {rng.choice(_AFTER)}" if rng.random() < company else pattern

    def fill(m: re.Match) -> str:
        if m[1] == "GROUP" and rng.random() < 0.15:  # a people nobody has heard of
            return "the " * (language == "en") + "".join(rng.choice(_SYLLABLES) for _ in range(2)) + rng.choice(("i", "ans", "os", "ers"))
        if m[1] in CLASSES:
            words = CLASSES[m[1]].get(language) or CLASSES[m[1]]["en"]
            return rng.choice([w for w in words.split() if not w.endswith("*")])
        return rng.choice(m[1].split("|"))

    text = pattern
    while _SLOT.search(text):
        text = _SLOT.sub(fill, text)
    return _WORD.findall(folded(text))


def _patterns(text: str) -> list[str]:
    """The patterns of a block: parted by lines and by bars outside of slots."""
    return [p.strip() for line in text.strip().splitlines() for p in re.split(r"\|(?![^{]*\})", line) if p.strip()]


def seeds(each: int = EACH, seed: int = 11) -> list[tuple[list[str], tuple[int, ...], int]]:
    """Sentences made of all patterns: words, labels by category, and the number of the pattern."""
    rng, rows, number = random.Random(seed), [], 0
    for language, block in ABUSIVE.items():
        for pattern in _patterns(block):
            letters, _, body = pattern.partition(" ")
            labels = tuple(int(c[0] in letters) for c in CATEGORIES)
            rows += [(_made(body, language, rng), labels, number) for _ in range(each)]
            number += 1
    for language, block in INNOCENT.items():
        bad = [p.partition(" ")[2] for p in _patterns(ABUSIVE[language])]
        for pattern in _patterns(block):
            rows += [(_made(pattern.replace("ABUSE", rng.choice(bad)), language, rng), (0,) * len(CATEGORIES), number) for _ in range(3 * each if "ABUSE" in pattern else each)]
            number += 1
    return rows


class Chain:
    """Linear models in a row over counts of words and word pairs, classes and pairs of classes."""

    def __init__(self, words: dict[str, int], pairs: np.ndarray, weights: np.ndarray, chained: np.ndarray, bias: np.ndarray):
        #: words of the vocabulary are numbered from 1; pairs: sorted keys of neighbouring words; weights: words, pairs, classes, pairs of classes
        self.words, self.pairs, self.weights, self.chained, self.bias = words, pairs, weights, chained, bias
        n, c = len(words) + 1, len(NAMES)
        self.of_word, self.of_pair = weights[:n], weights[n : n + len(pairs)]
        self.of_class = weights[n + len(pairs) : n + len(pairs) + c]
        self.of_meeting = weights[n + len(pairs) + c :].reshape(c, c, -1)
        self.codes: dict[str, tuple[int, int]] = {}

    def code(self, word: str) -> tuple[int, int]:
        """A word's number in the vocabulary (0 if it isn't there) and its classes."""
        if len(self.codes) > 500_000:
            self.codes.clear()
        found = self.codes[word] = (self.words.get(word, 0), class_mask(word))
        return found

    def encode(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and classes of all words of the rows, one after the other, and where each row begins. Rows are not empty."""
        known, code = self.codes, self.code
        both = np.array([known.get(w) or code(w) for row in rows for w in row], np.int64).reshape(-1, 2)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return both[:, 0], both[:, 1], np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def pair_ids(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For every word but the last the number of its pair with the next one, or -1; none reaches over the end of a row."""
        keys = ids[:-1] * (len(self.words) + 1) + ids[1:]
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        good = (self.pairs[at] == keys) if len(self.pairs) else np.zeros(len(keys), bool)
        good[starts[1:] - 1] = False
        return np.where(good, at, -1)

    def logits(self, rows: list[list[str]]) -> np.ndarray:
        ids, masks, starts = self.encode(rows)
        z = np.add.reduceat(self.of_word[ids], starts, axis=0)
        pairs = self.pair_ids(ids, starts)
        hit = np.flatnonzero(pairs >= 0)
        row = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(ids))))
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(row[hit], self.of_pair[pairs[hit], k], len(rows))
        bits = met(masks, starts).astype(np.float32)
        z += bits @ self.of_class
        for k in range(z.shape[1]):
            z[:, k] += np.einsum("ij,ij->i", bits @ self.of_meeting[:, :, k], bits)
        return z + self.bias

    def probabilities(self, rows: list[list[str]]) -> np.ndarray:
        """A probability per row and category."""
        if not rows:
            return np.zeros((0, len(CATEGORIES)))
        z = self.logits(rows)
        out = np.zeros_like(z)
        for k in range(z.shape[1]):
            out[:, k] = _sigmoid(z[:, k] + out[:, :k] @ self.chained[k, :k])
        return out

    @classmethod
    def train(cls, rows: list[tuple[list[str], tuple[int, ...], float]], steps: int = 90) -> Chain:
        """rows: words (not empty), labels, weight."""
        often = Counter(w for words, _, _ in rows for w in set(words))
        words = {w: i for i, w in enumerate(sorted(w for w, n in often.items() if n > 3), 1)}
        empty = cls(words, np.zeros(0, np.int64), np.zeros((len(words) + 1 + len(NAMES) * (len(NAMES) + 1), len(CATEGORIES)), np.float32), np.zeros((len(CATEGORIES),) * 2), np.zeros(len(CATEGORIES)))
        ids, masks, starts = empty.encode([r[0] for r in rows])
        n, c = len(rows), len(NAMES)
        row = np.repeat(np.arange(n), np.diff(np.append(starts, len(ids))))
        inside = np.ones(max(len(ids) - 1, 0), bool)
        inside[starts[1:] - 1] = False
        keys, counts = np.unique((ids[:-1] * (len(words) + 1) + ids[1:])[inside & (ids[:-1] > 0) & (ids[1:] > 0)], return_counts=True)
        pairs = keys[counts > 3]
        first = cls(words, pairs, np.zeros((len(words) + 1 + len(pairs) + c * (c + 1), len(CATEGORIES)), np.float32), np.zeros((len(CATEGORIES),) * 2), np.zeros(len(CATEGORIES)))
        found = first.pair_ids(ids, starts)
        hit = np.flatnonzero(found >= 0)
        bits = met(masks, starts)
        of_class = np.nonzero(bits)
        meeting = np.nonzero(np.triu(bits[:, :, None] * bits[:, None, :], 1).reshape(n, c * c))
        at = len(words) + 1
        known = ids > 0
        r = np.concatenate([row[known], row[hit], of_class[0], meeting[0]])
        f = np.concatenate([ids[known], at + found[hit], at + len(pairs) + of_class[1], at + len(pairs) + c + meeting[1]])
        order = np.argsort(r, kind="stable")
        d = at + len(pairs) + c + c * c
        sparse = Sparse(r[order], f[order], n, d, at + len(pairs))
        y, weight = np.array([x[1] for x in rows], float), np.array([x[2] for x in rows], float)
        # folds by the rows' own words, so that they don't depend on the order of rows
        fold = np.array([hash_of(" ".join(x[0])) % FOLDS for x in rows])
        weights, chained, bias = np.zeros((d, len(CATEGORIES)), np.float32), np.zeros((len(CATEGORIES),) * 2), np.zeros(len(CATEGORIES))
        unseen = np.zeros((n, len(CATEGORIES)))  # probabilities of models that haven't seen the row
        for k in range(len(CATEGORIES)):
            for out in range(FOLDS if k + 1 < len(CATEGORIES) else 0):  # nobody asks the last one
                w, v, b = sparse.fit(unseen[:, :k], y[:, k], weight * (fold != out), steps)
                rest = fold == out
                unseen[rest, k] = _sigmoid(sparse.product(w) + unseen[:, :k] @ v + b)[rest]
            w, v, b = sparse.fit(unseen[:, :k], y[:, k], weight, steps)
            weights[:, k], chained[k, :k], bias[k] = w, v, b
        return cls(words, pairs, weights, chained, bias)


def met(masks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The classes that each row has a word of, as zeros and ones."""
    bits = np.bitwise_or.reduceat(masks, starts)[:, None] >> np.arange(len(NAMES)) & 1
    bits[:, -1] = np.add.reduceat((masks & REPORT_MASK > 0).astype(np.int64), starts) > 1
    return bits


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """A matrix of ones in rows ``r`` (ascending) and columns ``f``; columns from ``general`` on are classes, no single words."""

    def __init__(self, r: np.ndarray, f: np.ndarray, n: int, d: int, general: int):
        self.r, self.f, self.n, self.d = r, f, n, d
        self.ridge = np.full(d, RIDGE[0])
        self.ridge[general:] = RIDGE[1]

    def product(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, w[self.f], self.n)

    def fit(self, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Logistic weights of the columns and of ``extra``, and the constant, with a ridge; Adam on all rows at once."""
        w, v = np.zeros(self.d), np.zeros(extra.shape[1] + 1)
        x = np.column_stack([extra, np.ones(self.n)])
        moments = [np.zeros(self.d), np.zeros(self.d), np.zeros(len(v)), np.zeros(len(v))]
        for t in range(1, steps + 1):
            e = (_sigmoid(self.product(w) + x @ v) - y) * weight
            for k, grad in ((0, np.bincount(self.f, e[self.r], self.d) + self.ridge * w), (2, x.T @ e + 0.3 * np.append(v[:-1], 0))):
                moments[k] = 0.9 * moments[k] + 0.1 * grad
                moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * grad**2
            rate = 0.2 * (1 - 0.9 * t / steps)
            step = lambda k: rate * moments[k] / (1 - 0.9**t) / (np.sqrt(moments[k + 1] / (1 - 0.99**t)) + 1e-8)
            w, v = w - step(0), v - step(2)
        return w, v[:-1], float(v[-1])


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def right(chain: Chain, rows: list[tuple[list[str], tuple[int, ...], int]]) -> float:
    """The share of rows that are rightly told abusive or not."""
    p = chain.probabilities([r[0] for r in rows]).max(1) >= THRESHOLD
    return float(np.mean(p == np.array([any(r[1]) for r in rows])))


def weak_labels(words: list[str], p: np.ndarray) -> tuple[int, ...] | None:
    """What a passage of the corpus teaches: without a suspicious word it is clean, else what the seed models are sure of; None if they aren't."""
    if not suspicious(words):
        return (0,) * len(CATEGORIES)
    if any(MASKS.get(w, 0) & REPORT_MASK for w in words):
        return None  # perhaps a report or quotation of abuse
    return tuple(int(v >= THRESHOLD) for v in p) if p.max() >= SURE or p.max() < CLEAR else None


def corpus_passages(documents: DataFrame, key: str, text: str, sample: int = SAMPLE, most: int = PASSAGES) -> list[list[str]]:
    """Passages of about ``sample`` documents: at most ``most`` with a suspicious word and ``most`` without.

    Those of the least hashes of key and number are taken, so a passage that many documents have is taken more often;
    which ones doesn't depend on order, batches or partitions.
    """
    n = documents.count()
    share = int(min(1.0, sample / max(n, 1)) * 1_000_000)
    some = documents.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share).select(F.col(key).cast("string").alias("key"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(" ".join(p), suspicious(p), hash_of(f"{k} {i}") >> 1) for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, p in enumerate(passages(value or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))], names=["words", "hot", "h"])

    rows = materialize(some.mapInArrow(run, "words string, hot boolean, h bigint"))
    # at most ``most`` rows of each kind reach the driver
    taken = [r for hot in (True, False) for r in rows.where(F.col("hot") == hot).orderBy("h", "words").limit(most).collect()]
    return [r.words.split(" ") for r in sorted(taken, key=lambda r: (r.h, r.words))]


_LEARNED: dict[tuple, Chain] = {}


def learn(documents: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Chain:
    """The chain, trained on the seeds and on passages of about ``sample`` documents that seed models are sure of.

    Kept for the session and the plan of ``documents``, so that several queries train it once.
    """
    held = (documents.sparkSession.sparkContext.applicationId, documents.select(key, text).semanticHash(), sample)
    if held in _LEARNED:
        return _LEARNED[held]
    made = seeds()
    teach, asked = [r for r in made if r[2] % HELD], [r for r in made if not r[2] % HELD]
    first = Chain.train([(w, y, 1.0) for w, y, _ in teach])
    found = corpus_passages(documents, key, text, sample)
    p = first.probabilities(found)
    sure = [(w, y, 0.5 if any(y) else 1.0) for w, q in zip(found, p) if (y := weak_labels(w, q)) is not None]
    second = Chain.train([(w, y, 1.0) for w, y, _ in teach] + sure) if sure else first
    # what the corpus taught is kept if it does no harm to held-out patterns; the held-out ones are learned last
    kept = sure if right(second, asked) >= right(first, asked) - 0.01 else []
    chain = Chain.train([(w, y, 1.0) for w, y, _ in made] + kept)
    if len(_LEARNED) > 8:
        _LEARNED.clear()
    _LEARNED[held] = chain
    return chain


def score(documents: DataFrame, key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """``key, score`` and a probability per category: the most that any passage of the text reaches.

    ``score`` is the largest of them. Every passage is scored. Null, empty and blank texts score 0; texts of any length
    are read whole; repeated rows give repeated rows; an empty table gives no rows.
    """
    chain = learn(documents, key, text, sample)
    shared = documents.sparkSession.sparkContext.broadcast((chain.words, chain.pairs, chain.weights, chain.chained, chain.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(*shared.value)
        for batch in batches:
            most = np.zeros((batch.num_rows, len(CATEGORIES)))
            rows, owners, held = [], [], 0

            def settle() -> None:
                if rows:
                    np.maximum.at(most, np.array(owners), model.probabilities(rows))

            for i, value in enumerate(batch.column(1).to_pylist()):
                for p in passages(value or ""):
                    rows.append(p), owners.append(i)
                    held += len(p)
                    if held > BLOCK:
                        settle()
                        rows, owners, held = [], [], 0
            settle()
            columns = [pa.array(most[:, k], pa.float64()) for k in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most.max(1, initial=0.0), pa.float64()), *columns], names=[key, "score", *CATEGORIES])

    rows = spread(documents.select(key, text), [key])
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, score double, " + ", ".join(f"{c} double" for c in CATEGORIES))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit passage."""
    return score(table(spark, root, "documents"), "doc_id", "text").where(f"score >= {THRESHOLD}").select("doc_id")


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    """The score of every document, by category."""
    return score(table(spark, root, "documents"), "doc_id", "text")


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of such documents by source."""
    documents = table(spark, root, "documents")
    scored = score(documents, "doc_id", "text").select("doc_id", "score")
    return (
        documents.select("doc_id", "source").join(scored, "doc_id").groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("found"), F.round(F.avg((F.col("score") >= THRESHOLD).cast("double")), 4).alias("rate"))
    )
