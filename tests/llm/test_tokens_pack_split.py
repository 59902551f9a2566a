import base64
import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

from biblake.llm import pack, split, tokens

TEXTS = ["", None, " ", "Hello  world\n\n it's 12345 <|endoftext|>", "数据模型与网格。" * 30, "a" * 5000, "xyzzy" * 700 + " é🎉​", "\t\r\n  mixed　space ", "ab" * 47 + "c", "don't we'll"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_scan_and_heap_agree_with_the_public_encoder(reference):
    rng, encoder = random.Random(1), tokens.Encoder(tokens.vocabulary_bytes())
    for n in (1, 2, 3, 50, 96, 97, 400):
        for alphabet in ("ab", "etaoin", "数据模型é🎉"):
            word = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert encoder._scan(word) == encoder._heap(word)
    for text in TEXTS:
        assert encoder.encode(text) == reference.encode_ordinary(text or "")


def test_encode_whole_table_with_clashing_columns(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "x"), (None, "no key", "x")]
    out = tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in out) == sorted((i if i is not None else -1, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_containers_hold_everything_once(spark, reference):
    rng = random.Random(2)
    texts = [" word" * rng.choice([0, 1, 5, 40, 90, 130]) for _ in range(400)] + TEXTS + TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    out = pack.pack(df, "doc_id", "text", capacity=128, windows=4)
    pieces = out.collect()
    got = {}
    for r in sorted(pieces, key=lambda r: r.piece):
        assert r.container_id is not None and r.start_token == got.get(r.doc_id, 0) and r.piece * 128 == r.start_token
        got[r.doc_id] = r.start_token + r.n_tokens
    sizes = {i: len(reference.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert got == sizes
    fill = {}
    for r in pieces:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 128
    assert sum(sizes.values()) / (128 * len(fill)) > 0.9
    assert pack.pack(df.limit(0), "doc_id", "text").count() == 0


def test_leftovers_merge_over_rounds(spark):
    bins = spark.createDataFrame([((t << 32) + k, 1 + (t * 7 + k) % 9) for t in range(300) for k in range(3)], "bin bigint, fill int")
    merged = pack.merge_leftovers(bins, 10, 3)
    fills = merged.join(bins, "bin").groupBy("into").agg(F.sum("fill").alias("n")).collect()
    assert merged.count() == merged.select("bin").distinct().count() == 900
    total = sum(r.n for r in fills)
    assert max(r.n for r in fills) <= 10 and total == sum(r.fill for r in bins.collect()) and len(fills) <= 1.7 * total / 10 + 3  # the known guarantee of bounded best fit


def brute(text, limit):
    paragraphs = re.split(r"\n[^\S\n]*\n\s*", text)
    if max(map(len, paragraphs)) <= limit:
        return "paragraph"
    if max(len(s) for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)) <= limit:
        return "sentence"
    return "word" if max(map(len, re.split(r"\s+", text))) <= limit else "none"


def test_pieces_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["ab", "c", " ", ". ", "! ", "\n", "\n\n", "\n \n", "xyzxyzxyzxyz", "é🎉"]) for _ in range(rng.randint(0, 120)))
        limit = rng.choice([8, 15, 30])
        overlap = rng.randint(0, limit // 3)
        needed, cut = split.pieces(text, limit, overlap)
        if len(text) > limit:
            assert split.NAMES[needed] == brute(text, limit)
        cuts, strengths, _ = split.boundaries(text)
        strength = dict(zip(cuts, strengths))
        at, begun = 0, 0
        for k, (a, b, kind) in enumerate(cut):
            assert b - a <= limit and b > at
            assert a == (max(begun, at - overlap) if k else 0)
            if b < len(text):
                window = [(strength[p], p) for p in range(at + 1, a + limit + 1) if p in strength]
                late = [x for x in window if x[1] > a + limit // 2]
                # the later half of the window, or all of it for a cut of the kind that suffices
                if window and (not late or max(late)[0] < needed <= max(window)[0]):
                    late = [x for x in window if x[1] <= max(at, a + limit // 2)]
                assert (kind, b) == (max(late) if late else (0, a + limit))
            at, begun = b, a
        assert at == len(text)


def test_split_sections_cases(spark):
    md = "# A\n\n" + "word " * 10 + "\n\n" + "x" * 50
    sections = [
        ("p", 0, "A", 0, 30, 1, 9), ("p", 0, "old", 0, 5, 0, 9), ("p", 1, " ", 30, None, 1, 9), ("p", 1, " ", 30, None, 1, 9),
        ("p", 2, None, 57, 9999, 1, 9), ("p", 3, "empty", 40, 40, 1, 9), ("p", 4, "null", None, 3, 1, 9), ("q", 0, "no text", 0, 3, 1, 9),
    ]
    s = spark.createDataFrame(sections, "paper_id string, ord int, title string, start_offset int, end_offset int, generated_at int, md int")
    m = spark.createDataFrame([("p", md, 2), ("p", md, 2), ("p", "older", 1), ("r", None, 1)], "paper_id string, md string, generated_at int")
    out = split.split_sections(s, m, 20, 4).collect()
    assert all(r.text == md[r.start : r.end] and len(r.text) <= 20 for r in out)
    by = {(r.ord, r.piece): r for r in out}
    assert len(by) == len(out) and {r.ord for r in out} == {0, 1, 2}
    assert by[0, 0].title == "A" and by[0, 0].span == 30 and by[1, 0].title == " " and by[2, 0].boundary == "none" and by[2, 0].title is None
    assert max(r.end for r in out if r.ord == 1) == 57  # a null end: the next section's start
    assert split.split_sections(s.limit(0), m, 20, 4).count() == 0 and split.split_sections(s, m.limit(0), 20, 4).count() == 0
    with pytest.raises(ValueError):
        split.pieces("abc", 2, 2)


def test_pieces_are_no_shorter_than_half_while_a_cut_suffices():
    text = "Short one.\n\n" + "A sentence of some words goes on here. " * 300
    needed, cut = split.pieces(text, 3000, 200)
    assert needed == split.SENTENCE and all(b - a > 1500 for a, b, _ in cut[:-1]) and all(b - a <= 3000 for a, b, _ in cut)
    # a paragraph break suffices for this text, so it is used though it comes early
    text = "x" * 1000 + "\n\n" + ("y" * 50 + ". ") * 55 + "\n\n" + "z" * 2000
    needed, cut = split.pieces(text, 3000, 200)
    assert needed == split.PARAGRAPH and cut[0] == (0, 1002, split.PARAGRAPH)
