import random

import pytest

from biblake.llm import scans

COLUMNS = "paper_id string, ord int, type string, text string, text_level int, page_idx int, bbox array<double>, extracted_at int, page int, header int"


def blocks(spark, rows):
    return spark.createDataFrame([(p, o, t, x, lv, pg, None if y is None else [50.0, float(y), 500.0, float(y) + 12], at, 1, 1) for p, o, t, x, lv, pg, y, at in rows], COLUMNS)


WORDS = "the solver improves magnetic currents over whole island when turbulent sediments were measured with coastal sensors before every campaign started and boundaries remain".split()


def corpus():
    rng, rows = random.Random(5), []
    for p in range(40):
        for o in range(1, 12):
            rows.append((f"clean{p}", o, "text", " ".join(rng.choice(WORDS) for _ in range(40)).capitalize() + ".", None, o // 4, 90 * (o % 4) + 100, 1))
    return rows


SCAN = [
    ("s", 0, "text", "Coastal Sensors of the Island", 1, 0, 90, 1), ("s", 1, "text", "The solver improves magnetic cur-\nrents over the wbole island. The boundaries remain and every cam-", None, 0, 100, 1), ("s", 2, "page_number", "7", None, 0, 800, 1),
    ("s", 3, "text", "COASTAL SENSORS OF THE ISL", None, 1, 30, 1), ("s", 4, "text", "paign started with sensors.", None, 1, 70, 1), ("s", 5, "text", "- 8 -", None, 1, 805, 1),
    ("s", 6, "text", "Coastal Sensrs of the Isl   9", None, 2, None, 1), ("s", 7, "text", "The data-driven solver improves\r\nCoastal Sensors of the Isl\r\nmagnetic currents.", None, 2, 100, 1), ("s", 8, "text", "iv", None, 3, None, 1), ("s", 9, "text", None, None, 3, 100, 1),
    ("s", 10, "text", "", None, 3, 100, 1), ("s", 11, "text", "The data-driven sensors improve magnetic sedi¬ments", None, 3, 200, 1), ("s", 11, "text", "old text-\nold", None, 3, 200, 0), (None, 1, "text", "7", None, 0, 800, 1),
]


@pytest.fixture(scope="module")
def made(spark):
    return blocks(spark, corpus() + SCAN + SCAN[:4])


def test_kinds_of_noise(made):
    found = {(r.ord, r.noise) for r in scans.noise(made).collect() if r.paper_id == "s"}
    assert found == {(1, "hyphen"), (1, "misread"), (2, "page_number"), (3, "header"), (4, "continued"), (5, "page_number"), (6, "header"), (6, "page_number"), (7, "header"), (8, "page_number"), (11, "hyphen")}
    assert not [r for r in scans.noise(made).collect() if r.paper_id != "s"]


def test_paragraphs_are_whole(made):
    out = {r.first_ord: r.text for r in scans.paragraphs(made).where("paper_id = 's'").collect()}
    assert out[1].replace("  ", " ") == "The solver improves magnetic currents over the whole island. The boundaries remain and every campaign started with sensors."
    assert out[7] == "The data-driven solver improves magnetic currents."


def test_empty_and_null_tables(spark, made):
    assert scans.noise(made.limit(0)).count() == 0
    assert scans.paragraphs(made.limit(0)).count() == 0
    assert scans.noise(blocks(spark, [("x", 0, None, None, None, None, None, None)])).count() == 0


def test_chunks_hand_over(spark, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK", 4)
    rows = [("v", o, "text", "begins here and goes on for some more words" if o % 2 else "Starts here and is open as it ends with no mark", None, o // 3, 100, 1) for o in range(1, 30)]
    body = scans.bodies(*(lambda b: (b, scans.furniture(b)))(scans.latest_blocks(blocks(spark, rows))))
    before = {r.ord: r.before and r.before.ord for r in scans.preceding(body).collect()}
    assert before == {o: o - 1 if o > 1 else None for o in range(1, 30)}


def test_headers_are_told_wherever_they_stand(spark):
    """However far the page is, and wherever the slips are; other lines are left."""
    rows = [("v", 0, "text", "Coastal Sensors of the Island", 1, 0, 90, 1), ("v", 1, "header", "Magnetic Currents and Glaciers", None, 1, 30, 1)]
    lines = {10: "Magnetic Currents and Glaciers", 11: "Maqnetic Curients amd Glaciers", 12: "Coastal Sensors of the Island", 13: "Turbulent sediments were measured", 14: "Magnetic currents and glaciers. Neither the solver nor"}
    rows += [("v", o, "text", x, None, 100 + 50 * o, None, 1) for o, x in lines.items()]
    found = scans.furniture(scans.latest_blocks(blocks(spark, rows))).collect()
    assert {(r.ord, *r.headers) for r in found} == {(10, 0), (11, 0), (12, 0)}


def test_likeness_against_brute_force(spark):
    rng, slips = random.Random(8), "abcdefgh"

    def slip(key):
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(key))
            key = rng.choice((key[:k] + key[k + 1 :], key[:k] + rng.choice(slips) + key[k:], key[:k] + rng.choice(slips) + key[k + 1 :]))
        return key

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def alike(a, b):
        return distance(a, b) <= scans.SLIPS and any(a[i : i + scans.RUN] in b for i in range(len(a) - scans.RUN + 1))

    heads = ["".join(rng.choice(slips) for _ in range(n)) for n in (9, 12, 16, 19, 20, 22, 24, 40)]
    asked = {o: slip(rng.choice(heads)) for o in range(100, 300)}
    rows = [("v", 1 + i, "header", h, None, i, 30, 1) for i, h in enumerate(heads)] + [("v", o, "text", x, None, o, None, 1) for o, x in asked.items()]
    found = {r.ord for r in scans.furniture(scans.latest_blocks(blocks(spark, rows))).collect() if r.headers}
    assert found == {o for o, x in asked.items() if any(alike(scans.line_key(x), scans.line_key(h)) and len(x) <= len(h) + scans.SLIPS for h in heads)}


def test_strokes_and_numbers():
    for a, b in (("rnodern", "modern"), ("wbole", "whole"), ("imagmg", "imaging"), ("expenment", "experiment"), ("b0th", "both"), ("clesign", "design"), ("reyersible", "reversible")):
        assert scans.skeleton(a) == scans.skeleton(b)
    assert scans.skeleton("fine") != scans.skeleton("time")
    assert [scans.number_of(t) for t in ("312", "- 107 -", "Page 3 of 9", "p. 2", "A-389", "l99", "viii", "ms.", "(1994).", "")] == [312, 107, 3, 2, 389, 199, 8, None, None, None]


def test_hyphens_that_stay():
    known = frozenset({"data-driven", "solver", "and", "pre", "sediments", "non", "negative"})
    assert scans.joined_breaks("data-\ndriven solver", known) == ("data-driven solver", False)
    assert scans.joined_breaks("sedi-\nments and pre- and", known) == ("sediments and pre- and", True)
    assert scans.joined_breaks("non-\nnegative", known)[1] is False
    assert scans.joined_breaks("Smith-\nJones", known)[1] is False
