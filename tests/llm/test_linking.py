import itertools
import random

import numpy as np
import pytest

from biblake.llm import canonical, match, names

VENUES = [(1, "Journal of Algebraic Imaging", "JALIM", 1), (2, "Archive for Soil Visualization", "ASOVI", 1), (3, None, "NONAME", 1), (4, "Workshop on Urban Dynamics", None, 2)]
CATEGORIES = [(1, "journal article"), (2, "conference paper"), (7, "book"), (9, "thesis"), (10, "other"), (11, None)]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(VENUES, "venue_id int, name string, short_name string, category_id int"), spark.createDataFrame(CATEGORIES, "category_id int, name string")


def test_mapping(spark, lists):
    cases = {
        "Journal of Algebraic Imaging": 1, "J. Algebr. Imag.": 1, "Imaging, Journal of Algebraic": 1, "in: Jornal of Algebriac Imaging, vol. 3": 1, "Journal_of_Algebraic_Imaging": 1, "Journal of Algebraic Imaging (JALIM)": 1, "J.A.L.I.M.": 1, "jalim '04": 1,
        "Journal of Soil Imaging": 0, "Archive for Algebraic Imaging": 0, "Journal of Taxidermy": 0, "to appear": 0, "n/a": 0, "noname": 3, "workshop on urban dyn.": 4, "x" * 5000: 0,
    }
    rows = [(f"p{i}", v, None, " ", "x") for i, v in enumerate(cases)] + [("p0", "Journal of Algebraic Imaging", None, None, "x"), ("n", None, None, None, "x"), (None, "JALIM", None, None, "x")]
    bib = spark.createDataFrame(rows, "paper_id string, venue string, venue_short string, category string, ref_id string")
    got = {(r.paper_id, r.field): r.ref_id for r in canonical.map_values(bib, *lists).collect()}
    assert {v: got[f"p{i}", "venue"] for i, v in enumerate(cases)} == cases
    assert len(got) == len(cases) + 1 and ("n", "venue") not in got
    assert canonical.map_values(bib.limit(0), *lists).count() == 0
    assert {r.ref_id for r in canonical.map_values(bib, lists[0].limit(0), lists[1].limit(0)).collect()} == {0}


def test_long_names_and_many_expansions_of_a_word():
    """No cap on words of a name or on what an abbreviation may stand for."""
    many = [(i, f"Journal of Con{x}tics", None) for i, x in enumerate("abcdefghijklmnop")] + [(99, "Journal of " + " ".join(f"Word{x}ing" for x in "abcdefghijklmnopq"), None)]
    names_ = canonical.Names(many, {5: 3})
    assert names_("Journal of Con.") == 5  # all fit, the most frequent is meant
    assert names_("Journal of " + " ".join(f"Word{x}ing" for x in "abcdefghijklmnopq")) == 99
    assert names_("Journal of Conptics") == 15


def test_labels():
    labels = canonical.Labels([c for c in CATEGORIES], {})
    assert [labels(x) for x in ("Journal artcle", "monograph", "Ph.D. dissertation", "othr", "slides", "dataset", "???", "article in journal")] == [1, 7, 9, 10, 0, 0, 0, 1]


def test_symmetric_deletes_against_brute_force():
    words = ["journal", "imaging", "review", "soil", "systems", "symposium"]
    speller = canonical.Speller(words)
    for typed in ("jounral", "imging", "reviw", "siol", "systmes", "sypmosium", "joruanl", "xyz", "soils"):
        most = canonical.allowed(typed)
        brute = {w for w in words if canonical.distance(typed, w) <= min(most, canonical.allowed(w))}
        assert set(speller.near(typed)) <= {w for w in words if canonical.distance(typed, w) <= 2}
        assert {w for w in brute if canonical.distance(typed, w) <= 1} <= set(speller.near(typed))


SPELLINGS = {
    "a": ["Frederick Öldermarsk", "Öldermarsk, F. H.", "ÖLDERMARSK, Frederick", "Fred Öldermarsk", "Öldermarsk Frederick", "Frederick  Oldermarsk*", "Frederick Öldrmarsk", "F. Öldermarsk", "Öldermarsk FH", "Dr. Frederick Hugo Öldermarsk", "Öldermarsk, Frederick [Some Lab]"],
    "b": ["Zoltan Öldermarsk", "Z. Öldermarsk"], "c": ["Wei Thovumars", "Thovumars, Wei"], "d": ["Mei Thovumars", "Thovumars, M."], "e": ["Tamyvisch Collaboration", "on behalf of the Tamyvisch collaboration", "Tamyvisch Collab."],
    "f": ["Ines van der Kilvanmas-Brost", "van der Kilvanmas-Brost, I.", "Ines van der Kilvanmas Brost"], "g": ["Hugo Garskanasch"], "h": ["Hugo Garskanasch-Tondenis"],
}


def test_spellings_of_names(spark):
    more = [(f"x{i}", [f"{g} Name{i}ovich"]) for i, g in enumerate(["Frederick", "Zoltan", "Wei", "Mei", "Ines", "Hugo"] * 6)]
    rows = [(f"p{i}", [n, None, " ", ""]) for i, n in enumerate(itertools.chain(*SPELLINGS.values()))] + [("p0", [SPELLINGS["a"][0]] * 3), ("n", None), ("e", [])] + more
    linked = {r.name: r.entity for r in names.link_names(spark.createDataFrame(rows, "paper_id string, authors array<string>")).collect()}
    groups = {}
    for key, spelt in SPELLINGS.items():
        assert len({linked[s] for s in spelt}) == 1, (key, [(s, linked[s]) for s in spelt])
        groups[key] = linked[spelt[0]]
    assert len(set(groups.values())) == len(groups)
    assert None not in linked and " " not in linked
    assert names.link_names(spark.createDataFrame([], "paper_id string, authors array<string>")).count() == 0


def test_slips_in_given_names_that_recur(spark):
    tails = [a + b for a in ("brok", "durm", "feld", "garv", "hilt", "kest", "lomp", "mand") for b in ("anich", "essoul", "ivart", "ontes", "ulsen", "yrdam")]
    rows = [(f"p{i}", [f"Jonas {t.title()}"]) for i, t in enumerate(tails)] + [(f"q{i}", [f"Joans {t.title()}"]) for i, t in enumerate(tails[::8])]
    rows += [(f"r{i}", [f"{g} {t.title()}"]) for g in ("Mario", "Maria") for i, t in enumerate(tails[:20])]
    linked = {r.name: r.entity for r in names.link_names(spark.createDataFrame(rows, "paper_id string, authors array<string>")).collect()}
    assert all(linked[f"Joans {t.title()}"] == linked[f"Jonas {t.title()}"] for t in tails[::8])
    assert all(linked[f"Mario {t.title()}"] != linked[f"Maria {t.title()}"] for t in tails[:20])


def test_similar_pairs_against_brute_force(spark):
    words = ["oldermarsk", "oldrmarsk", "oldermrask", "kilvanmas", "kilvanma", "thovumars", "tohvumars", "abc", "abd", "xyz"]
    df = spark.createDataFrame([(w,) for w in words], "word string")

    def grams(w):
        p = f"##{w}##"
        return {p[i : i + 3] for i in range(len(w) + 2)}

    def close(a, b):
        x, y = grams(a), grams(b)
        return len(x & y) / len(x | y) >= names.SIMILAR

    found = {(r.a, r.b) for r in names.similar_pairs(df).collect()}
    brute = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if close(a, b) and canonical.distance(a, b) <= 1}
    assert brute <= found


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x")]
    labels = {r.node: r.label for r in names.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {labels[f"n{i:03d}"] for i in range(41)} == {"n000"} and labels["y"] == "x"


BIB = [
    ("p1", "Magnetic Scheme for Crop Phenology, Part I", ["Olga Begontes", "Frederick Öldermarsk"], 2001, None, 1), ("p2", "Magnetic Scheme for Crop Phenology, Part II", ["Olga Begontes", "Frederick Öldermarsk"], 2001, None, 1),
    ("p3", "Editorial", ["Marek Brulost"], 1999, None, 1), ("p4", "Editorial", ["Hana Tirkovel"], 1999, None, 1), ("p5", "Toward Robust Nutrients with the Vilkox Canopy: Evidence from Sparse Tensors", ["Ivana Skolt", "Pavel Grymm"], 2010, None, 1),
    ("p6", None, None, None, None, 1), ("p7", "Sparse Tensors in the Merzeim Ridge", None, 2005, None, 1), ("p1", "Old Title of It", ["Nobody"], 1990, None, 0),
]
RECORDS = [
    (1, "MAGNETIC SCHEME FOR CROP PHENOLOGY, PT. I", ["Begontes, O.", "et al."], 2001, None, 1), (2, "<i>Magnetic Schme for Crop Phenology, Part II</i>", ["O. Begontes", "F. Öldermarsk"], 2002, None, 1), (3, "Magnetic Scheme for Crop Phenology, Part III", ["Olga Begontes", "Frederick Öldermarsk"], 2001, None, 1),
    (4, "Editorial", ["Tirkovel, Hana"], 1999, None, 1), (5, "Editorial", ["Someone Else"], 1999, None, 1), (6, "Evidence from Sparse Tensors", ["Ivana Skolt", "Pavel Grymm"], 2010, None, 1), (7, "Toward Robust Nutrients with the...", ["I. Skolt", "P. Grymm"], None, "2010-05", 1),
    (8, None, None, None, None, 1), (9, "Sparse tensors in Merzeim ridge", ["Any Body"], 2005, None, 1), (9, "Sparse tensors in Merzeim ridge", ["Any Body"], 2005, None, 1), (10, "Something wholly different", ["Olga Begontes"], 2001, None, 1),
]


def test_matching_records(spark):
    bib = spark.createDataFrame([(*r, 7) for r in BIB], "paper_id string, title string, authors array<string>, year int, publication_date string, ingested_at int, r int")
    rec = spark.createDataFrame([(*r, 7) for r in RECORDS], "record_id bigint, title string, authors array<string>, year int, publication_date string, fetched_at int, paper_id int")
    out = match.match(bib, rec)
    got = {(r.paper_id, r.record_id) for r in out.collect()}
    assert got == {("p1", 1), ("p2", 2), ("p4", 4), ("p5", 6), ("p5", 7), ("p7", 9)}
    assert out.count() == len(got) and out.where("confidence < 0.5 or confidence > 1").count() == 0
    assert match.match(bib.limit(0), rec).count() == 0 and match.match(bib, rec.limit(0)).count() == 0


SLIPS = [
    ("Sparse Tensors Beside Harbor", ["Olga Begontes"], 2001, "Sparse Tnesors Beside Harobr", ["Olga Begontes"], 2001),  # no two neighbouring words
    ("Photonic Glacier Estuary", ["Ivana Skoltarm"], 2003, "Photonic Glcaier Estuary", ["I. Skoltarm"], 2004),  # the middle word of three
    ("Modular Archive Currents", ["Pavel Grymmont"], None, "Modular Arhcive Currents", ["Pavel Grymmont"], 2010),
    ("Implicit Enzyme Aerosols Lattice Canyon", ["Hana Tirkovel"], 2012, "Implcit Enzyme Aerosols Lattcie Canyon", ["Hana Trikovel"], 2012),  # the surname too
]


def pairs_by_force(bib, records, cover, top):
    """What ``retrieve`` must give, from the indexed rows alone."""
    papers, found = match.prepared(bib, "paper_id", "ingested_at"), match.prepared(records, "record_id", "fetched_at")
    words = match.vocabulary(papers, found, papers.count())
    ps, rs = match.indexed(papers, words).collect(), match.indexed(found, words).collect()
    mean, out = sum(len(p.terms) for p in ps) / len(ps), {}
    for r in rs:
        mine, held = {t.h: t.w for t in r.terms}, []
        for p in ps:
            theirs = {t.h for t in p.terms}
            named = any(h & 3 == 1 for h in theirs)
            own = sum(w for h, w in mine.items() if named or h & 3 != 1)
            shared = sum(w for h, w in mine.items() if h in theirs)
            length = min(max(len(theirs) / mean, match.LENGTHS[0]), match.LENGTHS[1])
            if shared and shared >= cover * own - 1e-9:
                held.append((-round(shared * (match.K1 + 1) / (1 + match.K1 * (1 - match.B + match.B * length)), 9), p.id))
        out[r.id] = sorted(held)[:top]
    return out


def test_retrieval_against_brute_force(spark, monkeypatch):
    """Exact, whatever lists are opened alone or with two, three or four terms together, as long as they tell papers apart."""
    rng = random.Random(4)
    words, names_ = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"], [f"Name{a}{b}ov" for a in "abcde" for b in "klmn"]
    rows = []
    for i in range(120):
        title = rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=6)
        rows.append((f"p{i:03d}", " ".join(title), rng.choices(names_, weights=[1 / (k + 1) for k in range(len(names_))], k=rng.choice([0, 1, 3])), 2000 + i % 5, None, 1))
    asked = [(i, " ".join(w for w in r[1].split() if rng.random() < 0.8), r[2][: rng.choice([1, 3])], r[3], None, 1) for i, r in enumerate(rows) for _ in range(1)]
    bib = spark.createDataFrame(rows, "paper_id string, title string, authors array<string>, year int, publication_date string, ingested_at int")
    rec = spark.createDataFrame(asked, "record_id bigint, title string, authors array<string>, year int, publication_date string, fetched_at int")
    brute = pairs_by_force(bib, rec, 0.5, 3)
    for short, long in ((1000, 1000), (3, 6)):
        monkeypatch.setattr(match, "SHORT", short), monkeypatch.setattr(match, "LONG", long)
        got = {}
        for r in match.retrieve(bib, rec, 0.5, 3).orderBy("r", "rank").collect():
            got.setdefault(r.r, []).append((-round(r.score, 9), r.p))
        same = sum([s for s, _ in got.get(k, [])] == [s for s, _ in v] for k, v in brute.items())
        # with lists cut short a record may find none where all it shares is shared by many
        assert same == len(brute) if long == 1000 else same >= 0.95 * len(brute), (short, long, same)


def test_retrieval_where_all_in_common_is_frequent(spark, monkeypatch):
    """No record is lost whose only terms in common with a paper stand in long lists, of one term or of several."""
    rng = random.Random(9)
    rows = [(f"p{i:03d}", " ".join(rng.sample(["editorial", "report", "annual", "foreword", "notes"], rng.choice([1, 2, 3]))), [["Ada Kimov"], ["Ben Lostra"], None][i % 3], rng.choice([2000, 2001, None]), None, 1) for i in range(90)]
    asked = [(i, r[1], r[2] if i % 2 else None, rng.choice([2000, 1990, None]), None, 1) for i, r in enumerate(rows[:60])]
    bib = spark.createDataFrame(rows, "paper_id string, title string, authors array<string>, year int, publication_date string, ingested_at int")
    rec = spark.createDataFrame(asked, "record_id bigint, title string, authors array<string>, year int, publication_date string, fetched_at int")
    brute = pairs_by_force(bib, rec, 0.5, 3)
    monkeypatch.setattr(match, "SHORT", 2), monkeypatch.setattr(match, "LONG", 3)
    got = {}
    for r in match.retrieve(bib, rec, 0.5, 3).orderBy("r", "rank").collect():
        got.setdefault(r.r, []).append((-round(r.score, 9), r.p))
    assert {k: [s for s, _ in v] for k, v in got.items()} == {k: [s for s, _ in v] for k, v in brute.items() if v}


def test_matches_behind_many_others(spark):
    """A title of one frequent word is found, and papers that fail the checks take no place from the one that passes."""
    rows = [(f"n{i:02d}", f"Proceedings {i + 1}", None, None, None, 1) for i in range(40)] + [(f"s{i:02d}", f"Sparse Canopy Tensors {i + 1}", ["Olga Begontes"], 2001, None, 1) for i in range(8)]
    rows += [("right", "Proceedings", ["Olga Begontes", "Pavel Grymm"], 1987, None, 1), ("longer", "Sparse Canopy Tensors", ["Olga Begontes", "Ivana Skolt", "Pavel Grymm", "Hana Tirkovel", "Marek Brulost"], 1999, None, 1)]
    bib = spark.createDataFrame(rows, "paper_id string, title string, authors array<string>, year int, publication_date string, ingested_at int")
    rec = spark.createDataFrame([(1, "Proceedings", None, None, None, 1), (2, "Sparse Canopy Tensors", ["O. Begontes"], 2001, None, 1)], "record_id bigint, title string, authors array<string>, year int, publication_date string, fetched_at int")
    assert {(r.paper_id, r.record_id) for r in match.match(bib, rec).collect()} == {("right", 1), ("longer", 2)}


def test_matching_titles_with_slips(spark):
    # slips are told by the right words' being much more frequent
    others = [(f"o{n}{i}", f"{s[0]} {n}", [f"Else{n} Someone{n}", *s[1]], 1999 + n, None, 1) for i, s in enumerate(SLIPS) for n in range(12)]
    bib = spark.createDataFrame([(f"s{i}", s[0], s[1], s[2], None, 1) for i, s in enumerate(SLIPS)] + others, "paper_id string, title string, authors array<string>, year int, publication_date string, ingested_at int")
    rec = spark.createDataFrame([(i, s[3], s[4], s[5], None, 1) for i, s in enumerate(SLIPS)], "record_id bigint, title string, authors array<string>, year int, publication_date string, fetched_at int")
    assert {(r.paper_id, r.record_id) for r in match.match(bib, rec).collect()} == {(f"s{i}", i) for i in range(len(SLIPS))}


def test_calibration_learns_from_venues():
    rng = np.random.default_rng(3)
    share, gap = rng.random(6000), rng.random(6000)
    same = rng.random(6000) < 1 / (1 + np.exp(-(20 * share - 14)))
    agree = np.where(same, rng.random(6000) < 0.4, rng.random(6000) < 0.02)
    rows = np.column_stack([share, gap * share, agree, np.ones(6000)])
    rest = np.column_stack([share * 0.5, gap, rng.random(6000) < 0.02, np.full(6000, 2.0)])
    w = match.calibrated(np.concatenate([rows, rest]))
    told = 1 / (1 + np.exp(-(w[0] + rows[:, :2] @ w[1:])))
    assert np.mean((told > 0.5) == same) > 0.8 and abs(told.mean() - same.mean()) < 0.1
    assert (match.calibrated(np.zeros((0, 4))) == match.PRIOR).all()
