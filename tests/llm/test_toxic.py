import re
from pathlib import Path

import numpy as np
import pytest

from biblake.llm import toxic
from tests.llm.abuse_cases import ABUSIVE, CLEAN

PLAIN = "First, we optimize the controller; then we reconstruct the compressible vortices."
DISGUISED = [
    "You are a d​i​s​g​u​s​t​i​n​g moron.", "Shut your f*cking m0uth, you $tupid a$$hole.", "Foreigners are r a t s, throw them out of our country.", "You are a sttttupid wh0re.",
    "Yоu аre an іdіоt, nobody loves you.", "I WANT TO LICK YOUR NAKED BODY ALL NIGHT.", "F.u.c.k off, you worthless idiot.", "throw all immigrants out, they are vermin 🤮",
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, f"{PLAIN} {t} {PLAIN}", "x") for i, t in enumerate(DISGUISED)] + [(100 + i, t if not t or not t.strip() else f"{PLAIN} {t}", "x") for i, t in enumerate(["", None, "  ", "The solver was restarted."])]
    return spark.createDataFrame([*rows, (200, PLAIN * 3000 + " " + DISGUISED[0], "x"), (0, DISGUISED[0], "x")], "doc_id bigint, text string, score string")


@pytest.fixture(scope="module")
def scored(frame):
    return toxic.score(frame, "doc_id", "text").collect()


def test_disguised_abuse_is_found(scored):
    assert {r.doc_id for r in scored if r.score >= toxic.THRESHOLD} == {*range(len(DISGUISED)), 200}
    assert all(r.score == 0 for r in scored if r.doc_id in (100, 101, 102)) and all(0 <= r.score <= 1 for r in scored)
    assert sum(r.doc_id == 0 for r in scored) == 2


def test_partitions_and_batches_change_nothing(spark, frame, scored):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        toxic._LEARNED.clear()
        again = toxic.score(frame.repartition(24), "doc_id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: (r.doc_id, round(r.score, 9))
    assert sorted(map(key, again)) == sorted(map(key, scored))


def test_sentences_that_no_seed_holds():
    """Recall and precision on sentences in eight languages that were written for this test."""
    chain = toxic.Chain.train([(w, y, 1.0) for w, y, _ in toxic.seeds()] + [(t.split(), (0,) * 5, 1.0) for t in (" ".join(p) for p in toxic.passages(PLAIN))])
    told = lambda t: float(chain.probabilities(list(toxic.passages(t))).max()) >= toxic.THRESHOLD
    found, false = sum(map(told, ABUSIVE)), sum(map(told, CLEAN))
    assert len(ABUSIVE) + len(CLEAN) > 100
    assert found / len(ABUSIVE) >= 0.9 and found / (found + false) >= 0.9, (found, false)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_no_seed_stands_in_the_corpus(spark):
    """No four words of a test sentence, and next to none of a pattern, stand in the documents."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").dropDuplicates().collect() if r.text]
    grams = lambda words: {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
    corpus = set().union(*(grams(re.findall(r"\w+", toxic.folded(t))) for t in texts))
    for t in ABUSIVE:
        assert not grams(re.findall(r"\w+", toxic.folded(t))) & corpus, t
    assert not [w for w, y, _ in toxic.seeds() if any(y) and grams(w) & corpus]


def test_patterns_that_are_held_out():
    made = toxic.seeds()
    chain = toxic.Chain.train([(w, y, 1.0) for w, y, n in made if n % toxic.HELD])
    assert toxic.right(chain, [r for r in made if not r[2] % toxic.HELD]) > 0.75


def test_every_passage_is_scored():
    chain = toxic.Chain.train([(w, y, 1.0) for w, y, _ in toxic.seeds()])
    rows = [["unheard", "of"], ["x"] * 26, *(w for w, _, _ in toxic.seeds()[:50])]
    whole = chain.probabilities(rows)
    assert np.allclose(whole, np.concatenate([chain.probabilities([r]) for r in rows]), atol=1e-6) and (whole > 0).all()


def test_empty_table(spark):
    assert toxic.score(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_chain_on_held_out_rows():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        a, b = rng.random() < 0.4, rng.random() < 0.5
        words = ["w%d" % i for i in rng.integers(0, 50, 6)] + ["alpha"] * a + ["beta"] * b
        rows.append((words, (int(a), 0, 0, int(a and b), 0), 1.0))
    chain = toxic.Chain.train(rows[:400])
    p = chain.probabilities([w for w, _, _ in rows[400:]]) >= 0.5
    y = np.array([r[1] for r in rows[400:]], bool)
    assert (p[:, 0] == y[:, 0]).mean() > 0.95 and (p[:, 3] == y[:, 3]).mean() > 0.9
