import random

import pytest
from pyspark.sql import functions as F

from biblake import config
from biblake.operators import conflicts, distill, edits, figures, merge, sections, state
from biblake.plans import render, resolve
from biblake.sources import files, records


def test_merge_is_the_sequential_rule(spark):
    rng, rows, want = random.Random(1), [], {}
    for paper in range(300):
        value = source = None
        for seq in range(1, rng.randint(1, 8)):
            s = rng.choice(["human", "tool:x", "osti", "crossref", "llm", "pdf", "strange"])
            v = rng.choice(["a", "b", None, ""])
            rows.append((str(paper), "title", v, s, "k", 0.912345, seq))
            rank = 100 if s in ("human", "tool:x") else merge.PRIORITY.get(s, 0)
            if v and (source is None or source[1] < 100 and rank >= source[1]):  # what people and tools set stays
                value, source = v, (s, rank)
        if value:
            want[str(paper)] = (value, source[0])
    claims = spark.createDataFrame(rows, "paper_id string, field string, value string, source string, lookup_key string, sim double, seq int")
    for n in (1, 7):
        got = merge.merge_claims(claims.repartition(n)).collect()
        assert {r.paper_id: (r.value, r.source) for r in got} == want and all(r.sim == 0.9123 for r in got)


def test_merge_with_existing_rows(spark):
    claims = spark.createDataFrame([(p, "title", "new", "osti", "k", None, 3) for p in "abcd"] + [("a", "category", "nonsense", "osti", "k", None, 3)], "paper_id string, field string, value string, source string, lookup_key string, sim double, seq int")
    old = spark.createDataFrame([("a", "title", "kept", "human"), ("b", "title", "old", None), ("c", "title", "old", "crossref"), ("d", "title", None, "human")], "paper_id string, field string, value string, source string")
    assert {r.paper_id: r.value for r in merge.merge_claims(claims, old).collect()} == {"a": "kept", "b": "new", "c": "new", "d": None}


def test_conflicts(spark):
    rows = [("a", 1, "A title", ["X Y"], 2000, "10.1/a"), ("a", 2, "A title", ["Y, X"], 2001, "doi:10.1/A"), ("b", 1, "One thing", ["X Y"], 2000, "10.1/a"), ("b", 2, "Another matter", ["X Z"], 2003, "10.1/b"), ("c", 1, "Alone", None, None, None)]
    r = spark.createDataFrame(rows, "paper_id string, seq int, title string, authors array<string>, year int, doi string")
    assert {x.paper_id: x.conflicts for x in conflicts.plain_conflicts(r).collect()} == {"a": [], "b": ["authors", "doi", "year"], "c": []}
    assert [x.paper_id for x in conflicts.text_conflicts(r, "title", 0.85).collect()] == ["b"]


def test_sections_tile_the_text(spark):
    md = spark.createDataFrame([("p", "intro\n# Methods 😀\ntext\n## Methods\n\n### Methods\n#no heading\n# 2 Results\nend"), ("q", ""), ("r", None)], "paper_id string, md string")
    out = sections.parse_sections(md).orderBy("ord").collect()
    text = md.first().md
    assert [r.short_name for r in out] == ["methods", "methods_2", "methods_3", "results"]
    assert all(text[r.start_offset :].startswith("#" * r.level + " ") for r in out)
    assert [r.end_offset for r in out] == [*(r.start_offset for r in out[1:]), len(text)]
    nested = {r.short_name: r.end_offset for r in sections.parse_sections(md, include_subsections=True).collect()}
    assert nested["methods"] == out[3].start_offset and nested["results"] == len(text)


def test_slices_keep_markers_whole(spark):
    text = "0123456789<!-- page 2 -->abcdefghij<!-- page 3 -->end"
    df = spark.createDataFrame([("p", text)], "paper_id string, md string")
    for n in range(len(text) + 4):
        r = df.select(sections.slice_md("md", head=n).alias("h"), sections.slice_md("md", tail=n).alias("t")).first()
        inside = lambda i: any(a < i < a + 15 for a in (10, 35))
        cut = min(n, len(text))
        assert r.h == text[: next((a for a in (10, 35) if a < cut < a + 15), cut)]
        begin = max(0, len(text) - n)
        assert r.t == text[next((a + 15 for a in (10, 35) if a < begin < a + 15), begin) :]
        assert not inside(len(r.h))
    with pytest.raises(ValueError):
        sections.slice_md("md")


def test_cover_strip(spark):
    def strip(md, title):
        return spark.createDataFrame([(md, title)], "md string, title string").select(sections.strip_cover("md", "title").alias("x")).first().x

    assert strip("# Site\n\n# A Good Title: more\nbody", "A good title") == "body"
    assert strip("# A Good Title", "A good title") == ""
    for md, title in (("# One\nbody", "One"), ("# A B\nbody", None), ("# A B\nbody", ""), ("# C D\nbody", "A B"), ("x" * 6001 + "\n# A B\nbody", "A B"), ("# X\n" * 20 + "# A B\nbody", "A B")):
        assert strip(md, title) == md
    assert strip("# X\n" * 19 + "# A B\nbody", "A B") == "body"


def test_page_markers(spark):
    md = spark.createDataFrame([("p", "Intro text here\n\nSecond page text\n\nThird page text"), ("q", "no blocks")], "paper_id string, md string")
    rows = [("p", 0, 0, "Intro text here"), ("p", 1, 1, "Second page text"), ("p", 2, 2, "img"), ("p", 3, 3, "Third page text"), ("p", 4, 4, "Intro text here"), ("p", 5, 5, "not in the text")]
    out = {r.paper_id: r for r in sections.inject_markers(md, spark.createDataFrame(rows, "paper_id string, ord int, page_idx int, text string")).collect()}
    assert out["p"].md == "\n<!-- page 1 -->\n\nIntro text here\n\n\n\n<!-- page 2 -->\n\nSecond page text\n\n\n\n<!-- page 4 -->\n\n\n\n<!-- page 5 -->\n\nThird page text" and out["p"].fallback == [4]
    assert out["q"].md == "\n<!-- page 1 -->\n\nno blocks"


def test_figures(spark):
    rows = [("p", 0, "image", 5, [0.0, 0.0, 10.5, 11.5], "a/b/sha1.jpg", ["x", " ", "y"]), ("p", 1, "table", 9, None, "sha2.png", None), ("p", 2, "image", 9, [1.0], "sha3", []), ("p", 3, "image", 9, None, "", ["no path"]), ("p", 4, "text", 9, None, "t.jpg", None)]
    b = spark.createDataFrame(rows, "paper_id string, ord int, type string, page_idx int, bbox array<double>, img_path string, image_caption array<string>")
    for c in ("image_footnote", "table_caption", "table_footnote", "chart_caption", "chart_footnote"):
        b = b.withColumn(c, F.lit(None).cast("array<string>"))
    out = figures.extract_figures(b).orderBy("id").collect()
    assert [(r.id, r.width_pt, r.height_pt, r.caption, r.source_sha) for r in out] == [("page006_img1", 10, 12, "x\ny", "sha1"), ("page010_img1", 0, 0, None, "sha2"), ("page010_img2", 0, 0, None, "sha3")]
    assert [r.id for r in figures.extract_figures(b, ["image"], spark.createDataFrame([("sha3",)], "sha string")).collect()] == ["page010_img1"]
    with pytest.raises(ValueError):
        figures.extract_figures(b, ["video"])
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x40\x00\x80\x03"
    assert spark.createDataFrame([(bytearray(head),), (bytearray(b"x"),)], "c binary").select(figures.jpeg_size("c").alias("s")).collect() == [((64 * 2, 64),), ((0, 0),)]


def test_edits(spark):
    f = spark.createDataFrame([("a", "title", '"T"', "osti"), ("a", "year", "2000", "osti"), ("b", "title", '"B"', "osti")], "paper_id string, field string, value string, source string")
    p = [("a", "title", '"T"', 1), ("a", "year", "null", 2), ("a", "doi", '"10.1234/x"', 3), ("b", "category", '"nonsense"', 1), ("b", "title", '"C"', 2)]
    patches = spark.createDataFrame(p, "paper_id string, field string, value string, seq int")
    out = {(r.paper_id, r.field): (r.value, r.source, r.changed) for r in edits.apply_patches(f, patches, "tool:t", "now").collect()}
    assert out == {("a", "title"): ('"T"', "osti", False), ("a", "doi"): ('"10.1234/x"', "tool:t", True), ("b", "title"): ('"B"', "osti", False)}
    assert {(r.field, r.changed) for r in edits.apply_patches(f, patches, "human", "now", restamp=True).where("paper_id = 'a'").collect()} == {("title", True), ("doi", True)}
    bad = [("x", "1"), ("_meta", "1"), ("year", '"x"'), ("doi", '"nope"'), ("arxiv_id", '"nope"'), ("authors", '["a", 1]'), ("title", "{")]
    errors = spark.createDataFrame(bad + [("authors", '["a"]'), ("year", "null"), ("doi", '""')], "f string, v string").select(edits.patch_error("f", "v").alias("e")).collect()
    assert [r.e is not None for r in errors] == [True] * len(bad) + [False] * 3
    with pytest.raises(ValueError):
        edits.check_source("robot")


def test_state(spark):
    schema = "paper_id string, stage string, query string, completed_at string, input_sha string, model string"
    s = spark.createDataFrame([("a", "md", None, "t", "1", None), ("b", "md", None, None, "1", None), ("c", "md", None, "t", "0", None), ("a", "distill", "q", "t", "1", "m")], schema)
    w = spark.createDataFrame([(p, "md", None, None, "1", None) for p in "abcd"], schema)
    assert sorted(r.paper_id for r in state.pending(w, s, ["input_sha", "model"]).collect()) == ["b", "c", "d"]
    assert [r.paper_id for r in state.current(w, s, ["input_sha", "model"]).collect()] == ["a"]
    marked = state.mark_complete(s, w.where("paper_id <> 'a'").withColumn("completed_at", F.lit("t2")))
    assert state.pending(w, marked, ["input_sha"]).count() == 0 and marked.count() == 5
    assert state.clean(s, s.where("paper_id = 'a'"), "distill").count() == 3
    gate = state.bib_gate(w, spark.createDataFrame([("a", False), ("b", True)], "paper_id string, needs_review boolean"))
    assert {r.paper_id: (r.status, r.exit_code) for r in gate.collect()} == {"a": ("ok", 0), "b": ("ReviewNeeded", 3), "c": ("BibMissing", 3), "d": ("BibMissing", 3)}
    with pytest.raises(RuntimeError):
        state.raise_for_status(gate)


def test_questions_and_runs(spark):
    bad = [distill.Question("A!", "abstract", "p"), distill.Question("b", "page", ""), distill.Question("c", "section", "p", 0), distill.Question("c", "full", "p")]
    assert len(distill.check_questions(bad)) == 6 and not distill.check_questions(distill.DEFAULT_QUESTIONS)
    with pytest.raises(ValueError):
        distill.select_questions(bad, ["nobody"])
    ready = spark.createDataFrame([("p", "q", "ready", None, "Why?", "because", 5), ("r", "q", "ready", None, "Why?", "fail", None), ("s", "q", "error", None, None, None, None)], "paper_id string, name string, status string, model string, prompt string, content string, max_chars int")

    def client():
        def answer(model, prompt):
            if prompt.endswith("fail"):
                raise OSError("down")
            return "  an answer that is long \n"

        return answer

    out = {r.paper_id: r for r in distill.run(ready, client, "m").collect()}
    assert out["p"].output == "an…" and out["p"].truncated and out["r"].status == "error" and out["r"].error == "down" and "s" not in out


def test_bibtex():
    text = '@string{j = "J. of X"} @comment{no} @Article{k1, title = {{A {Nested} Title}}, author = "Ada B and C, D", journal = j # " Y", year = 2001, url={https://doi.org/10.1234/AbC}}\n@book(k2, title="T")'
    assert files.parse_bibtex(text) == [{"ENTRYTYPE": "article", "ID": "k1", "title": "{A {Nested} Title}", "author": "Ada B and C, D", "journal": "J. of X Y", "year": "2001", "url": "https://doi.org/10.1234/AbC"}, {"ENTRYTYPE": "book", "ID": "k2", "title": "T"}]


def test_read_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{k1, title={{A} T}, author={A B and C D}, month=mar, year=2001, url={https://doi.org/10.1234/AbC}}")
    r = files.read_bibtex(spark, str(tmp_path / "a.bib")).first()
    assert (r.bibtex_key, r.authors, r.year, r.publication_date, r.doi, r.raw_type) == ("k1", ["A B", "C D"], 2001, "2001-03", "10.1234/abc", "article")
    (tmp_path / "b.bib").write_text("nothing")
    with pytest.raises(ValueError):
        files.read_bibtex(spark, str(tmp_path / "b.bib"))


def test_osti_authors(spark):
    raw = spark.createDataFrame([("p", '{"osti_id": "1", "authors": ["Wan, Hui [Pacific Lab] (ORCID:1)", {"first_name": "A", "last_name": "B"}, {"name": "C D"}, ""], "publication_date": "2020-01-02T00:00:00Z"}'), ("q", "no json")], "paper_id string, json string")
    out = {r.paper_id: r for r in records.project(raw, "osti").collect()}
    assert out["p"].authors == ["Wan, Hui", "A B", "C D"] and out["p"].year == 2020 and out["q"].title is None


def test_fuzzy_lookup_against_brute_force(spark):
    from biblake.functions.similarity import ratio

    rng, words = random.Random(4), "solver grid flow heat wave ice sensor model error scale phase".split()
    titles = [" ".join(rng.sample(words, rng.randint(3, 7))) for _ in range(60)]
    p = [(f"p{i}", t.title() if i % 2 else t, 2000 + i % 3 if i % 5 else None) for i, t in enumerate(titles)]
    r = [(i, t.replace("model", "modle") + ("." if i % 3 else ""), 2000 + i % 3) for i, t in enumerate(titles)] + [(99, None, 2000), (98, "", None)]
    got = {x.paper_id: x.sim for x in records.fuzzy_top1(spark.createDataFrame(p + [("n", None, 2000)], "paper_id string, title string, year int"), spark.createDataFrame(r, "record_id int, title string, year int"), most=50).collect()}
    brute = {k: max((ratio(t, u) for _, u, z in r if u and (y is None or z == y)), default=0) for k, t, y in p}
    assert got == {k: round(v, 4) for k, v in brute.items() if v >= 0.9}


def test_fuzzy_lookup_of_titles_with_slips_all_over(spark):
    from biblake.functions.similarity import may_match, ratio

    pairs = [("VILSKONZOUL: A parallel turbine for spectra", "VILSKONZOUL: A prallel turbine for spectrra"), ("Conservative Methods in the Lilvermbanl Delta", "Conservative Methods in Lilvermbanl Delta"), ("Sparse grids", "Sprse grids")]
    p, r = ([(i, t[k], 2017) for i, t in enumerate(pairs)] for k in (0, 1))
    got = {x.paper_id: x.record_id for x in records.fuzzy_top1(spark.createDataFrame(p, "paper_id int, title string, year int"), spark.createDataFrame(r, "record_id int, title string, year int")).collect()}
    assert got == {i: i for i in range(len(pairs))}
    rng, letters = random.Random(5), "abcde  "
    a = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(80)]
    b = ["".join(c for c in t if rng.random() > 0.06) + rng.choice(["", "e", "ab"]) for t in a]
    for t, near in zip(a, may_match(a, b, 0.9)):
        assert {j for j, u in enumerate(b) if ratio(t, u) >= 0.9} <= set(near.tolist())


def test_heuristic_title(spark):
    text = "ANL-22/11\n2020\nA Study of Compression in Large\nsimulations of flow\nAda Lovelace\nABSTRACT\n"
    pages = spark.createDataFrame([("p", text), ("q", "x"), ("r", None)], "paper_id string, text string")
    out = {r.paper_id: r.title for r in resolve.heuristic_title(pages).collect()}
    assert out == {"p": "A Study of Compression in Large simulations of flow", "q": None, "r": None}


def test_render(spark):
    bib = spark.createDataFrame([("p", "A Good Title", ["A", "B", "C", "D"], 2000, None, "V", None, "10.1/x", None, None, None)], "paper_id string, title string, authors array<string>, year int, publication_date string, venue string, category string, doi string, arxiv_id string, osti_id string, url string")
    md, blocks = spark.createDataFrame([("p", "# Cover\n# A good title\n\n# Methods\ntext of it")], "paper_id string, md string"), spark.createDataFrame([("p", 0, 1, "text of it")], "paper_id string, ord int, page_idx int, text string")
    whole, index = render.render(bib, md, blocks)
    text = whole.first().md
    assert text.startswith('---\n{"title":"A Good Title"') and "# A Good Title\n\nA et al.\n\nV · 2000\n\n" in text and text.endswith("# Methods\n\n<!-- page 2 -->\n\ntext of it")
    assert [r.short_name for r in index.orderBy("ord").collect()] == ["a_good_title", "methods"]


def test_config(tmp_path):
    assert config.validate(config.load()) == []
    (tmp_path / "c.json").write_text('{"models": {"distill": ""}, "bib": {"source_priority": ["human"]}}')
    assert len(config.validate(config.load(str(tmp_path / "c.json")))) == 4
    assert config.origins(str(tmp_path / "c.json"))["models.distill"] == "override"


def test_what_users_type(spark, tmp_path):
    from biblake.plans import surface

    assert surface.parse_assignments(["year=2001", "title=A = b", "doi=null", 'authors=["x"]']) == {"year": 2001, "title": "A = b", "doi": None, "authors": ["x"]}
    with pytest.raises(ValueError):
        surface.parse_assignments(["year"])
    (tmp_path / "p.json").write_text('{"b": {"scope": "full", "prompt": "p"}, "bad": 3}')
    assert [q.name for q in surface.load_questions(str(tmp_path), distill.DEFAULT_QUESTIONS)] == ["summary", "b"]
    with pytest.raises(ValueError):
        (tmp_path / "l.json").write_text("[1]")
        surface.read_patch(str(tmp_path / "l.json"))
    figs = spark.createDataFrame([("p", "page001_img1"), ("p", "page002_img1")], "paper_id string, id string")
    assert surface.figure_by_id(figs, "p", "page002_img1").count() == 1
    with pytest.raises(LookupError, match="page001_img1, page002_img1"):
        surface.figure_by_id(figs, "p", "x")
    st = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert [surface.exit_code(st("ok", "cached")), surface.exit_code(st("ok", "error")), surface.exit_code(st("ReviewNeeded"))] == [0, 1, 3]


def test_backfilled_names_count_those_before(spark):
    from biblake.plans import surface

    rows = [("p", 0, "methods", "x"), ("p", 1, None, "Methods"), ("p", 2, "", "Methods"), ("p", 3, None, "Other")]
    out = surface.backfill_short_names(spark.createDataFrame(rows, "paper_id string, ord int, short_name string, title string")).orderBy("ord").collect()
    assert [r.short_name for r in out] == ["methods", "methods_2", "methods_3", "other"]


def test_questions_are_asked_once_per_input(spark):
    from biblake.operators import distill

    ready = spark.createDataFrame(
        [("a", "q", "abstract", "Why?", None, None, "text a", 1, "ready", None, "i1", "p1"), ("b", "q", "abstract", "Why?", None, None, "text b", 1, "ready", None, "i2", "p1"), ("c", "q", "abstract", "Why?", None, None, None, None, "error", "no abstract", None, "p1")],
        "paper_id string, name string, scope string, prompt string, max_chars int, model string, content string, tokens int, status string, error string, input_sha string, prompt_sha string",
    )
    done = spark.createDataFrame([("a", "q", "m", "i1", "p1", "old"), ("b", "q", "m", "other", "p1", "old")], "paper_id string, name string, model string, input_sha string, prompt_sha string, output string")
    client = lambda: lambda model, prompt: f"```json\n{{\"by\": \"{model}\"}}\n```"
    told = lambda df: {r.paper_id: (r.status, r.output) for r in df.collect()}
    assert told(distill.distill(ready, client, "m", done, as_json=True)) == {"a": ("cached", "old"), "b": ("distilled", '{"by": "m"}'), "c": ("error", None)}
    assert told(distill.distill(ready, client, "m", done, force=True, as_json=True))["a"] == ("distilled", '{"by": "m"}')
    assert told(distill.distill(ready, client, "m", done, override="n", as_json=True))["a"] == ("distilled", '{"by": "n"}')
    assert told(distill.distill(ready, lambda: lambda m, p: "no json", "m", None, as_json=True))["a"][0] == "error"


def test_lookup_by_title_after_identifiers(spark):
    from biblake.sources import records

    papers = spark.createDataFrame([("a", "10.1/x", None, "Sparse grids", 2001), ("b", None, None, "A parallel turbine for spectra", 2017), ("c", None, None, "Nothing like it", 2017)], "paper_id string, doi string, arxiv_id string, title string, year int")
    snapshot = spark.createDataFrame([("10.1/x", None, "Other", 1990), (None, None, "A prallel turbine for spectra", 2017)], "doi string, arxiv_id string, title string, year int")
    out = {r.paper_id: (r.kind, r.rec and r.rec.title) for r in records.cascade(papers, snapshot, titles=True).collect()}
    assert out == {"a": ("doi", "Other"), "b": ("title", "A prallel turbine for spectra"), "c": (None, None)}
    assert {r.paper_id: r.kind for r in records.lookup_bibtex(papers, snapshot).collect()} == {"a": "doi", "b": "title", "c": None}


def test_resolve_keeps_edits_and_sees_all_conflicts(spark):
    from biblake.operators import conflicts, merge

    source = lambda title, venue: spark.createDataFrame([("p", "k", 1.0, title, ["Ann Bee"], 2001, venue), ("h", "k", 1.0, title, ["Ann Bee"], 2001, venue)], "paper_id string, lookup_key string, sim double, title string, authors array<string>, year int, venue string")
    sources = {"openalex": source("Sparse grids in use", "Journal of Grids"), "crossref": source("Sparse grids in use", "Annals of Cooking")}
    claims = merge.claims_of_sources(sources)
    raw = "paper_id string, source string, sim double, seq int, title string, authors array<string>, doi string, year int, venue string, raw_type string"
    rows = [(p, s, 1.0, i, "Sparse grids in use", ["Ann Bee"], None, 2001, v, t) for p in "ph" for i, (s, v, t) in enumerate((("openalex", "Journal of Grids", "article"), ("crossref", "Annals of Cooking", "book-chapter")))]
    records = spark.createDataFrame(rows, raw)
    old = spark.createDataFrame([("h", "category", "thesis", "human"), ("h", "notes", "read me", "tool:x")], "paper_id string, field string, value string, source string")
    out = {r.paper_id: r for r in resolve.resolve(claims, conflicts.credible(records), old).collect()}
    assert out["p"].category == "book chapter" and out["h"].category == "thesis" and out["h"].notes == "read me"
    assert out["p"].review_reasons == ["sources disagreed: venue"] and out["p"].needs_review
    merged = spark.createDataFrame([("p", "Sparse grids in use", ["Ann Bee"], 2001)], "paper_id string, title string, authors array<string>, year int")
    assert [r.sufficient for r in conflicts.tier1_sufficient(records, merged).collect()] == [False]
    assert [r.sufficient for r in conflicts.tier1_sufficient(records.withColumn("venue", F.lit("Same")), merged).collect()] == [True]
    twice = spark.createDataFrame([("p", "title", v, "human", None, None, i) for i, v in enumerate(("first", "second"))], "paper_id string, field string, value string, source string, lookup_key string, sim double, seq int")
    assert [r.value for r in merge.merge_claims(twice).collect()] == ["first"]
