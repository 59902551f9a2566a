"""Linking the spellings of persons and collaborations.

Method: a prefix-filtered set-similarity join on the trigrams of surnames: only the rarest trigrams of a name, as many
as a similarity of ``SIMILAR`` demands, are joined, so a pair that could reach it is never lost. Pairs are verified by
a soft token similarity in which rare tokens weigh more: surname and given name count by their inverse frequency, and
a given name that is well established beside the other one never stands for it. Initials and ambiguous short forms are then
attached to the person of the surname they fit best. Linked names are classes; classes come from label propagation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, table
from .canonical import distance, fold

SIMILAR, GIVEN, ALIKE, ESTABLISHED = 0.4, 0.2, 0.86, 4
#: How many times as frequent the name is that a given name may be a slip of; below ``ESTABLISHED`` any may be one.
RATIO = 8
#: Particles of surnames, titles and words of collaborations.
PARTICLES = frozenset("van von der den de di da del della du la le ten ter".split())
TITLES = frozenset("dr prof mr mrs ms sir phd".split())
GROUP = re.compile(r"\b(?:collaborations?|collab|coll|consortium|team|working group)\b")
#: Short forms of given names. A form of several names stays open until a surname decides.
SHORT_FORMS = {
    "aleksandr": "sasha alex sanya", "anthony": "tony", "benjamin": "ben benny", "deborah": "deb debbie", "dmitri": "dima mitya",
    "edward": "ed eddie ted ned", "elizabeth": "liz beth lizzie betty", "francisco": "paco pancho", "frederick": "fred freddy", "giuseppe": "beppe pino",
    "gregory": "greg", "guillermo": "memo guille", "harold": "hal harry", "jacqueline": "jackie", "jennifer": "jen jenny", "johannes": "hannes hans",
    "katherine": "kate kathy", "leonard": "len leo lenny", "margaret": "maggie peggy meg", "michael": "mike mick", "nikolaus": "niko klaus", "ottoline": "otti",
    "patricia": "pat trish patty", "quentin": "quen", "richard": "rick dick rich", "robert": "rob bob bobby", "samuel": "sam sammy", "theodora": "dora thea ted",
    "theodore": "ted theo", "thomas": "tom tommy", "ulrike": "uli", "victoria": "vicky tori", "william": "will bill billy", "yekaterina": "katya", "zachary": "zach zack",
    "stephen": "steve", "joseph": "joe", "james": "jim", "christopher": "chris", "daniel": "dan", "david": "dave", "alexander": "alex sasha", "nicholas": "nick", "andrew": "andy drew",
}
FORM_OF: dict[str, list[str]] = {}
for _name, _forms in SHORT_FORMS.items():
    for _form in _forms.split():
        FORM_OF.setdefault(_form, []).append(_name)


def parse(name: str) -> tuple[str, list[str], list[str], str]:
    """``(kind, left, right, exact)``: folded tokens before and after a comma, and the surname as written where a comma shows it.

    kind: ``group``, ``comma`` (surname first) or ``plain`` (order unknown, all tokens in ``left``).
    """
    text = re.sub(r"\[[^\]]*\]?|\([^)]*\)?", " ", name)
    text = re.sub(r"[\d*†‡§¹²³]+", " ", text).strip(" ,;")
    if re.search(r"[^\W\d_A-Z]{2}", text):  # initials run together, beside a name that isn't all capitals
        text = re.sub(r"(?<![\w.'’\-])[A-Z]{2,3}(?![\w.'’\-])", lambda m: m[0] if m[0].lower() in PARTICLES else " ".join(m[0]), text)
    plain = fold(text)
    if GROUP.search(plain):
        base = re.sub(r"^\s*(?:on behalf of|for)\s+", "", GROUP.sub(" ", plain))
        return "group", [w for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", base) if w != "the"], [], ""
    halves = [re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", fold(h)) for h in text.split(",", 1)]
    halves = [[w for w in h if w not in TITLES] for h in halves]
    if len(halves) == 2 and halves[0] and halves[1]:
        return "comma", halves[0], halves[1], ""
    return "plain", halves[0] + (halves[1] if len(halves) == 2 else []), [], ""


def _is_initial(token: str) -> bool:
    return len(token) == 1


def _joined(tokens: list[str]) -> str:
    """A surname whatever its parts are joined by."""
    return re.sub(r"['’\-]", "", "".join(tokens))


def orient(kind: str, left: list[str], right: list[str], reversed_: bool, middle: bool) -> tuple[str, str]:
    """``(surname, given)`` of parsed tokens; the particles of a surname are left out, middle names and initials too.

    reversed_: the surname stands first; middle: the token after the first is a given name, no part of a surname.
    """
    if kind == "group":
        return _joined(left), "group"
    if kind == "comma":
        surname = [w for w in left if w not in PARTICLES] or left
        given = [w for w in right if w not in PARTICLES] or right
        return _joined(surname), given[0]
    tokens = [w for w in left if w not in PARTICLES] or left
    if not tokens:
        return "", ""
    if len(tokens) == 1:
        return tokens[0], ""
    full = [w for w in tokens if not _is_initial(w)]
    if not full:
        return tokens[-1], tokens[0]
    if _is_initial(tokens[-1]) or reversed_:  # "Surname I" and "Surname Given"
        at = next(i for i, w in enumerate(tokens) if _is_initial(w)) if _is_initial(tokens[-1]) else len(tokens) - 1
        return _joined(tokens[:at]), tokens[at]
    parts = [w for w in tokens[1:] if not _is_initial(w)]
    if _is_initial(tokens[0]):
        return _joined(parts), tokens[0]
    return _joined(parts[1:] if middle and len(parts) > 1 else parts or tokens[-1:]), tokens[0]


def distinct_names(bib: DataFrame) -> DataFrame:
    """``name, n``: every string of ``authors`` that is not blank, and its rows; counted before the shuffle."""
    return bib.select(F.explode("authors").alias("name")).where("trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))


def keys(names: DataFrame) -> DataFrame:
    """``name, n, surname, given, exact``: the folded surname and given name, and the surname's marks and particles as a tie-breaker."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x) for x in batch.column(0).to_pylist()]
            first, last, second = [], [], []
            for kind, left, _, _ in rows:
                full = [w for w in left if w not in PARTICLES]
                plain = kind == "plain" and len(full) > 1 and not any(map(_is_initial, (full[0], full[-1])))
                first.append(full[0] if plain else None), last.append(full[-1] if plain else None)
                second.append(full[1] if plain and len(full) > 2 and not _is_initial(full[1]) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in ((0, pa.string()), (1, pa.list_(pa.string())), (2, pa.list_(pa.string())))), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(second, pa.string())],
                names=["name", "n", "kind", "lefts", "rights", "first", "last", "second"],
            )

    rows = names.mapInArrow(read, "name string, n bigint, kind string, lefts array<string>, rights array<string>, first string, last string, second string")
    rows = materialize(rows)
    seen = rows.select(F.explode(F.expr(
        "filter(array(struct(first as token, 1 as g, 0 as s), struct(last as token, 0 as g, 1 as s), struct(case when kind = 'comma' then element_at(rights, 1) end as token, 1 as g, 0 as s),"
        " struct(case when kind = 'comma' then element_at(lefts, -1) end as token, 0 as g, 1 as s)), x -> x.token is not null)"
    )).alias("x")).groupBy("x.token").agg(F.sum("x.g").alias("g"), F.sum("x.s").alias("s"))
    f, l, m = (seen.select(F.col("token").alias(c), F.col("g").alias(f"{c}_g"), F.col("s").alias(f"{c}_s")) for c in ("first", "last", "second"))
    judged = rows.join(f, "first", "left").join(l, "last", "left").join(m, "second", "left").withColumns({
        "turned": F.expr("coalesce(last_g >= 4 * last_s and first_g * 4 < last_g, false)"),
        "middle": F.expr(f"coalesce(second_g >= {ESTABLISHED} and second_g > second_s, false)"),
    })

    def name_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, kind, left, right, turned, middle in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                surname, given = orient(kind, left, right, turned, middle)
                forms = FORM_OF.get(given, ())
                marks = re.sub(r"[^\w]+", " ", name.casefold())
                exact = next((w for w in marks.split() if len(w) > 1 and surname.startswith(fold(w))), "")
                particle = " ".join(w for w in left if w in PARTICLES)
                out.append((surname, forms[0] if len(forms) == 1 else given, f"{particle} {exact}".strip()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], pa.string()) for i in range(3))], names=["name", "n", "surname", "given", "exact"])

    return judged.select("name", "n", "kind", "lefts", "rights", "turned", "middle").mapInArrow(name_parts, "name string, n bigint, surname string, given string, exact string")


def similar_pairs(words: DataFrame, threshold: float = SIMILAR, size: int = 3) -> DataFrame:
    """``a, b`` (a < b) of the distinct strings ``word`` that differ by at most two edits and whose sets of grams of ``size`` letters have at least the given Jaccard similarity.

    No such pair is lost; some that are less similar but share a rare gram come too, and are left to who verifies.
    """
    edge = "#" * (size - 1)
    padded = F.concat(F.lit(edge), "word", F.lit(edge))
    grams = words.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") + size - 1), lambda i: F.substr(padded, i, F.lit(size))))).alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = grams.join(frequency, "gram").withColumns({
        "rank": F.row_number().over(Window.partitionBy("word").orderBy("df", "gram")),
        "size": F.count("*").over(Window.partitionBy("word")),
    }).where(F.col("rank") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1).select("word", "gram", F.length("word").alias("len"))
    a, b = (ranked.select(F.col("word").alias(x), "gram", F.col("len").alias(f"{x}_len")) for x in "ab")
    close = a.join(b, "gram").where("a < b and abs(a_len - b_len) <= 2")
    return close.where(F.levenshtein("a", "b", 2) >= 0).select("a", "b").dropDuplicates()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, label``: the smallest node of each connected class of ``a, b``.

    Label propagation with pointer jumping, so that long chains take few rounds; each round is written to the shared
    folder. Ends when no label changes.
    """
    both = materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        to = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialize(step.join(to, "label", "left").select("node", F.least(F.coalesce("next", "label"), "label").alias("label"), "was"))
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels
    raise RuntimeError("the classes did not settle")


def link_names(bib: DataFrame) -> DataFrame:
    """``name, entity``: one row per distinct string of ``authors``, exactly as written.

    Strings of one person or collaboration have the same ``entity``. Null and empty author lists and null or blank
    names give no rows; repeated rows count in the frequencies only; an empty table gives no rows. A short form that
    fits several persons goes to the one written with the same marks and particles, then to the most frequent one,
    then to the first by name. Initials that fit nobody written out stay by themselves, linked only with what has the
    same surname and initial.
    """
    spell = materialize(keys(distinct_names(bib)).where("surname <> ''"))
    node = F.concat_ws("|", "surname", "given")
    people = materialize(spell.groupBy("surname", "given").agg(F.sum("n").alias("n"), F.max_by("exact", "n").alias("exact")).withColumn("node", node))
    used = people.groupBy("given").agg(F.count("*").alias("as_given"))
    shared = people.groupBy("surname").agg(F.count("*").alias("as_surname"))
    people = people.join(used, "given").join(shared, "surname").withColumn("full", F.length("given") > 1)
    forms = sorted((f, g) for f, gs in FORM_OF.items() if len(gs) > 1 for g in gs)
    open_forms = spell.sparkSession.createDataFrame(forms, "form string, stands_for string")  # a fixed list
    people = people.withColumn("full", F.expr("length(given) > 1") & ~F.col("given").isin(sorted({f for f, _ in forms})))
    people = materialize(people)
    near = similar_pairs(people.select(F.col("surname").alias("word")).dropDuplicates())
    near = materialize(near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    total = F.lit(math.log(max(2, people.count())))

    def soft(x: pa.Array, y: pa.Array) -> list[float]:
        return [1 - distance(p, q, 9) / max(len(p), len(q), 1) for p, q in zip(x.to_pylist(), y.to_pylist())]

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                keep = []
                for s, g, ws, wg, ga, gb, same in zip(soft(c["sa"], c["sb"]), soft(c["ga"], c["gb"]), c["ws"].to_pylist(), c["wg"].to_pylist(), c["fa"].to_pylist(), c["fb"].to_pylist(), c["same"].to_pylist()):
                    known = min(ga, gb) >= ESTABLISHED and min(ga, gb) * RATIO > max(ga, gb)
                    keep.append((same or not known) and (s * ws + g * wg) / (ws + wg) >= ALIKE and s >= 0.75 and g >= 0.6)
                yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(keep, pa.bool_())), c["b"].filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

        return pairs.mapInArrow(run, "a string, b string")

    full = people.where("full").select("surname", "given", "n", "node", "as_given", "as_surname")
    a = full.select(F.col("surname").alias("sa"), F.col("given").alias("ga"), F.col("node").alias("a"), F.col("as_given").alias("fa"), F.col("as_surname").alias("xa"))
    b = full.select(F.col("surname").alias("sb"), F.col("given").alias("gb"), F.col("node").alias("b"), F.col("as_given").alias("fb"), F.col("as_surname").alias("xb"))
    columns = ["a", "b", "sa", "sb", "ga", "gb", "fa", "fb", (total - F.log(F.least("xa", "xb").cast("double")) + 1).alias("ws"), (total - F.log(F.greatest("fa", "fb").cast("double")) + 1).alias("wg"), (F.col("ga") == F.col("gb")).alias("same")]
    by_given = near.where("a < b").select(F.col("a").alias("sa"), F.col("b").alias("sb")).join(a, "sa").join(b.withColumnRenamed("gb", "ga2"), "sb").where("ga = ga2").withColumnRenamed("ga2", "gb").select(*columns)
    # another spelling of the given name beside the same surname: one of the two is rare as a given name, or rare beside the other
    # the given names meet through the similarity join of all given names, so a frequent surname pairs no more than its own
    given = materialize(similar_pairs(full.select(F.col("given").alias("word")).dropDuplicates(), GIVEN, 2))
    met = given.select(F.col("a").alias("ga"), F.col("b").alias("gb")).join(a, "ga").withColumn("sb", F.col("sa")).join(b, ["sb", "gb"])
    within = met.where(f"least(fa, fb) < {ESTABLISHED} or least(fa, fb) * {RATIO} <= greatest(fa, fb)").select(*columns)
    edges = verified(by_given.unionAll(within))
    classes = components(edges)
    whole = people.where("full").join(classes, "node", "left").select("surname", "given", "n", "exact", "node", F.coalesce("label", "node").alias("entity"))
    whole = materialize(whole)

    # short forms: initials, and forms of several names, beside the same or nearly the same surname
    short = people.where("not full").select("surname", "given", F.col("n").alias("short_n"), F.col("exact").alias("written"), F.col("node").alias("short"))
    sized = whole.withColumn("weight", F.sum("n").over(Window.partitionBy("entity")))
    target = sized.select(F.col("surname").alias("at"), F.col("given").alias("of"), "exact", "entity", "weight")
    spots = short.select("surname").dropDuplicates()
    reach = spots.select("surname", F.col("surname").alias("at"), F.lit(0).alias("off")).unionAll(near.join(spots, near.a == spots.surname).where(F.levenshtein("a", "b", 2) >= 0).select("surname", F.col("b").alias("at"), F.levenshtein("a", "b").alias("off")))
    # by surname and first letter, or by surname and the name a form stands for: nobody meets all of a surname
    asked = short.where("given <> ''").join(reach, "surname")
    by_letter = asked.where("length(given) = 1").withColumn("letter", F.col("given")).join(target.withColumn("letter", F.left("of", F.lit(1))), ["at", "letter"]).drop("letter")
    by_form = asked.join(F.broadcast(open_forms), asked.given == open_forms.form).drop("form").withColumnRenamed("stands_for", "of").join(target, ["at", "of"])
    fits = by_letter.unionByName(by_form)
    best = Window.partitionBy("short").orderBy("off", F.col("written") != F.col("exact"), F.desc("weight"), "entity")
    attached = fits.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(F.col("short").alias("node"), "entity")
    entity = whole.select("node", "entity").unionAll(attached)
    return spell.withColumn("node", node).join(entity, "node", "left").select("name", F.coalesce("entity", "node").alias("entity"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of strings that mean the same person or collaboration."""
    linked = materialize(link_names(table(spark, root, "bib")))
    a, b = (linked.select(F.col("name").alias(f"name_{x}"), "entity") for x in "ab")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p5_entities(spark: SparkSession, root: str) -> DataFrame:
    """Every spelling with its class and the number of spellings of the class."""
    linked = materialize(link_names(table(spark, root, "bib")))
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("name", "entity", "spellings")
