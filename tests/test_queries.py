import re
from pathlib import Path

import pytest

from biblake.plans import queries

ROOT = "/root/testdata/sf0.001"


def test_nothing_outside_imports_the_subpackage():
    package = Path(queries.__file__).parents[1]
    for f in package.rglob("*.py"):
        if "llm" not in f.relative_to(package).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", f.read_text(), re.M), f


@pytest.mark.skipif(not Path(ROOT).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    from tests.oracle import connect, differences

    f = queries.QUERIES[name]
    if name in queries.SQL:
        assert differences(spark, connect(ROOT), f, queries.SQL[name], ROOT) == ""
    else:
        assert f(spark, ROOT).count() >= 0


@pytest.mark.skipif(not Path(ROOT).exists(), reason="no test tables")
def test_streaming_does_only_what_is_new(spark, tmp_path):
    from biblake.operators.state import content_hash
    from biblake.streaming import papers

    new = spark.createDataFrame([("a", "x"), ("b", "y")], "paper_id string, md string").select("paper_id", content_hash("md").alias("input_sha"))
    held = {"state": spark.createDataFrame([], papers.STATE), "done": []}

    def write(results, state):
        held["done"] += [r.paper_id for r in results.collect()]
        held["state"] = spark.createDataFrame(state.collect(), papers.STATE)

    for n, df in enumerate((new, new.where("paper_id = 'a'"), new.where("paper_id = 'b'").selectExpr("paper_id", "'other' as input_sha"))):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        papers.keep_current(papers.stream_table(spark, str(tmp_path / "in"), new), "md", "1", lambda: held["state"], write, lambda d: d, str(tmp_path / "checkpoint"), f"t{n}").awaitTermination(120)
    assert sorted(held["done"]) == ["a", "b", "b"]
