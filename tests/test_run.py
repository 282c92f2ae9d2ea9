"""The engine end to end: files to snapshot to pages, again without change, and after one."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar import engine
from lodestar.operators import dotnet
from lodestar.plans import sources
from lodestar.sources.stores import Pages, Store


@pytest.fixture(scope="module")
def tree(spark):
    marks = [("p__K__/web/package.json", '{"dependencies":{"react":"1"}}'), ("p__K__/ng/angular.json", "{}")]
    rows = [(p.replace("__K__", k), t.replace("__K__", k), f"repo{k}") for k in "12" for p, t in sources.REACT[:5] + sources.ANGULAR[:3] + sources.DOTNET + marks]
    return spark.createDataFrame(rows, "path string, text string, repository string").withColumn("commit", F.lit("c1"))


def broken(src):
    raise RuntimeError("cannot read this\nand more")


SOME = ("react_components", "react_api_calls", "csharp_endpoints", "csharp_entities", "csharp_data_contexts", "csharp_dependencies", "packages")


def rows(store, table):
    return sorted(r[0] for r in store.latest(table, "Shop").select(F.to_json(F.struct("*"))).collect())


def test_a_run_and_its_successors(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    some = [s for s in engine._specs() if s.name in SOME]
    first = engine.run(spark, store, "Shop", tree, "s1", "2024-01-01 00:00:00", specs=some + [engine.Spec("broken", broken, ("dotnet",))])
    assert first.status == "Partial" and first.version == 1 and any(d[0] == "Error" and "cannot read this" in d[1] for d in first.diagnostics)
    nodes, edges = store.latest("nodes", "Shop"), store.latest("edges", "Shop")
    kinds = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}
    assert kinds["Entity"] == 4 and kinds["DataStore"] == 2 and kinds["Endpoint"] == 9 and kinds["Technology"] == 2
    order = nodes.where("identity = 'node://app:Shop/repo:repo1/entity:Order1'").first()
    assert order.properties["tableName"] == "orders1" and order.properties["fields"] == "Code: string; Name: string" and order.confidence > 0.9 and len(order.evidence) >= 3
    assert {r["type"] for r in edges.select("type").distinct().collect()} >= {"EXPOSES", "OWNS", "HAS_MANY", "CALLS", "DEPENDS_ON", "REFERENCES"}
    assert edges.join(nodes, F.col("from_id") == F.col("identity"), "left_anti").count() == 0
    assert "Order1 ||--o{ Line1" in Pages(store).whole("Shop", "data-and-storage.md")

    few = ("Overview", "Data")
    same = engine.run(spark, store, "Shop", tree, "s2", "2024-01-02 00:00:00", specs=some, pages=few)
    assert same.status == "Completed" and same.version is None and same.scanned == 0

    # random subsets change, also types that files which do not change depend on
    rng, text = random.Random(4), F.col("text")
    words = [("Line1", "Item1"), ("Shop2DbContext", "Store2DbContext"), ("Order2Service", "Order2Manager")]
    for turn in range(1):
        for old, new in rng.sample(words, 2):
            tree = tree.withColumn("text", F.when(F.col("path").rlike(r"\.cs$"), F.replace(text, F.lit(old), F.lit(new))).otherwise(text))
        part = engine.run(spark, store, "Shop", tree, f"p{turn}", f"2024-01-0{turn + 4} 00:00:00", specs=some, pages=few)
        other = Store(spark, str(tmp_path / f"other{turn}"))
        whole = engine.run(spark, other, "Shop", tree, "w", "2024-01-03 00:00:00", specs=some, pages=few)
        assert part.version == 2 and 0 < part.scanned < whole.scanned and part.analysed < whole.analysed
        assert rows(store, "nodes") == rows(other, "nodes") and rows(store, "edges") == rows(other, "edges")
    assert store.read("version_changes").count() == 1
    assert engine.run(spark, store, "Shop", tree, "p0", "2024-01-09 00:00:00", specs=some[:1], pages=few).diagnostics[-1][1] == "p0 is committed already"


def test_claims_and_attempts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "claims"))
    assert store.claim("a/b", x=1) and not store.claim("a/b", x=2) and store.claimed("a/b") == {"x": 1} and store.claimed("a/c") is None
    assert store.begin("App/1", "r1", now=0) and not store.begin("App/1", "r2", now=10, lease=60) and store.begin("App/1", "r1", now=11) and store.begin("App/1", "r3", now=100, lease=60)
    store.end("App/1")
    assert store.begin("App/1", "r4")
    store.empty_nodes().write.parquet(str(tmp_path / "claims/attempts/left/nodes"))
    assert store.snapshot("App/1") is None and store.vacuum() == 1 and store.vacuum() == 0
    pages = Pages(store)
    one = lambda path, text, part=0: (path, part, text, "text/plain")
    put = lambda version, *rows: pages.write("A", spark.createDataFrame(list(rows), "path string, part int, content string, content_type string"), version)
    assert put(1, one("x", "b", 1), one("x", "a"), one("y", "old")) and put(2, one("y", "new")) and not put(2, one("y", "late"))
    assert pages.whole("A", "x") == "a\nb" and pages.whole("A", "y") == "new" and {tuple(r) for r in pages.list("A").collect()} == {("x", 1), ("y", 2)}
    assert pages.clear("A", 3) and pages.read("A").count() == 0 and pages.whole("A", "x") is None
    assert put(4, one("z", "back")) and [r.path for r in pages.list("A").collect()] == ["z"]
    with pytest.raises(Exception, match="bad path"):
        put(5, one("../z", "no"))


def test_nothing_discovered(spark, tmp_path):
    empty = spark.createDataFrame([("a.txt", "x", "r", "c")], "path string, text string, repository string, commit string")
    result = engine.run(spark, Store(spark, str(tmp_path / "s")), "Bare", empty, "s1", "2024-01-01 00:00:00")
    assert [d[1] for d in result.diagnostics] == ["nothing was discovered"]


def test_specs_follow_each_other():
    spec = lambda n, p=0, *after: engine.Spec(n, broken, (), p, after)
    assert [s.name for s in engine.ordered([spec("a", 0, "c"), spec("b", 5), spec("c")])] == ["b", "c", "a"]
    with pytest.raises(ValueError, match="a -> b -> a"):
        engine.ordered([spec("a", 0, "b"), spec("b", 0, "a")])
    with pytest.raises(ValueError, match="unknown x"):
        engine.ordered([spec("a", 0, "x")])


def test_declarations_are_kept_with_their_files(spark, tmp_path):
    """A first scan is handed on as it was written, scopes follow from kept digests, and rows that a failed attempt left twice change nothing."""
    files = [("a.cs", "public class A\n{\n  [Key]\n  public int Id { get; set; }\n  public List<B> Bs { get; set; }\n}\n"), ("b.cs", "public class B\n{\n  public A Of { get; set; }\n}\n"), ("c.cs", "var x = 1;\n")]
    tree = engine.tree_of(spark.createDataFrame([(*f, "r", "c1") for f in files], "path string, text string, repository string, commit string"))
    store = Store(spark, str(tmp_path / "store"))
    _, types, count, written = engine.scans(store, tree)
    assert count == 3 and written and types.count() == 2
    assert [(m.name, m.type, m.property, m.element) for m in sorted(dotnet._members(types).collect())] == [("A", "int", "Id", None), ("A", "List<B>", "Bs", "B"), ("B", "A", "Of", None)]
    told = lambda: sorted(map(tuple, engine.scopes(store, tree).collect()))
    before = told()
    assert sum(scope == 0 for _, scope in before) == 1  # the file that names no type
    store.append("digests", spark.createDataFrame(store.read("digests").collect(), engine._DIGESTS))
    assert told() == before
    _, types, count, written = engine.scans(store, tree)
    assert count == 0 and not written and types.count() == 2
