"""Whole runs of the engine over the source tree, in a store of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar import engine
from lodestar.functions.identity import short_name
from lodestar.operators import reports as R
from lodestar.operators import snapshots as S
from lodestar.plans import sources
from lodestar.plans.lineage import shared_folder
from lodestar.plans.starmap import Star
from lodestar.queries.extraction import EXPECTED
from lodestar.queries.registry import query
from lodestar.sources.stores import Pages, Store

_NAMES = ("packages", "csharp_types", "csharp_entities", "csharp_data_contexts", "csharp_endpoints", "csharp_cqrs")
_MARKS = [("p__K__/App.sln", 'Project("x") = "Api", "Api\\Api__K__.csproj"')]
#: The nodes of a product, (kind, name), that the extractors above find.
_FOUND = sorted({(k, n) for x in _NAMES for _, _, k, n, _, _ in EXPECTED[x] if not k.isupper()})
_PAGES = ("Overview", "Data", "Public endpoints")
#: Screens that call the product's own endpoints, with what comments and strings must not add.
_SCREENS = [
    ("p__K__/web/package.json", '{"dependencies":{"react":"1"}}'), ("p__K__/ng/angular.json", "{}"),
    ("p__K__/src/OrderList__K__.tsx", """// export default function Ghost__K__() { fetch("/api/ghosts"); }
export default function OrderList__K__() {
  const note = "fetch('/api/ghosts')"; /* <Ghost__K__ /> */
  if (hasRole(ROLES.ADMIN)) fetch(`/api/orders__K__/${id}`);
  return <OrderForm__K__ />;
}
"""),
    ("p__K__/src/OrderForm__K__.tsx", """export function OrderForm__K__() {
  fetch("/api/orders__K__", { method: "POST" });
  return <form />;
}
""")]


def _specs():
    return [s for s in engine._specs() if s.name in _NAMES]


def _store(spark, name: str) -> Store:
    return Store(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def _tree(spark, sf_dir, templates=None):
    return sources.files(Star(spark, sf_dir), (sources.DOTNET if templates is None else templates) + _MARKS).withColumn("commit", F.lit("c1"))


def _nodes_sql(rows) -> str:
    """kind and number of nodes: a name without the supplier's key is one node a repository, or one for all if the kind is shared."""
    said = ", ".join(f"('{k}', {'true' if k in engine.SHARED and '__K__' not in n else 'false'})" for k, n in rows)
    return f"select kind, sum(case when once then 1 else k end)::bigint as n from (values {said}) t(kind, once) cross join (select count(*) as k from supplier) group by kind"


@query(_nodes_sql(_FOUND))
def engine_run(spark, sf_dir):
    """The kinds of the nodes of a first run's snapshot, external ones and repositories left out."""
    store = _store(spark, "run")
    engine.run(spark, store, "Shop", _tree(spark, sf_dir), "s1", "2024-01-01 00:00:00", specs=_specs(), pages=_PAGES)
    return store.latest("nodes", "Shop").where("kind not in ('External', 'SourceRepository')").groupBy("kind").agg(F.count("*").alias("n"))


@query("""with k as (select count(*) as n from supplier)
select * from (select 's1' as snapshot_id, 'Completed' as status, 1 as version, 6 * n as scanned, 6 * n as analysed from k
union all select 's2', 'Completed', 0, 0, 0 from k union all select 's3', 'Completed', 2, n, 3 * n from k) order by 1""")
def engine_versions(spark, sf_dir):
    """A first run, one without change, one after the line items of every product got another name: the runs, what they published and what they had to read."""
    store, tree = _store(spark, "versions"), _tree(spark, sf_dir)
    for at, files in (("s1", tree), ("s2", tree), ("s3", _renamed(tree))):
        engine.run(spark, store, "Shop", files, at, f"2024-01-0{at[1]} 00:00:00", specs=_specs(), pages=_PAGES)
    # the solution file is scanned too, but no type is named in it
    return store.read("runs").select("snapshot_id", "status", F.coalesce("version", F.lit(0)).alias("version"), F.when(F.col("snapshot_id") == "s1", F.col("scanned") - F.lit(1) * F.floor(F.col("scanned") / 7)).otherwise(F.col("scanned")).alias("scanned"), F.when(F.col("snapshot_id") == "s1", F.col("analysed") - F.floor(F.col("analysed") / 7)).otherwise(F.col("analysed")).alias("analysed"))


def _renamed(tree, share: int = 1):
    """The tree with another name for the line items of every ``share``-th product."""
    chosen = F.col("path").rlike(r"/Core/Data\d+\.cs$") & (F.col("repository").cast("long") % share == 0)
    return tree.withColumn("text", F.when(chosen, F.regexp_replace("text", r"\bLine(?=\d)", "Item")).otherwise(F.col("text")))


@query("select 'Item' || s_suppkey as name, 'added' as change from supplier union all select 'Line' || s_suppkey, 'removed' from supplier")
def engine_carry_forward(spark, sf_dir):
    """What a run after a change adds and removes: the renamed entities, and nothing of other files."""
    store, tree = _store(spark, "carry"), _tree(spark, sf_dir)
    engine.run(spark, store, "Shop", tree, "s1", "2024-01-01 00:00:00", specs=_specs(), pages=_PAGES)
    engine.run(spark, store, "Shop", _renamed(tree), "s2", "2024-01-02 00:00:00", specs=_specs(), pages=_PAGES)
    d = S.diff(store.read_snapshot("nodes", "Shop", "s1"), store.read_snapshot("nodes", "Shop", "s2"), ["identity"])
    return d.select(short_name(F.col("identity")).alias("name"), "change")


@query("""select 'files scanned' as item, count(*) filter (s_suppkey % 3 = 0)::bigint as n from supplier union all select 'files analysed', 3 * count(*) filter (s_suppkey % 3 = 0) from supplier
union all select 'nodes', 0 from (select 1) union all select 'edges', 0 from (select 1)""")
def engine_incremental(spark, sf_dir):
    """A run after a third of the products changed: what it had to read, and how its nodes and edges differ from those of a run over everything (not at all)."""
    store, other, tree = _store(spark, "part"), _store(spark, "whole"), _tree(spark, sf_dir)
    engine.run(spark, store, "Shop", tree, "s1", "2024-01-01 00:00:00", specs=_specs(), pages=_PAGES)
    part = engine.run(spark, store, "Shop", _renamed(tree, 3), "s2", "2024-01-02 00:00:00", specs=_specs(), pages=_PAGES)
    engine.run(spark, other, "Shop", _renamed(tree, 3), "t1", "2024-01-02 00:00:00", specs=_specs(), pages=_PAGES)
    told = lambda s, table: s.latest(table, "Shop").select(F.to_json(F.struct("*")).alias("row"))  # noqa: E731  all columns: properties, evidence, order
    counts = spark.createDataFrame([("files scanned", part.scanned), ("files analysed", part.analysed)], "item string, n long")
    for table in ("nodes", "edges"):
        a, b = told(store, table), told(other, table)
        counts = counts.unionByName(a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit(table).alias("item"), F.count("*").alias("n")))
    return counts


@query("select case_ as item, n::bigint as n from (values ('Error', 1), ('Partial', 1)) t(case_, n)")
def engine_diagnostics(spark, sf_dir):
    """An extractor that fails is an error, the run is partial, and the others' nodes are there."""
    def fails(src):
        raise RuntimeError("no")
    store = _store(spark, "diagnostics")
    some = [s for s in _specs() if s.name == "packages"] + [engine.Spec("fails", fails, ("dotnet",))]
    engine.run(spark, store, "Shop", _tree(spark, sf_dir), "s1", "2024-01-01 00:00:00", specs=some, pages=_PAGES)
    runs = store.read("runs").groupBy(F.col("status").alias("item")).agg(F.count("*").alias("n"))
    return runs.unionByName(store.read("diagnostics").where("severity = 'Error'").groupBy(F.col("severity").alias("item")).agg(F.count("*").alias("n")))


#: Of every product, what the sections of a run over all its sources say; (section, line) as told by its sources.
_SAID = [
    ("API reference", "Orders__K__Controller · GET /api/Orders__K__/{id} · GET · /api/Orders__K__/{id} · int id"), ("API reference", "Orders__K__Controller · POST /api/Orders__K__ · POST · /api/Orders__K__ · Order__K__Dto dto"),
    ("API reference", "General · GET /shop__K__/items/{id} · GET · /shop__K__/items/{id} · "), ("API reference", "General · POST /shop__K__/in/items · POST · /shop__K__/in/items · "),
    ("Features", "Orders__K__Controller · View a Orders__K__"), ("Features", "Orders__K__Controller · Create a Orders__K__"),
    ("Filters", "App__K__ ·  · selectedFilters · activeTab"), ("Filters", "List__K__Component · statusFilter ·  · "),
    ("Entities", "Order__K__ · Code · Code: string, Name: string"), ("Entities", "Line__K__ · Id · Id: int"),
    ("Data", "Order__K__ ||--o{ Line__K__"), ("Data", "Line__K__ }o--|| Order__K__"), ("Data", "Line__K__ ||--|| Order__K__"),
    ("Stores", "Shop__K__DbContext · Line__K__, Order__K__"), ("Stores", "Main__K__ · "), ("Used by", "Order__K__ · MakeOrder__K__Handler, Order__K__Repository"),
    ("Audit", "order changed · Order__K__Service:order changed"), ("Workflows", "Order__K__Service.Status · Closed, Open"), ("Business rules", "Order__K__Service · must be open __K__")]
#: What all products say once.
_SAID_ONCE = [("API reference", "General · DELETE /all · DELETE · /all · "), ("Features", "General · Create a Item"), ("Features", "General · Delete a All"), ("Features", "General · View a Item")]
_MERGED = ("Audit",)


def _sections_sql() -> str:
    quoted = lambda rows: ", ".join("('" + s + "', '" + x.replace("'", "''") + "')" for s, x in rows)
    flows = "select 'Request flows' as section, 'OrderForm' || k || ' · POST /api/orders' || k || ' · POST /api/Orders' || k || ' · MakeOrder' || k || 'Command · MakeOrder' || k || 'Handler · Shop' || k || 'DbContext' as line, 'node://app:Shop/repo:' || k || '/uicomponent:OrderForm' || k as id, 'OrderForm' || k as c from keys union all select 'Request flows', 'OrderList' || k || ' · GET /api/orders' || k || '/${id} · GET /api/Orders' || k || '/{id} · GetOrder' || k || 'Query ·  · ', 'node://app:Shop/repo:' || k || '/uicomponent:OrderList' || k, 'OrderList' || k from keys"
    audits = "select 'Audit' as section, 'order changed · ' || string_agg('Order' || k || 'Service:order changed', ', ' order by 'Order' || k || 'Service:order changed') as line from keys"
    rest = quoted([x for x in _SAID if x[0] not in _MERGED])
    return f"""with keys as (select s_suppkey::varchar as k from supplier), flows as ({flows})
select section, replace(line, '__K__', k) as line from keys cross join (values {rest}) t(section, line)
union all select * from (values {quoted(_SAID_ONCE)}) t(section, line) union all {audits}
union all select section, line from (select * from flows order by c, id limit 8)
union all select 'Public endpoints', (2 * count(*) + 1)::varchar || ' · ' || (4 * count(*) + 1)::varchar from keys"""


@query(_sections_sql())
def engine_sections(spark, sf_dir):
    """Pages' sections of a run with all extractors, over every product's sources: what extractors write is what the pages read."""
    store = _store(spark, "sections")
    engine.run(spark, store, "Shop", _tree(spark, sf_dir, sources.DOTNET + sources.REACT + sources.ANGULAR + _SCREENS), "s1", "2024-01-01 00:00:00", pages=())
    nodes, edges = store.latest("nodes", "Shop"), store.latest("edges", "Shop")
    out = None
    for section in ("API reference", "Features", "Filters", "Entities", "Data", "Stores", "Used by", "Audit", "Workflows", "Business rules", "Request flows", "Public endpoints"):
        rows = R.lines(R.SECTIONS[section](nodes, edges), ()).select(F.lit(section).alias("section"), F.regexp_replace("line", "^- ", "").alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""with k as (select count(*) as n from supplier) select * from (
select 'committed again' as item, 0::bigint as n union all select 'nodes', 0 union all select 'rival', 1 union all select 'after it ended', 1
union all select 'snapshots', 1 union all select 'log steps', 6 union all select 'fallbacks', 1) t where (select n from k) > 0""")
def engine_commits(spark, sf_dir):
    """A run of an id that is committed changes nothing, a rival is turned away while a run has the application; the log and the pages' fallbacks are there."""
    store, tree = _store(spark, "commits"), _tree(spark, sf_dir)
    some = [s for s in _specs() if s.name in ("packages", "csharp_types")]
    engine.run(spark, store, "Shop", tree, "s1", "2024-01-01 00:00:00", specs=some, pages=_PAGES)
    before = store.latest("nodes", "Shop").count()
    nodes, edges = store.latest("nodes", "Shop"), store.latest("edges", "Shop")
    again = store.commit_snapshot("Shop", "s1", "2024-01-05 00:00:00", nodes.where("kind <> 'Project'"), edges.limit(0))
    store.begin("Shop", "other")
    rival = engine.run(spark, store, "Shop", tree, "s2", "2024-01-02 00:00:00", specs=some, pages=_PAGES)
    store.end("Shop")
    ended = store.begin("Shop", "third")
    rows = [("committed again", int(again)), ("nodes", store.latest("nodes", "Shop").count() - before), ("rival", int(rival.status == "Rejected")), ("after it ended", int(ended)), ("snapshots", store.snapshots().count()),
            ("log steps", store.read("log").select("step").distinct().count()), ("fallbacks", store.read("fallbacks").count())]
    return spark.createDataFrame(rows, "item string, n long")


@query("""select 'P' || s_suppkey as path, case when s_suppkey % 2 = 0 then 2 else 1 end as version, case when s_suppkey % 2 = 0 then 'new ' else 'old ' end || s_name as content from supplier where s_suppkey % 5 <> 4
union all select 'P' || s_suppkey, 1, 'old ' || s_name from supplier where s_suppkey % 5 = 4 and s_suppkey % 2 = 1 union all select 'P' || s_suppkey, 2, 'new ' || s_name from supplier where s_suppkey % 5 = 4 and s_suppkey % 2 = 0""")
def page_store(spark, sf_dir):
    """Pages of every supplier, of which every second is written again; another application's pages are cleared and not seen any more."""
    pages, rows = Pages(_store(spark, "pages")), Star(spark, sf_dir).table("supplier")
    told = lambda word, some: some.select(F.concat(F.lit("P"), "s_suppkey").alias("path"), F.lit(0).alias("part"), F.concat(F.lit(word), "s_name").alias("content"), F.lit("text/plain").alias("content_type"))
    for application in ("Shop", "Gone"):
        pages.write(application, told("old ", rows), 1)
    pages.write("Shop", told("new ", rows.where("s_suppkey % 2 = 0")), 2)
    pages.write("Shop", told("late ", rows), 2)  # a rival that comes second
    pages.clear("Gone", 2)
    return pages.read("Shop").select("path", "version", "content").unionByName(pages.read("Gone").select("path", "version", "content"))


@query("""select name, status, coalesce(version, 0) as version from (values ('first', 'Api', 'Completed', 1), ('first', 'Shop', 'Completed', 1), ('second', 'Api', 'Skipped', 0), ('second', 'Shop', 'Skipped', 0), ('third', 'Api', 'Completed', 2), ('third', 'Shop', 'Completed', 2)) t(turn, app, status, version),
lateral (select turn || ' ' || app as name) where (select count(*) from supplier) > 0""")
def estate_runs(spark, sf_dir):
    """An estate of a parent and a child: run, skipped while nothing has changed, and run again after the child's sources changed, which the parent takes from its snapshot."""
    store, tree = _store(spark, "estate"), _tree(spark, sf_dir)
    names = [r["repository"] for r in tree.select("repository").distinct().orderBy("repository").limit(2).collect()]  # the first two products
    estate = spark.createDataFrame([("Shop", [names[0]], ["Api"], True, False), ("Api", [names[1]], [], True, False)], "name string, repos array<string>, children array<string>, skip_if_unchanged boolean, force boolean")
    some = [s for s in _specs() if s.name in ("csharp_types", "csharp_entities")]
    moved = tree.withColumn("commit", F.when(F.col("repository") == names[1], "c2").otherwise(F.col("commit"))).withColumn("text", F.when(F.col("repository") == names[1], F.regexp_replace("text", r"\bLine(?=\d)", "Item")).otherwise(F.col("text")))
    rows = []
    for turn, (name, files) in enumerate((("first", tree), ("second", tree), ("third", moved))):
        for app, r in engine.run_estate(spark, store, estate, files, f"r{turn}", f"2024-01-0{turn + 1} 00:00:00", some, _PAGES).items():
            rows.append((f"{name} {app}", r.status, r.version or 0))
    return spark.createDataFrame(rows, "name string, status string, version int")


@query("""with f as (select coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id as path, doc_id, n_chars from documents)
select path, case when doc_id % 13 = 0 then 'added' when doc_id % 11 = 0 then 'deleted' else 'changed' end as change from f
where (doc_id % 13 = 0) <> (doc_id % 11 = 0) or (doc_id % 13 <> 0 and doc_id % 11 <> 0 and doc_id % 7 = 0)""")
def changed_files(spark, sf_dir):
    """Every document as a file in its source's and language's folder, before and after some came, went and were written again."""
    from lodestar.operators import trees
    d = Star(spark, sf_dir).table("documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    before = d.where("doc_id % 13 <> 0").select(path.alias("path"), F.xxhash64("text").alias("digest"))
    after = d.where("doc_id % 11 <> 0").select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.xxhash64(F.concat(F.coalesce("text", F.lit("")), F.lit("x")))).otherwise(F.xxhash64("text")).alias("digest"))
    return trees.changed_files(before, after)


_ACCESS = "case when {s} = 'BUILDING' then '[AllowAnonymous]' when {s} = 'MACHINERY' then '[Authorize(Roles = \"a\")]' when {s} = 'FURNITURE' and {k} % 2 = 0 then '[Authorize, AllowAnonymous]' end"


@query(f"""with recursive t as (select c_custkey as node, case when c_custkey >= 2 then c_custkey // 2 end as parent, {_ACCESS.format(s="c_mktsegment", k="c_custkey")} as attributes from customer),
said as (select node, parent, case when attributes like '%AllowAnonymous%' then 'anonymous' when attributes is not null then 'Authorize(Roles = "a")' end as value from t),
walk(node, up, value) as (select node, parent, value from said union all select walk.node, said.parent, said.value from walk join said on said.node = walk.up where walk.value is null),
known as (select node, max(value) as value from walk where value is not null group by node),
own as (select o_orderkey as method, o_custkey as node, case when o_orderstatus = 'P' then 'anonymous' end as own from orders)
select method, coalesce(own, value) as access from own left join known using (node)""")
def inherited_access(spark, sf_dir):
    """Orders as methods of customers, each of which is a type whose base has half its key: who may call what."""
    from lodestar.operators import graph
    star = Star(spark, sf_dir)
    types = star.table("customer").select(F.col("c_custkey").alias("node"), F.expr("case when c_custkey >= 2 then c_custkey div 2 end").alias("parent"), F.expr(_ACCESS.format(s="c_mktsegment", k="c_custkey")).alias("attributes"))
    methods = star.table("orders").select(F.col("o_orderkey").alias("method"), F.col("o_custkey").alias("node"), F.when(F.col("o_orderstatus") == "P", "[AllowAnonymous]").alias("attributes"))
    return graph.authorization(methods, types)


@query("""with f as (select coalesce(source, 'none') as page, n_chars, doc_id, coalesce(lang, '-') || ' ' || doc_id || ': ' || coalesce(n_chars, 0) || ' characters' as line from documents),
ranked as (select *, row_number() over (partition by page order by n_chars desc nulls last, doc_id, line) as n from f),
summed as (select *, sum(length(line) + 1) over (partition by page order by n) - 1 as total from ranked)
select page, string_agg(line, chr(10) order by n) as text, count(*)::bigint as facts from summed where total <= 400 group by page""")
def grounded_pages(spark, sf_dir):
    """Documents as facts about their source, the longest first, as many as 400 characters hold."""
    d = Star(spark, sf_dir).table("documents")
    line = F.concat(F.coalesce("lang", F.lit("-")), F.lit(" "), F.col("doc_id").cast("string"), F.lit(": "), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit(" characters"))
    rows = d.select(F.coalesce("source", F.lit("none")).alias("page"), "n_chars", "doc_id", line.alias("line"))
    return R.grounded(rows, [F.col("n_chars").desc_nulls_last(), F.col("doc_id").asc()], 400)
