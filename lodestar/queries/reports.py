"""Report sections over a snapshot with a small product for each supplier, and over the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import reports as R
from lodestar.plans.starmap import STAR_SQL, Star
from lodestar.queries.registry import query

_N = "identity string, kind string, properties map<string,string>, confidence double"
_E = "type string, from_id string, to_id string, seq long"


def _i(kind: str, name: str) -> str:
    return f"node://app:Shop__K__/{kind}:{name}"


#: A product's nodes and edges; __K__ stands for the supplier's key.
NODES = [
    (_i("c", "List__K__"), "UIComponent", {}, 0.9), (_i("c", "Edit__K__"), "UIComponent", {}, 0.9), (_i("c", "Alone__K__"), "UIComponent", {}, 0.9), (_i("call", "GET list__K__"), "ApiCall", {}, 0.7), (_i("call", "PUT item__K__"), "ApiCall", {}, 0.7),
    (_i("endpoint", "GET list__K__"), "Endpoint", {"verb": "GET", "route": "/api/items__K__", "authorization": "anonymous"}, 1.0), (_i("endpoint", "PUT item__K__"), "Endpoint", {"verb": "PUT", "route": "/api/items__K__/{id}"}, 1.0),
    (_i("ctl", "ItemsController"), "Controller", {"name": "Items__K__"}, 1.0), (_i("cmd", "UpdateItem__K__"), "Command", {}, 0.9), (_i("handler", "UpdateItem__K__Handler"), "Handler", {}, 0.9),
    (_i("type", "Shop.ItemRepository__K__"), "Repository", {}, 0.9), (_i("op", "1"), "DatabaseOperation", {"owner": "ItemRepository__K__"}, 0.8), (_i("tech", "MediatR__K__"), "Technology", {"category": "CQRS"}, 1.0),
    (_i("role", "admin__K__"), "Role", {}, 0.9), (_i("route", "users"), "Route", {"path": "/users__K__", "roles": "admin__K__; owner"}, 0.9), (_i("route", "open"), "Route", {"path": "/open__K__"}, 0.9),
    (_i("filter", "status"), "Filter", {"component": "List__K__", "shape": "single-value"}, 0.7), (_i("token", "access__K__"), "TokenStorage", {"operation": "get"}, 0.7), (_i("token", "refresh"), "TokenStorage", {"operation": "get+set"}, 0.7),
    (_i("entity", "Order__K__"), "Entity", {}, 1.0), (_i("entity", "Line__K__"), "Entity", {}, 1.0), (_i("store", "Db__K__"), "DataStore", {}, 1.0),
    (_i("tech", "EF__K__"), "Technology", {"category": "Data", "usage": "OrderService__K__ (Add(Order__K__), Save); CartService__K__ (Find(Order__K__))"}, 1.0)]
EDGES = [
    ("EXPOSES", _i("ctl", "ItemsController"), _i("endpoint", "GET list__K__"), 1), ("CALLS", _i("c", "List__K__"), _i("call", "GET list__K__"), 2), ("CALLS", _i("c", "Edit__K__"), _i("call", "PUT item__K__"), 3),
    ("MAPS_TO", _i("call", "GET list__K__"), _i("endpoint", "GET list__K__"), 4), ("MAPS_TO", _i("call", "PUT item__K__"), _i("endpoint", "PUT item__K__"), 5), ("DISPATCHES", _i("endpoint", "PUT item__K__"), _i("cmd", "UpdateItem__K__"), 6),
    ("HANDLES", _i("handler", "UpdateItem__K__Handler"), _i("cmd", "UpdateItem__K__"), 7), ("DEPENDS_ON", _i("handler", "UpdateItem__K__Handler"), _i("type", "Shop.ItemRepository__K__"), 8), ("RENDERS", _i("c", "List__K__"), _i("c", "Edit__K__"), 9),
    ("GATES", _i("role", "admin__K__"), _i("c", "List__K__"), 10), ("HAS_MANY", _i("entity", "Order__K__"), _i("entity", "Line__K__"), 11), ("OWNS", _i("store", "Db__K__"), _i("entity", "Order__K__"), 12)]


def _snapshot(spark, sf_dir):
    """The product's nodes and edges for every supplier."""
    keys = Star(spark, sf_dir).table("supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    put = lambda v: F.replace(F.lit(v), F.lit("__K__"), F.col("k"))
    none = F.create_map().cast("map<string,string>")
    bag = lambda p: F.create_map(*[c for k, v in p.items() for c in (F.lit(k), put(v))]) if p else none
    nodes = F.array(*[F.struct(put(i).alias("identity"), F.lit(k).alias("kind"), bag(p).alias("properties"), F.lit(c).alias("confidence")) for i, k, p, c in NODES])
    edges = F.array(*[F.struct(F.lit(t).alias("type"), put(a).alias("from_id"), put(b).alias("to_id"), F.lit(n).cast("long").alias("seq")) for t, a, b, n in EDGES])
    return keys.select(F.explode(nodes).alias("n")).select("n.*"), keys.select(F.explode(edges).alias("e")).select("e.*")


def _values(columns: str, *rows: tuple) -> str:
    """SQL of the rows for every supplier."""
    quoted = lambda v: "null::varchar" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    said = ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    put = ", ".join(f"replace({c}, '__K__', s_suppkey::varchar) as {c}" for c in columns.split(", "))
    return f"select {put} from supplier cross join (values {said}) t({columns})"


def _add(name: str, section: str, sql: str, columns: tuple[str, ...]) -> None:
    def run(spark, sf_dir):
        rows = R.SECTIONS[section](*_snapshot(spark, sf_dir))
        kinds = dict(rows.dtypes)
        return rows.select(*[F.array_join(c, ", ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])
    run.__name__ = name
    query(sql)(run)


_FLOW = ("component", "call", "endpoint", "message", "handler", "dependencies")
_add("report_request_flows", "Request flows", "with f as (" + _values("id, " + ", ".join(_FLOW), (_i("c", "List__K__"), "List__K__", "GET list__K__", "GET list__K__", None, None, None), (_i("c", "Edit__K__"), "Edit__K__", "PUT item__K__", "PUT item__K__", "UpdateItem__K__", "UpdateItem__K__Handler", "ItemRepository__K__")) + f") select {', '.join(_FLOW)} from (select * from f order by component, id limit 8)", _FLOW)
_add("report_api_reference", "API reference", _values("owner, verb, route", ("Items__K__", "GET", "/api/items__K__"), ("General", "PUT", "/api/items__K__/{id}")), ("owner", "verb", "route"))
_add("report_features", "Features", _values("owner, phrase", ("Items__K__", "List Items__K__"), ("General", "Update a Items__K__")), ("owner", "phrase"))
_add("report_role_access", "Access", _values("role, endpoints", ("admin__K__", "GET list__K__, PUT item__K__")), ("role", "endpoints"))
_add("report_navigation", "Navigation", _values("role, path", ("admin__K__", "/users__K__")), ("role", "path"))
_add("report_unused_components", "Unused components", _values("name", ("Alone__K__",)), ("name",))
_add("report_filters", "Filters", _values("component, single, multi, tabs", ("List__K__", "status", "", "")), ("component", "single", "multi", "tabs"))
_add("report_entities", "Data", _values("line", ("Order__K__ ||--o{ Line__K__",)), ("line",))
_add("report_tokens", "Tokens", _values("name", ("access__K__",)), ("name",))
_add("report_technology", "Technology", _values("category, name", ("CQRS", "MediatR__K__"), ("Data", "EF__K__")), ("category", "name"))
_add("report_public", "Public endpoints", "select 2 * count(*) as public, 2 * count(*) as total from supplier", ("public", "total"))
_add("report_overview", "Overview", "select kind, (n * (select count(*) from supplier))::bigint as n from (values " + ", ".join(f"('{k}', {sum(x[1] == k for x in NODES)})" for k in sorted({x[1] for x in NODES})) + ") t(kind, n)", ("kind", "n"))
_add("report_patterns", "Patterns", "select * from (values ('CQRS', true), ('Event-driven', false), ('Repository', true), ('Validation pipeline', false), ('Layered projects', false), ('Background processing', false), ('Single-page front end', true)) t(pattern, present)", ("pattern", "present"))
_add("report_used_by", "Used by", _values("entity, classes", ("Order__K__", "CartService__K__, OrderService__K__")), ("entity", "classes"))
_add("report_stores", "Stores", _values("store, entities", ("Db__K__", "Order__K__")), ("store", "entities"))
_add("report_sequences", "Sequences", "with f as (" + _values("id, component, lines", (_i("c", "List__K__"), "List__K__", "List__K__->>GET list__K__: calls"), (_i("c", "Edit__K__"), "Edit__K__", "Edit__K__->>PUT item__K__: calls\nPUT item__K__->>UpdateItem__K__: dispatches\nUpdateItem__K__->>UpdateItem__K__Handler: handled by\nUpdateItem__K__Handler->>ItemRepository__K__: uses")) + ") select component, lines from (select * from f order by component, id limit 8)", ("component", "lines"))
_add("report_journeys", "Journeys", _values("role, steps", ("admin__K__", "GET list__K__, PUT item__K__")), ("role", "steps"))
_add("report_components", "Component diagram", "with f as (" + _values("source, type, target, n", *[(a.rsplit(":", 1)[1], t, b.rsplit(":", 1)[1], f"{n:02d}") for t, a, b, n in EDGES if t in ("CALLS", "RENDERS")]) + ") select source || ' -->|' || lower(type) || '| ' || target as line from f", ("line",))


@query("with s as (select count(*) as k from supplier) select title as page, title <> 'Messaging' and title <> 'Workflows' as shown from (values " + ", ".join(f"('{t}')" for t in R.PAGES) + ") t(title), s where k > 0")
def report_page_set(spark, sf_dir):
    return R.page_set(_snapshot(spark, sf_dir)[0])


def _plain(*said: str) -> str:
    """SQL of a section's lines for every supplier, ordered by their text."""
    return "select '' as o1, '' as o2, line from (" + _values("line", *[(x,) for x in said]) + ")"


_NAME = {i: p.get("name", i.rsplit(":", 1)[1]) for i, _, p, _ in NODES}
_FLOWS = [(_i("c", "List__K__"), "List__K__", "GET list__K__ · GET list__K__ ·  ·  · ", "List__K__->>GET list__K__: calls"), (_i("c", "Edit__K__"), "Edit__K__", "PUT item__K__ · PUT item__K__ · UpdateItem__K__ · UpdateItem__K__Handler · ItemRepository__K__",
          "Edit__K__->>PUT item__K__: calls\nPUT item__K__->>UpdateItem__K__: dispatches\nUpdateItem__K__->>UpdateItem__K__Handler: handled by\nUpdateItem__K__Handler->>ItemRepository__K__: uses")]
_flows = lambda at: "select '' as o1, '' as o2, component || ' · ' || said as line from (select * from (" + _values("id, component, said", *[(f[0], f[1], f[at]) for f in _FLOWS]) + ") order by component, id limit 8)"
#: The lines of every section that has any, read off the product by hand; those that count, rank or choose among products are computed.
_LINES = {
    "Overview": "select lpad((1000000000000000 - n)::varchar, 16, '0') as o1, kind as o2, kind || ' · ' || n as line from (select kind, (n * (select count(*) from supplier))::bigint as n from (values " + ", ".join(f"('{k}', {sum(x[1] == k for x in NODES)})" for k in sorted({x[1] for x in NODES})) + ") t(kind, n))",
    "Features": _plain("Items__K__ · List Items__K__", "General · Update a Items__K__"), "Journeys": _plain("admin__K__ · GET list__K__, PUT item__K__"), "Sequences": _flows(3),
    "Architecture": "select '' as o1, '' as o2, source || ' · ' || type || ' · ' || target as line from (select * from (" + _values("seq, type, a, b, source, target", *[(f"{n:02d}", t, a, b, _NAME[a], _NAME[b]) for t, a, b, n in EDGES]) + ") order by seq, type, a, b limit 50)",
    "Patterns": "select '' as o1, '' as o2, line from (values " + ", ".join(f"('{p} · {str(p in ('CQRS', 'Repository', 'Single-page front end')).lower()}')" for p, _ in R.PATTERNS) + ") t(line)", "Request flows": _flows(2),
    "API reference": "select owner as o1, lpad((row_number() over (partition by owner order by route, verb, id))::varchar, 16, '0') as o2, owner || ' · ' || name || ' · ' || verb || ' · ' || route || ' · ' as line from ("
                     + _values("owner, name, verb, route, id", ("Items__K__", "GET list__K__", "GET", "/api/items__K__", _i("endpoint", "GET list__K__")), ("General", "PUT item__K__", "PUT", "/api/items__K__/{id}", _i("endpoint", "PUT item__K__"))) + ")",
    "Technology": _plain("CQRS · MediatR__K__", "Data · EF__K__"), "Data": _plain("Order__K__ ||--o{ Line__K__"), "Entities": _plain("Order__K__ ·  · ", "Line__K__ ·  · "), "Stores": _plain("Db__K__ · Order__K__"),
    "Used by": _plain("Order__K__ · CartService__K__, OrderService__K__"), "Public endpoints": "select '' as o1, '' as o2, 2 * count(*) || ' · ' || 2 * count(*) as line from supplier", "Tokens": _plain("access__K__"),
    "Access": _plain("admin__K__ · GET list__K__, PUT item__K__"), "Navigation": _plain("admin__K__ · /users__K__"), "Component diagram": _plain(*[f"{_NAME[a]} -->|{t.lower()}| {_NAME[b]}" for t, a, b, _ in EDGES if t in ("CALLS", "RENDERS")]),
    "Unused components": _plain(_i("c", "Alone__K__") + " · Alone__K__"), "Filters": _plain("List__K__ · status ·  · ")}


def _pages_sql() -> str:
    """Every page whole: its title, and each section that has lines with its heading."""
    places = [(list(R.PAGES).index(page), page, page.lower().replace(" ", "-") + ".md", at, title) for at, (title, page) in enumerate(R.PAGE_OF.items())]
    body = " union all ".join(f"select {at} as place, o1, o2, '- ' || line as line from ({_LINES[title]})" for _, _, _, at, title in places if title in _LINES)
    return f"""with place as (select * from (values {", ".join(f"({n}, '{page}', '{path}', {at}, '{title}')" for n, page, path, at, title in places)}) t(n, page, path, place, title)),
body as (select distinct * from ({body})), met as (select * from place where place in (select place from body)),
said as (select path, place, 0 as level, o1, o2, line from body join met using (place)
union all select path, place, -2, '', '', '## ' || title from met union all select path, place, -1, '', '', '' from met
union all select distinct path, -1, 0, '', '', '# ' || page from met union all select distinct path, -1, 1, '', '', '' from met)
select path, md5(string_agg(line, chr(10) order by place, level, o1, o2, line)) as content from said group by path"""


@query(_pages_sql())
def report_pages(spark, sf_dir):
    """Every page whole: its parts in order."""
    pages = R.project(*_snapshot(spark, sf_dir))
    whole = pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "\n").alias("content"))
    return whole.select("path", F.md5(F.col("content").cast("binary")).alias("content"))


@query(STAR_SQL + """, c as (select case when c_custkey % 2 = 0 then 'added' else 'removed' end as change, c_custkey::varchar as k from cust)
select change, array_to_string(list(k order by k)[1:15], ', ') || case when count(*) > 15 then ', …and ' || (count(*) - 15) || ' more' else '' end as listed from c group by change""")
def report_changelog(spark, sf_dir):
    c = Star(spark, sf_dir).customers().select("identity", F.when(F.col("c_custkey") % 2 == 0, "added").otherwise("removed").alias("change"))
    return R.changelog(c)
