"""Merging, validating and resolving, over line items as discoveries and pages as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import merge, resolve, validate
from lodestar.plans import sources
from lodestar.plans.starmap import STAR_SQL, Star
from lodestar.queries.registry import query

_CLAMPED = "least(greatest(confidence, 0), 1)"


@query(STAR_SQL + f"select identity, round(1 - product(1 - {_CLAMPED}), 9) as confidence from disc group by identity")
def merge_confidence(spark, sf_dir):
    return merge.merged_confidence(Star(spark, sf_dir).discoveries()).select("identity", F.round("confidence", 9).alias("confidence"))


@query(STAR_SQL + "select identity, kind from (select *, row_number() over (partition by identity order by confidence desc, seq) as r from disc) where r = 1")
def merge_kind(spark, sf_dir):
    return merge.merged_kind(Star(spark, sf_dir).discoveries())


_ALTERNATES = """, won as (select identity, kind from (select *, row_number() over (partition by identity order by confidence desc, seq) as r from disc) where r = 1),
firsts as (select identity, kind, min(seq) as seq from disc group by identity, kind),
alt as (select f.identity, string_agg(f.kind, ',' order by f.seq) as alternate_kinds from firsts f join won w on f.identity = w.identity and f.kind <> w.kind group by f.identity)"""


@query(STAR_SQL + _ALTERNATES + " select identity, alternate_kinds from alt")
def merge_alternates(spark, sf_dir):
    return merge.alternate_kinds(Star(spark, sf_dir).discoveries())


_PROPERTIES = """, props as (select identity, unnest(['status', 'part']) as property, unnest([l_linestatus, l_partkey::varchar]) as value, confidence, seq from disc),
lastwins as (select identity, property, value from (select *, row_number() over (partition by identity, property order by confidence desc, seq desc) as r from props) where r = 1)"""


@query(STAR_SQL + _PROPERTIES + " select identity, property, value from lastwins")
def merge_properties(spark, sf_dir):
    return merge.merged_properties(Star(spark, sf_dir).discoveries())


@query(STAR_SQL + "select identity, count(*) as n, string_agg(l_suppkey::varchar, ',' order by seq) as repositories from disc group by identity")
def merge_evidence_count(spark, sf_dir):
    e = merge.merged_evidence(Star(spark, sf_dir).discoveries())
    return e.select("identity", F.size("evidence").cast("long").alias("n"), F.array_join(F.transform("evidence", lambda x: x["repository"]), ",").alias("repositories"))


@query(STAR_SQL + _ALTERNATES + _PROPERTIES + f""" select d.identity, any_value(w.kind) as kind, any_value(a.alternate_kinds) as alternate_kinds, any_value(s.value) as status, any_value(p.value) as part, count(*) as n_evidence,
  round(1 - product(1 - {_CLAMPED}), 9) as confidence from disc d join won w using (identity) left join alt a using (identity)
  join lastwins s on s.identity = d.identity and s.property = 'status' join lastwins p on p.identity = d.identity and p.property = 'part' group by d.identity""")
def canonical_nodes(spark, sf_dir):
    n, p = merge.canonical_nodes(Star(spark, sf_dir).discoveries()), F.col("properties")
    return n.select("identity", "kind", p["AlternateKinds"].alias("alternate_kinds"), p["status"].alias("status"), p["part"].alias("part"), F.size("evidence").cast("long").alias("n_evidence"), F.round("confidence", 9).alias("confidence"))


@query("""select 'SUPPLIES' as type, 's' || l_suppkey as from_id, 'p' || l_partkey as to_id, count(*) as members, round(1 - product(1 - least(greatest(l_tax * 10, 0), 1)), 9) as confidence
from lineitem group by l_suppkey, l_partkey""")
def edges_merged(spark, sf_dir):
    l = Star(spark, sf_dir).table("lineitem")
    found = l.select(F.col("l_orderkey").alias("seq"), F.lit("SUPPLIES").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), (F.col("l_tax") * 10).alias("confidence"))
    return merge.merged_edges(found).select("type", "from_id", "to_id", "members", F.round("confidence", 9).alias("confidence"))


@query("select event_id, event_type as kind from events where event_type not in ('view', 'click')")
def unregistered_kinds(spark, sf_dir):
    events = Star(spark, sf_dir).table("events").select("event_id", F.col("event_type").alias("kind"))
    return validate.unregistered(events, spark.createDataFrame([("view",), ("click",)], "kind string")).select("event_id", "kind")


_EDGES = """with known as (select 'c' || c_custkey as identity from customer where c_custkey % 3 = 0 union select 'o' || o_orderkey from orders where o_orderkey % 5 = 0),
e as (select o_orderkey as seq, 'o' || o_orderkey as from_id, 'c' || o_custkey as to_id from orders),
c as (select *, (from_id in (select identity from known))::int + (to_id in (select identity from known))::int as n from e)"""


def _partial(spark, sf_dir):
    star = Star(spark, sf_dir)
    known = star.table("customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("identity")).union(star.table("orders").where("o_orderkey % 5 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("identity")))
    edges = star.table("orders").select(F.col("o_orderkey").alias("seq"), F.lit("PLACED_BY").alias("type"), F.concat(F.lit("o"), "o_orderkey").alias("from_id"), F.concat(F.lit("c"), "o_custkey").alias("to_id"), (F.lit(0.5) + (F.col("o_orderkey") % 5) / 10.0).alias("confidence"))
    return edges, known


@query(_EDGES + " select case n when 2 then 'both' when 1 then 'one' else 'neither' end as class, count(*) as n from c group by 1")
def edge_endpoint_class(spark, sf_dir):
    return validate.endpoint_classes(*_partial(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"))


# An order stands in one edge only, so a customer becomes known at its first edge from a known order.
_CLOSURE = _EDGES + """, began as (select to_id, min(case when n > 0 then seq end) as seq from c group by to_id), judged as (select c.*, (n > 0 or coalesce(c.seq > began.seq, false)) as accepted from c join began using (to_id))"""


@query(_CLOSURE + " select seq, from_id, to_id from judged where not accepted")
def edges_rejected(spark, sf_dir):
    return validate.accepted(*_partial(spark, sf_dir)).where("not accepted").select("seq", "from_id", "to_id")


@query(_CLOSURE + """, ends as (select from_id as identity, seq from judged where accepted union all select to_id, seq from judged where accepted)
select identity, round(0.5 + (min(seq) % 5) / 10.0, 9)::double as confidence from ends where identity not in (select identity from known) group by identity""")
def external_nodes(spark, sf_dir):
    return validate.external_nodes(*_partial(spark, sf_dir)).select("identity", F.round("confidence", 9).alias("confidence"))


_CALLS = [(1, "GET", "/api/customer__K__"), (2, "get", "/clients__K__"), (3, "POST", "/items__K__/${id}?x=1"), (4, "GET", "/dup__K__"), (5, "DELETE", "/none"), (6, "GET", "/orders__K__/:id/")]
_ENDPOINTS = [
    (10, "GET", "/api/Customer__K__", 1), (11, "GET", "/api/v1/clients__K__", 2), (12, "POST", "/Items__K__/{itemId}", 3), (13, "GET", "/v1/dup__K__", 4), (14, "GET", "/v2/dup__K__", 5), (15, "GET", "/api/orders__K__/{id:int}", 6),
    (16, "GET", "/API/customer__K__", 7)]
_NORM = r"""'/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(lower(trim({0})), '?', 1), '\$\{{[^}}]*\}}', '{{}}', 'g'), '\{{[^}}]*\}}', '{{}}', 'g'), ':[a-z_][a-z0-9_]*', '{{}}', 'g'), '^/+|/+$', '', 'g')"""
_ROUTES = f"""with calls as {sources.products_sql(_CALLS, "call_id, verb, url", ("call_id",))}, endpoints as {sources.products_sql(_ENDPOINTS, "endpoint_id, verb, route, seq", ("endpoint_id", "seq"))},
c as (select call_id, upper(verb) as verb, {_NORM.format('url')} as norm from calls), e as (select endpoint_id, upper(verb) as verb, {_NORM.format('route')} as norm, seq from endpoints),
exact as (select call_id, arg_min(endpoint_id, seq) as endpoint_id from c join e using (verb, norm) group by call_id),
near as (select call_id, min(endpoint_id) as endpoint_id, count(*) as n from c join e on c.verb = e.verb and ends_with(e.norm, c.norm) where call_id not in (select call_id from exact) and length(c.norm) > 1 group by call_id)"""


def _routes(spark, sf_dir):
    star = Star(spark, sf_dir)
    calls = sources.products(star, _CALLS, "call_id long, verb string, url string", ("call_id",))
    return resolve.route_matches(calls, sources.products(star, _ENDPOINTS, "endpoint_id long, verb string, route string, seq long", ("endpoint_id", "seq"))), calls


@query(_ROUTES + " select call_id::bigint as call_id, endpoint_id::bigint as endpoint_id, 0.9::double as confidence from exact")
def route_exact_match(spark, sf_dir):
    return _routes(spark, sf_dir)[0].where("confidence = 0.9")


@query(_ROUTES + " select call_id::bigint as call_id, endpoint_id::bigint as endpoint_id, 0.75::double as confidence from near where n = 1")
def route_suffix_unique(spark, sf_dir):
    return _routes(spark, sf_dir)[0].where("confidence = 0.75")


@query(_ROUTES + " select call_id::bigint as call_id from calls where call_id not in (select call_id from exact) and call_id not in (select call_id from near where n = 1)")
def route_ambiguous(spark, sf_dir):
    found, calls = _routes(spark, sf_dir)
    return calls.join(found, "call_id", "left_anti").select("call_id")


@query("select s_suppkey, c_custkey, s_nationkey::bigint as project from supplier join customer on s_nationkey = c_nationkey")
def service_store_join(spark, sf_dir):
    star = Star(spark, sf_dir)
    s, c = star.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("project")), star.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("project"))
    return resolve.equal_property(s, c, "project").select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("c_custkey"), "project")


@query("select p.turn as publisher_turn, s.turn as subscriber_turn, p.conv_id as topic from conversations p join conversations s on p.conv_id = s.conv_id where p.role = 'user' and s.role = 'assistant'")
def pubsub_topic_join(spark, sf_dir):
    c = Star(spark, sf_dir).table("conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("topic"), "role")
    return resolve.equal_property(c.where("role = 'user'"), c.where("role = 'assistant'"), "topic").select(F.col("left_id").alias("publisher_turn"), F.col("right_id").alias("subscriber_turn"), "topic")


_AUDITS = [(1, "ORDER__K__"), (2, "part__K__"), (3, "Nothing")]
_ENTITIES = [(11, "Order__K__", 1), (12, "order__K__", 2), (13, "Part__K__", 3)]


@query(f"""with a as {sources.products_sql(_AUDITS, "id, name", ("id",))}, e as {sources.products_sql(_ENTITIES, "id, name, seq", ("id", "seq"))}
select a.id as left_id, arg_min(e.id, seq) as right_id from a join e on upper(a.name) = upper(e.name) group by a.id""")
def audit_entity_join(spark, sf_dir):
    star = Star(spark, sf_dir)
    return resolve.name_match(sources.products(star, _AUDITS, "id long, name string", ("id",)), sources.products(star, _ENTITIES, "id long, name string, seq long", ("id", "seq")))


@query("""with c as (select l_orderkey * 10 + l_linenumber as call_id, 'r' || (l_suppkey % 7) as repo, '/x/' || l_partkey as norm from lineitem), e as (select p_partkey as seq, 'r' || (p_partkey % 5) as server_repo, '/x/' || p_partkey as norm from part)
select distinct repo as caller_repo, server_repo from c join e using (norm) where repo <> server_repo""")
def cross_repo_dependency(spark, sf_dir):
    star = Star(spark, sf_dir)
    calls = star.table("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call_id"), F.concat(F.lit("r"), F.col("l_suppkey") % 7).alias("repo"), F.lit("get").alias("verb"), F.concat(F.lit("/X/"), "l_partkey").alias("url"))
    ends = star.table("part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("r"), F.col("p_partkey") % 5).alias("repo"), F.lit("GET").alias("verb"), F.concat(F.lit("x/"), "p_partkey", F.lit("/")).alias("route"))
    return resolve.cross_repository(calls, ends)


_RULES = [(1, "ring", "jewellery"), (2, "red", "colour"), (3, "bolt", "hardware"), (4, "widget", "gadget"), (5, "small", "size")]


@query(f"with rules(rule, fragment, category) as (values {', '.join(map(str, _RULES))}) select p_name as name, arg_min(category, rule) as category from (select distinct p_name from part) join rules on contains(upper(p_name), upper(fragment)) group by p_name")
def capability_rules(spark, sf_dir):
    return resolve.capability(Star(spark, sf_dir).table("part").select(F.col("p_name").alias("name")), spark.createDataFrame(_RULES, "rule int, fragment string, category string"))


_FILES = [("p__K__/src/a/b/x.cs",), ("p__K__/src/a/y.cs",), ("p__K__/src/z.cs",), ("p__K__/other/q.cs",)]
_PROJECTS = [("p__K__/src/a/A.csproj",), ("p__K__/src/a/b/B.csproj",)]
_NEAREST = [("p__K__/src/a/b/x.cs", "p__K__/src/a/b/B.csproj"), ("p__K__/src/a/y.cs", "p__K__/src/a/A.csproj"), ("p__K__/src/z.cs", None), ("p__K__/other/q.cs", None)]


@query(f"select * from {sources.products_sql(_NEAREST, 'path, project')}")
def nearest_project(spark, sf_dir):
    star = Star(spark, sf_dir)
    return resolve.closest_ancestor(sources.products(star, _FILES, "path string"), sources.products(star, _PROJECTS, "path string"))
