"""Graph lookups, traversals and reports over the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import identity as I
from lodestar.functions.text import capped_list
from lodestar.operators import graph, resolve, validate
from lodestar.operators.merge import first_by
from lodestar.plans import sources
from lodestar.plans.starmap import STAR_SQL, Star
from lodestar.queries.registry import query


@query(STAR_SQL + "select c_custkey, identity from cust")
def identity_mint(spark, sf_dir):
    return Star(spark, sf_dir).customers().select("c_custkey", "identity")


@query(STAR_SQL + "select identity, app as app_value, repo as repo_value, 3::bigint as n_segments from cust")
def identity_parse(spark, sf_dir):
    ids = Star(spark, sf_dir).customers().select("identity")
    return ids.select("identity", I.segment(F.col("identity"), "app").alias("app_value"), I.segment(F.col("identity"), "repo").alias("repo_value"), F.size(I.segments(F.col("identity"))).cast("long").alias("n_segments"))


@query(STAR_SQL + "select identity, replace(replace(split_part(split_part(identity, '/', -1), ':', -1), '%2F', '/'), '%25', '%') as short from nodes")
def short_name(spark, sf_dir):
    return Star(spark, sf_dir).nodes().select("identity", I.short_name(F.col("identity")).alias("short"))


@query(STAR_SQL + "select split_part(split_part(identity, '/', 3), ':', 2) as owner, count(*) as n from nodes group by 1")
def owning_app(spark, sf_dir):
    return Star(spark, sf_dir).nodes().groupBy(I.owning_app(F.col("identity")).alias("owner")).agg(F.count("*").alias("n"))


@query("select s_suppkey, 'node://part:' || replace(replace(s_name || '/50%', '%', '%25'), '/', '%2F') as identity, s_name || '/50%' as decoded from supplier")
def identity_encode(spark, sf_dir):
    raw = F.concat("s_name", F.lit("/50%"))
    ids = Star(spark, sf_dir).table("supplier").select("s_suppkey", I.mint(("part", raw)).alias("identity"))
    return ids.withColumn("decoded", I.short_name(F.col("identity")))


@query(STAR_SQL + "select identity, kind from nodes where identity = 'node://app:CATALOG/part:7'")
def node_lookup(spark, sf_dir):
    return graph.node_lookup(Star(spark, sf_dir).nodes(), "node://app:CATALOG/part:7").select("identity", "kind")


@query(STAR_SQL + "select type, from_id, to_id from edges where from_id in (select identity from ords where o_orderkey = 5)")
def out_edges(spark, sf_dir):
    star = Star(spark, sf_dir)
    source = star.orders().where("o_orderkey = 5").first()["identity"]  # the one identity that is asked for
    return graph.out_edges(star.edges(), source).select("type", "from_id", "to_id")


@query(STAR_SQL + """, start as (select identity from ords where o_orderkey = 5),
walk as (select identity as node, 0 as depth from start
  union select to_id, depth + 1 from walk join edges on from_id = node where depth < 3)
select node, min(depth)::bigint as depth, coalesce(any_value(kind), '?') as kind from walk left join nodes on identity = node
where node not in (select identity from start) group by node""")
def traverse_depth_k(spark, sf_dir):
    star = Star(spark, sf_dir)
    source = star.orders().where("o_orderkey = 5").first()["identity"]  # the one identity that is asked for
    return graph.traverse(star.nodes(), star.edges(), source, 3).select("node", F.col("depth").cast("long").alias("depth"), "kind")


@query(STAR_SQL + """, up as (select from_id as node from tree where to_id = 'node://app:ASIA' union select from_id from tree join up on to_id = node) select node from up""")
def impact_closure(spark, sf_dir):
    return graph.impact(Star(spark, sf_dir).edges(lines=False), "node://app:ASIA").select("node")


_RING = [("A__K__", "B__K__"), ("B__K__", "C__K__"), ("C__K__", "A__K__"), ("D__K__", "B__K__"), ("E__K__", "F__K__")]


@query(f"""with recursive e as {sources.products_sql(_RING, "from_id, to_id")},
up as (select from_id as node from e where to_id = 'A7' union select from_id from e join up on to_id = node) select node from up""")
def impact_cycle(spark, sf_dir):
    return graph.impact(sources.products(Star(spark, sf_dir), _RING, "from_id string, to_id string"), "A7").select("node")


@query(STAR_SQL + "select identity from nodes where contains(upper(identity), 'RING') or len(list_filter(props, lambda p: contains(upper(p), 'RING'))) > 0")
def search_nodes(spark, sf_dir):
    return graph.search(Star(spark, sf_dir).nodes(), "ring").select("identity")


@query(STAR_SQL + ", r as (select r_name as role, 'node://app:' || r_name as node from region), back as (select role, node from r union select role, from_id from back join tree on to_id = node) select role, count(*) as reached from back group by role")
def reach_by_role(spark, sf_dir):
    star = Star(spark, sf_dir)
    back = star.edges(lines=False).select("type", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    roles = star.table("region").select(F.col("r_name").alias("source"), I.mint(("app", F.col("r_name"))).alias("node"))
    return graph.reach(back, roles, ["PART_OF", "LOCATED_IN", "PLACED_BY"]).groupBy(F.col("source").alias("role")).agg(F.count("*").alias("reached"))


@query(STAR_SQL + "select identity from cust where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)")
def orphans(spark, sf_dir):
    star = Star(spark, sf_dir)
    return star.customers().join(star.table("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("identity")


@query(STAR_SQL + "select kind, count(*) as n from nodes group by kind")
def kind_histogram(spark, sf_dir):
    return Star(spark, sf_dir).nodes().groupBy("kind").agg(F.count("*").alias("n"))


@query(STAR_SQL + "select app, repo, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as suppliers, count(*) as n from supp group by app, repo")
def owner_grouping(spark, sf_dir):
    rows = Star(spark, sf_dir).suppliers().groupBy("app", "repo").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"), F.count("*").alias("n"))
    return rows.select("app", "repo", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("suppliers"), "n")


@query("select p_type, arg_min(p_partkey, p_partkey) as first_part, arg_min(p_name, p_partkey) as first_name from part group by p_type")
def distinct_by_first(spark, sf_dir):
    parts = Star(spark, sf_dir).table("part").select("p_type", F.col("p_partkey").alias("first_part"), F.col("p_name").alias("first_name"))
    return first_by(parts, ["p_type"], ["first_part"])


@query("select o_custkey, count(distinct o_orderstatus) as states from orders group by o_custkey having count(distinct o_orderstatus) >= 2")
def having_states(spark, sf_dir):
    return Star(spark, sf_dir).table("orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("states")).where("states >= 2")


@query("""select user_id, case when bool_or(event_type = 'view') and bool_or(event_type = 'click') then 'get+set'
  when bool_or(event_type = 'click') then 'set' when bool_or(event_type = 'view') then 'get' else 'none' end as operation from events group by user_id""")
def set_fold_get_set(spark, sf_dir):
    seen = Star(spark, sf_dir).table("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "view").alias("g"), F.bool_or(F.col("event_type") == "click").alias("s"))
    return seen.select("user_id", F.when(F.col("g") & F.col("s"), "get+set").when(F.col("s"), "set").when(F.col("g"), "get").otherwise("none").alias("operation"))


@query(STAR_SQL + """, firsts as (select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey),
lines as (select l_orderkey, l_partkey, sum(l_quantity)::double as qty, row_number() over (partition by l_orderkey order by sum(l_quantity) desc, l_partkey) as rank from lineitem group by l_orderkey, l_partkey)
select c_custkey, app, repo, f.o_orderkey, string_agg(l_partkey::varchar, ',' order by rank) as top_parts from firsts f join cust on o_custkey = c_custkey left join lines on l_orderkey = f.o_orderkey and rank <= 3
group by c_custkey, app, repo, f.o_orderkey""")
def chain_request_flow(spark, sf_dir):
    star = Star(spark, sf_dir)
    firsts = star.table("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    lines = star.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    top = resolve.top_per_group(lines, ["l_orderkey"], [F.desc("qty"), "l_partkey"], 3).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("rank", "l_partkey"))).alias("t"))
    chain = firsts.join(star.customers(), F.col("o_custkey") == F.col("c_custkey")).join(top, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return chain.select("c_custkey", "app", "repo", "o_orderkey", F.array_join(F.transform("t", lambda x: x["l_partkey"].cast("string")), ",").alias("top_parts"))


@query("select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def topn_per_group(spark, sf_dir):
    return resolve.top_per_group(Star(spark, sf_dir).table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""select 'has_errors' as pattern, bool_or(event_type = 'error') as present from events union all select 'many_signups', count_if(event_type = 'signup') >= 2 from events
union all select 'has_refunds', bool_or(event_type = 'refund') from events""")
def pattern_flags(spark, sf_dir):
    e = Star(spark, sf_dir).table("events").agg(F.bool_or(F.col("event_type") == "error").alias("a"), (F.count_if(F.col("event_type") == "signup") >= 2).alias("b"), F.bool_or(F.col("event_type") == "refund").alias("c"))
    return e.select(F.expr("stack(3, 'has_errors', a, 'many_signups', b, 'has_refunds', c) as (pattern, present)"))


@query("select count_if(o_orderstatus = 'O') as public, count(*) as total, round(count_if(o_orderstatus = 'O')::double / count(*), 9) as ratio from orders")
def public_ratio(spark, sf_dir):
    o = Star(spark, sf_dir).table("orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("public"), F.count("*").alias("total"))
    return o.select("public", "total", F.round(F.col("public") / F.col("total"), 9).alias("ratio"))


@query("select distinct r_name || ' ||--o{ ' || n_name as er from nation join region on n_regionkey = r_regionkey")
def er_edges(spark, sf_dir):
    return Star(spark, sf_dir).places().select(F.concat("app", F.lit(" ||--o{ "), "repo").alias("er")).distinct()


@query("""select c_nationkey::bigint as nation, array_to_string(list(c_custkey order by c_custkey)[1:15], ', ') || case when count(*) > 15 then ', …and ' || (count(*) - 15) || ' more' else '' end as listed from customer group by c_nationkey""")
def capped_list_marker(spark, sf_dir):
    g = Star(spark, sf_dir).table("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("k"))
    return g.select(F.col("c_nationkey").cast("long").alias("nation"), capped_list(F.transform("k", lambda k: k.cast("string")), 15).alias("listed"))


DAG = [("web__K__", "core__K__"), ("web__K__", "auth__K__"), ("auth__K__", "core__K__"), ("jobs__K__", "core__K__"), ("portal__K__", "web__K__"), ("portal__K__", "jobs__K__")]


@query(f"""with recursive e as {sources.products_sql(DAG, "parent, child")}, n as (select parent as node from e union select child from e),
up as (select node, 0 as level from n where node not in (select parent from e) union all select parent, level + 1 from up join e on child = node)
select node, max(level)::bigint as level from up group by node""")
def topo_levels(spark, sf_dir):
    e = sources.products(Star(spark, sf_dir), DAG, "parent string, child string")
    # a parent waits for its children, so it is what the level order calls the later one
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct()
    return graph.levels(nodes, e).select("node", F.col("level").cast("long").alias("level"))


_CIRCLES = [("a__K__", "b__K__"), ("b__K__", "c__K__"), ("c__K__", "a__K__"), ("d__K__", "a__K__"), ("e__K__", "d__K__"), ("f__K__", "f__K__")]


@query(f"""with recursive e as {sources.products_sql(_CIRCLES, "child, parent")},
r as (select child as a, parent as b from e union select a, parent from r join e on child = b) select distinct a as node from r where a = b""")
def cycle_detect(spark, sf_dir):
    return graph.on_cycles(sources.products(Star(spark, sf_dir), _CIRCLES, "child string, parent string"))


@query(STAR_SQL + """, broken as (select identity, kind, (length(identity) % 13) / 10.0 as confidence, length(identity) % 7 = 0 as bare from nodes where not (kind = 'Part' and length(identity) % 5 = 0)
  union all select identity, 'a/' || kind, null, true from nodes where kind = 'Application'),
links as (select type, from_id, to_id from edges union all select 'PART OF', from_id, from_id from tree where type = 'PART_OF' union all select '', to_id, from_id from tree where type = 'PART_OF')
select 'duplicate_identity' as rule, count(*) as violations from (select identity from broken group by 1 having count(*) > 1)
union all select 'dangling_from', count(*) from links where from_id not in (select identity from broken) union all select 'dangling_to', count(*) from links where to_id not in (select identity from broken)
union all select 'self_edge', count(*) from links where from_id = to_id union all select 'bad_confidence', count(*) from broken where confidence is null or confidence < 0 or confidence > 1
union all select 'bad_kind', count(*) from broken where kind like '%/%' union all select 'bad_type', count(*) from links where type = '' union all select 'no_evidence', count(*) from broken where bare""")
def snapshot_invariants(spark, sf_dir):
    star = Star(spark, sf_dir)
    n, size = star.nodes().select("identity", "kind"), F.length("identity")
    some = lambda bare: F.when(bare, F.array().cast("array<string>")).otherwise(F.array(F.lit("f"))).alias("evidence")
    nodes = n.where(~((F.col("kind") == "Part") & (size % 5 == 0))).select("identity", "kind", ((size % 13) / 10.0).alias("confidence"), some(size % 7 == 0))
    nodes = nodes.unionByName(n.where("kind = 'Application'").select("identity", F.concat(F.lit("a/"), "kind").alias("kind"), F.lit(None).cast("double").alias("confidence"), some(F.lit(True))))
    parts = star.edges(lines=False).where("type = 'PART_OF'")
    edges = star.edges().select("type", "from_id", "to_id").unionByName(parts.select(F.lit("PART OF").alias("type"), "from_id", F.col("from_id").alias("to_id"))).unionByName(parts.select(F.lit("").alias("type"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return validate.invariants(nodes, edges)


@query(STAR_SQL + """, walk as (select identity as node, from_id, to_id from tree join cust on identity = from_id) select c.identity as node, p.to_id as value from cust c join tree t on t.from_id = c.identity join tree p on p.from_id = t.to_id""")
def hierarchy_nearest(spark, sf_dir):
    star = Star(spark, sf_dir)
    up = star.edges(lines=False).select(F.col("from_id").alias("node"), F.col("to_id").alias("parent"))
    named = star.table("region").select(I.mint(("app", F.col("r_name"))).alias("node"), I.mint(("app", F.col("r_name"))).alias("value"))
    return graph.nearest_ancestor(star.customers().select(F.col("identity").alias("node")), up, named)


@query(STAR_SQL + "select identity || '' as identity, c_name || ' (Customer)' as label from cust")
def node_labels(spark, sf_dir):
    n = Star(spark, sf_dir).nodes().where("kind = 'Customer'")
    return n.select("identity", I.node_label(F.col("identity"), F.col("kind"), F.col("properties")["name"]).alias("label"))


@query(STAR_SQL + "select 'PLACED_BY ' || o_orderkey || ' → ' || o_custkey as label from ords")
def edge_labels(spark, sf_dir):
    e = Star(spark, sf_dir).edges(lines=False).where("type = 'PLACED_BY'")
    return e.select(I.edge_label(F.col("type"), F.col("from_id"), F.col("to_id")).alias("label"))
