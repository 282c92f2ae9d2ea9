"""Snapshots and their differences: orders before and after two dates stand for two states of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import identity as I
from lodestar.operators import snapshots as S
from lodestar.plans.starmap import STAR_SQL, Star
from lodestar.queries.registry import query

_CUT_A, _CUT_B, _DROP = "1999-01-01", "1999-06-01", 11
_STATES = STAR_SQL + f""", a as (select identity, customer_id, o_orderkey from ords where o_orderdate < timestamp '{_CUT_A}'),
b as (select identity, customer_id, o_orderkey from ords where o_orderdate < timestamp '{_CUT_B}' and o_orderkey % {_DROP} <> 0),
ea as (select 'PLACED_BY' as type, identity as from_id, customer_id as to_id from a union all select distinct 'SUPPLIED_BY', a.identity, s.identity from a join lineitem on l_orderkey = o_orderkey join supp s on l_suppkey = s_suppkey),
eb as (select 'PLACED_BY' as type, identity as from_id, customer_id as to_id from b union all select distinct 'SUPPLIED_BY', b.identity, s.identity from b join lineitem on l_orderkey = o_orderkey join supp s on l_suppkey = s_suppkey),
dn as (select identity, 'added' as change from b where identity not in (select identity from a) union all select identity, 'removed' from a where identity not in (select identity from b)),
de as (select type, from_id, to_id, 'added' as change from eb anti join ea using (type, from_id, to_id) union all select type, from_id, to_id, 'removed' from ea anti join eb using (type, from_id, to_id))
"""


def _states(spark, sf_dir):
    star = Star(spark, sf_dir)
    o = star.orders()
    a, b = o.where(F.col("o_orderdate") < F.lit(_CUT_A).cast("timestamp_ntz")), o.where((F.col("o_orderdate") < F.lit(_CUT_B).cast("timestamp_ntz")) & (F.col("o_orderkey") % _DROP != 0))

    def edges(orders):
        placed = orders.select(F.lit("PLACED_BY").alias("type"), F.col("identity").alias("from_id"), F.col("customer_id").alias("to_id"))
        lines = star.table("lineitem").select("l_orderkey", "l_suppkey").distinct().join(star.suppliers().select("s_suppkey", F.col("identity").alias("to_id")), F.col("l_suppkey") == F.col("s_suppkey"))
        return placed.unionByName(orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("SUPPLIED_BY").alias("type"), F.col("identity").alias("from_id"), "to_id"))

    return a, b, edges(a), edges(b)


def _diffs(spark, sf_dir):
    a, b, ea, eb = _states(spark, sf_dir)
    return S.diff(a, b, ["identity"]), S.diff(ea, eb, S.EDGE_KEY)


@query(_STATES + "select identity, change from dn")
def diff_nodes(spark, sf_dir):
    return _diffs(spark, sf_dir)[0]


@query(_STATES + "select type, from_id, to_id, change from de")
def diff_edges(spark, sf_dir):
    return _diffs(spark, sf_dir)[1]


@query(_STATES + "select 'nodes' as item, count_if(change = 'added') as added, count_if(change = 'removed') as removed from dn union all select 'edges', count_if(change = 'added'), count_if(change = 'removed') from de")
def diff_counts(spark, sf_dir):
    n, e = _diffs(spark, sf_dir)
    both = n.select(F.lit("nodes").alias("item"), "change").unionByName(e.select(F.lit("edges").alias("item"), "change"))
    return both.groupBy("item").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


@query(_STATES + """, o as (select split_part(split_part(identity, '/', 3), ':', 2) as app, 'nodes' as item, change from dn union all select split_part(split_part(from_id, '/', 3), ':', 2), 'edges', change from de)
select app, count_if(item = 'nodes' and change = 'added') as nodes_added, count_if(item = 'nodes' and change = 'removed') as nodes_removed, count_if(item = 'edges' and change = 'added') as edges_added, count_if(item = 'edges' and change = 'removed') as edges_removed from o group by app""")
def diff_by_app(spark, sf_dir):
    return S.diff_by_owner(*_diffs(spark, sf_dir))


_CROSS = " from de where split_part(from_id, '/', 3) <> split_part(to_id, '/', 3)"


@query(_STATES + "select type, from_id, to_id, change" + _CROSS)
def diff_cross_app(spark, sf_dir):
    return S.cross_app(_diffs(spark, sf_dir)[1])


@query(_STATES + "select bool_or(split_part(split_part(identity, '/', 3), ':', 2) <> 'ASIA') as composite from dn")
def diff_is_composite(spark, sf_dir):
    return _diffs(spark, sf_dir)[0].agg(F.bool_or(I.owning_app(F.col("identity")) != "ASIA").alias("composite"))


_BRANDS = ("Brand#1", "brand#7", "BRAND#12")
_PART_FILES = STAR_SQL + f", stale as (select identity from parts where lower(p_brand) in ({', '.join(repr(b.lower()) for b in _BRANDS)}))"


def _part_facts(spark, sf_dir):
    parts = Star(spark, sf_dir).parts().select("identity", "p_partkey", "p_type", F.array(F.concat(F.lit("src/"), "p_brand")).alias("files"))
    return parts, spark.createDataFrame([("other/dir/" + b,) for b in _BRANDS], "file string")


@query(_PART_FILES + " select identity from stale")
def invalidated_facts(spark, sf_dir):
    return S.invalidated(*_part_facts(spark, sf_dir)).select("identity")


@query(_PART_FILES + " select identity, case when p_partkey % 4 = 0 then 'fresh' else 'carried' end as origin from parts where p_partkey % 4 = 0 or identity not in (select identity from stale)")
def carry_forward_nodes(spark, sf_dir):
    parts, changed = _part_facts(spark, sf_dir)
    return S.carry_nodes(parts.select("identity"), S.invalidated(parts, changed), parts.where("p_partkey % 4 = 0").select("identity")).select("identity", "origin")


@query(_STATES + """, known as (select identity from b union select identity from cust where c_custkey % 2 = 0)
select type, from_id, to_id, case when to_id in (select identity from cust where c_custkey % 4 = 0) then 'fresh' else 'carried' end as origin from ea
where type = 'PLACED_BY' and from_id in (select identity from known) and to_id in (select identity from known)""")
def carry_forward_edges(spark, sf_dir):
    a, b, ea, _ = _states(spark, sf_dir)
    c = Star(spark, sf_dir).customers()
    placed = ea.where("type = 'PLACED_BY'")
    fresh = placed.join(c.where("c_custkey % 4 = 0").select(F.col("identity").alias("to_id")), "to_id", "left_semi").select(*S.EDGE_KEY)
    known = b.select("identity").union(c.where("c_custkey % 2 = 0").select("identity"))
    return S.carry_edges(placed, placed.where("false"), fresh, known).select("type", "from_id", "to_id", "origin")


@query("select distinct p_brand as artifact from part where lower(p_name) in ('red widget', 'blue bolt')")
def prune_artifacts(spark, sf_dir):
    p = Star(spark, sf_dir).table("part")
    changed = spark.createDataFrame([("x/Red Widget",), ("y/blue bolt",)], "file string").select(S.basename(F.col("file")).alias("name"))
    return p.select(F.col("p_brand").alias("artifact"), S.basename(F.concat(F.lit("src/"), "p_name")).alias("name")).join(changed, "name", "left_semi").select("artifact").distinct()


@query("select event_type as application, arg_max(event_id, (ts, event_id)) as snapshot_id from events group by event_type")
def snapshot_latest(spark, sf_dir):
    e = Star(spark, sf_dir).table("events").select(F.col("event_type").alias("application"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("created_at"))
    return S.latest(e)


@query("select event_id as snapshot_id, row_number() over (order by ts, event_id) as place from events where event_type = 'signup'")
def snapshot_history(spark, sf_dir):
    from pyspark.sql import Window
    e = Star(spark, sf_dir).table("events").where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("snapshot_id"), F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long").alias("place"))


@query(STAR_SQL + "select identity, 'Customer' as kind, app as application from cust where app in ('ASIA', 'EUROPE')")
def composite_union(spark, sf_dir):
    star = Star(spark, sf_dir)
    c = star.customers()
    nodes = c.select(F.col("app").alias("application"), F.lit(2).alias("snapshot_id"), "identity", F.lit("Customer").alias("kind")).unionByName(c.where("c_custkey % 2 = 0").select(F.col("app").alias("application"), F.lit(1).alias("snapshot_id"), "identity", F.lit("Old").alias("kind")))
    snaps = star.table("region").select(F.col("r_name").alias("application"), F.explode(F.array(F.lit(1), F.lit(2))).alias("snapshot_id")).withColumn("created_at", F.col("snapshot_id"))
    return S.composite(nodes, snaps, ["ASIA", "EUROPE"])
