"""A knowledge graph over the star-schema tables: how rows become nodes, edges and discoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.identity import mint


class Star:
    """The tables of one folder and the graph that is read into them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def places(self) -> DataFrame:
        """(n_nationkey, app, repo)."""
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("app"), F.col("n_name").alias("repo"))

    def customers(self) -> DataFrame:
        c = self.table("customer").join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select("c_custkey", "app", "repo", mint(("app", F.col("app")), ("repo", F.col("repo")), ("customer", F.col("c_custkey"))).alias("identity"), "c_name", "c_mktsegment", "c_acctbal")

    def suppliers(self) -> DataFrame:
        s = self.table("supplier").join(self.places(), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select("s_suppkey", "app", "repo", mint(("app", F.col("app")), ("repo", F.col("repo")), ("supplier", F.col("s_suppkey"))).alias("identity"), "s_name")

    def orders(self) -> DataFrame:
        c = self.customers().select("c_custkey", "app", "repo", F.col("identity").alias("customer_id"))
        o = self.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
        return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "app", "repo", "customer_id", mint(("app", F.col("app")), ("repo", F.col("repo")), ("order", F.col("o_orderkey"))).alias("identity"))

    def parts(self) -> DataFrame:
        return self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", mint(("app", F.lit("CATALOG")), ("part", F.col("p_partkey"))).alias("identity"))

    def nodes(self) -> DataFrame:
        """(identity, kind, properties, confidence)."""
        def rows(df: DataFrame, kind: str, **properties: str) -> DataFrame:
            bag = F.create_map(*[x for k, c in properties.items() for x in (F.lit(k), F.col(c).cast("string"))])
            return df.select("identity", F.lit(kind).alias("kind"), bag.alias("properties"), F.lit(1.0).alias("confidence"))

        places = self.places()
        apps = self.table("region").select(mint(("app", F.col("r_name"))).alias("identity"), "r_name")
        repos = places.select(mint(("app", F.col("app")), ("repo", F.col("repo"))).alias("identity"), "repo")
        out = rows(apps, "Application", name="r_name").unionByName(rows(repos, "Repository", name="repo"))
        out = out.unionByName(rows(self.customers(), "Customer", name="c_name", segment="c_mktsegment")).unionByName(rows(self.suppliers(), "Supplier", name="s_name"))
        return out.unionByName(rows(self.orders(), "Order", status="o_orderstatus")).unionByName(rows(self.parts(), "Part", name="p_name", brand="p_brand", type="p_type"))

    def edges(self, lines: bool = True) -> DataFrame:
        """(type, from_id, to_id, seq, confidence), seq being the source's own key."""
        def rows(df: DataFrame, kind: str, source: str, target: str, seq: str) -> DataFrame:
            return df.select(F.lit(kind).alias("type"), F.col(source).alias("from_id"), F.col(target).alias("to_id"), F.col(seq).cast("long").alias("seq"), F.lit(1.0).alias("confidence"))

        app, repo = mint(("app", F.col("app"))), mint(("app", F.col("app")), ("repo", F.col("repo")))
        out = rows(self.places().withColumn("a", repo).withColumn("b", app), "PART_OF", "a", "b", "n_nationkey")
        out = out.unionByName(rows(self.customers().withColumn("b", repo), "LOCATED_IN", "identity", "b", "c_custkey"))
        out = out.unionByName(rows(self.suppliers().withColumn("b", repo), "LOCATED_IN", "identity", "b", "s_suppkey"))
        out = out.unionByName(rows(self.orders(), "PLACED_BY", "identity", "customer_id", "o_orderkey"))
        if lines:
            o = self.orders().select("o_orderkey", F.col("identity").alias("a"))
            pairs = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            part = pairs.select("a", "o_orderkey", mint(("app", F.lit("CATALOG")), ("part", F.col("l_partkey"))).alias("b")).distinct()
            supplier = pairs.join(self.suppliers().select("s_suppkey", F.col("identity").alias("b")), F.col("l_suppkey") == F.col("s_suppkey")).select("a", "o_orderkey", "b").distinct()
            out = out.unionByName(rows(part, "CONTAINS", "a", "b", "o_orderkey")).unionByName(rows(supplier, "SUPPLIED_BY", "a", "b", "o_orderkey"))
        return out

    def discoveries(self) -> DataFrame:
        """Line items as discoveries: several rows propose a node for each (order, line), seq ordering those of one node."""
        l = self.table("lineitem")
        w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        rows = l.withColumn("seq", F.row_number().over(w).cast("long"))
        evidence = F.array(F.struct(F.col("l_suppkey").cast("string").alias("repository"), F.col("l_partkey").cast("string").alias("file")))
        return rows.select(
            "seq", mint(("order", F.col("l_orderkey")), ("line", F.col("l_linenumber"))).alias("identity"), F.col("l_returnflag").alias("kind"),
            F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("part"), F.col("l_partkey").cast("string")).alias("properties"), evidence.alias("evidence"), (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"))


#: The same graph for DuckDB: named subqueries to put before a SELECT.
STAR_SQL = """
with recursive places as (select n_nationkey, r_name as app, n_name as repo from nation join region on n_regionkey = r_regionkey),
cust as (select c_custkey, app, repo, 'node://app:' || app || '/repo:' || repo || '/customer:' || c_custkey as identity, c_name, c_mktsegment, c_acctbal from customer join places on c_nationkey = n_nationkey),
supp as (select s_suppkey, app, repo, 'node://app:' || app || '/repo:' || repo || '/supplier:' || s_suppkey as identity, s_name from supplier join places on s_nationkey = n_nationkey),
ords as (select o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus, app, repo, cust.identity as customer_id, 'node://app:' || app || '/repo:' || repo || '/order:' || o_orderkey as identity from orders join cust on o_custkey = c_custkey),
parts as (select p_partkey, p_name, p_brand, p_type, 'node://app:CATALOG/part:' || p_partkey as identity from part),
nodes as (
  select 'node://app:' || r_name as identity, 'Application' as kind, [r_name] as props from region
  union all select 'node://app:' || app || '/repo:' || repo, 'Repository', [repo] from places
  union all select identity, 'Customer', [c_name, c_mktsegment] from cust
  union all select identity, 'Supplier', [s_name] from supp
  union all select identity, 'Order', [o_orderstatus] from ords
  union all select identity, 'Part', [p_name, p_brand, p_type] from parts),
tree as (
  select 'PART_OF' as type, 'node://app:' || app || '/repo:' || repo as from_id, 'node://app:' || app as to_id, n_nationkey::bigint as seq from places
  union all select 'LOCATED_IN', identity, 'node://app:' || app || '/repo:' || repo, c_custkey from cust
  union all select 'LOCATED_IN', identity, 'node://app:' || app || '/repo:' || repo, s_suppkey from supp
  union all select 'PLACED_BY', identity, customer_id, o_orderkey from ords),
edges as (
  select * from tree
  union all select distinct 'CONTAINS', identity, 'node://app:CATALOG/part:' || l_partkey, o_orderkey from lineitem join ords on l_orderkey = o_orderkey
  union all select distinct 'SUPPLIED_BY', ords.identity, supp.identity, o_orderkey from lineitem join ords on l_orderkey = o_orderkey join supp on l_suppkey = s_suppkey),
disc as (
  select row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as seq,
    'node://order:' || l_orderkey || '/line:' || l_linenumber as identity, l_returnflag as kind, l_linestatus, l_partkey, l_suppkey, 1.0::double - l_discount * 5 as confidence from lineitem)
"""
