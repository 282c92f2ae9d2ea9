"""Resolvers: joins that add inferred edges between discovered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import normalize_route
from lodestar.operators.merge import first_by
from lodestar.plans.lineage import few, stored

EXACT, SUFFIX = 0.9, 0.75


def route_matches(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call_id, endpoint_id, confidence) from calls(call_id, verb, url) and endpoints(endpoint_id, verb, route, seq).

    First the endpoint of the same verb whose normalised route is equal, the earliest by seq; else
    the only one whose route ends with the call's. Suffixes are joined by equality: every endpoint
    route gives its suffixes that begin at a slash, which are all that can match.
    """
    c = calls.select("call_id", F.upper("verb").alias("verb"), normalize_route(F.col("url")).alias("norm"))
    e = endpoints.select("endpoint_id", F.upper("verb").alias("verb"), normalize_route(F.col("route")).alias("norm"), "seq")
    exact = first_by(c.join(e, ["verb", "norm"]).select("call_id", "seq", "endpoint_id"), ["call_id"], ["seq"]).select("call_id", "endpoint_id", F.lit(EXACT).alias("confidence"))
    rest = c.join(exact, "call_id", "left_anti").where(F.length("norm") > 1)
    parts = F.split(F.substring("norm", 2, 1 << 20), "/")
    tails = e.select("endpoint_id", "verb", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))).alias("norm")).distinct()
    near = rest.join(tails, ["verb", "norm"]).groupBy("call_id").agg(F.count("*").alias("n"), F.min("endpoint_id").alias("endpoint_id")).where("n = 1")
    return exact.unionByName(near.select("call_id", "endpoint_id", F.lit(SUFFIX).alias("confidence")))


#: Rows of either side of a value that are paired together.
SIDE = 2_000


def equal_property(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All (left_id, right_id) that agree in ``key``; null never matches.

    A value gives the product of its rows on both sides. Where that is large, either side is cut into
    parts of about SIDE rows and each part of one meets each of the other, so no task has a whole value.
    """
    l, r = left.select(F.col("id").alias("left_id"), key), right.select(F.col("id").alias("right_id"), key)
    parts = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count("*") / SIDE).cast("int").alias(name))
    hot = stored(parts(l, "left_parts").join(parts(r, "right_parts"), key).where("left_parts > 1 or right_parts > 1"))
    if hot.isEmpty():
        return l.join(r, key).select("left_id", "right_id", key)
    hot = few(hot)
    dealt = lambda rows, own, other: rows.join(hot, key, "left").withColumn(own, F.pmod(F.xxhash64(rows.columns[0]), F.coalesce(own, F.lit(1)))).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
    l, r = dealt(l, "left_parts", "right_parts"), dealt(r, "right_parts", "left_parts").withColumn("left_parts", F.col("left_parts").cast("long"))
    l, on = l.withColumn("right_parts", F.col("right_parts").cast("long")), [key, "left_parts", "right_parts"]
    tasks = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes give many pairs: not to be put together again
    return l.repartition(tasks, *on).hint("merge").join(r.repartition(tasks, *on), on).select("left_id", "right_id", key)


def name_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): the first right row whose name is equal whatever its case."""
    l, r = left.select(F.col("id").alias("left_id"), F.upper("name").alias("n")), right.select(F.col("id").alias("right_id"), F.upper("name").alias("n"), "seq")
    return first_by(l.join(r, "n").select("left_id", "seq", "right_id"), ["left_id"], ["seq"]).select("left_id", "right_id")


def cross_repository(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Distinct (caller_repo, server_repo) of exact route matches across repositories."""
    c = calls.select("call_id", "repo", F.upper("verb").alias("verb"), normalize_route(F.col("url")).alias("norm"))
    e = endpoints.select("seq", F.col("repo").alias("server_repo"), F.upper("verb").alias("verb"), normalize_route(F.col("route")).alias("norm"))
    hit = first_by(c.join(e, ["verb", "norm"]).select("call_id", "repo", "seq", "server_repo"), ["call_id"], ["seq"])
    return hit.where("repo <> server_repo").select(F.col("repo").alias("caller_repo"), "server_repo").distinct()


def _piece(column: str, size: int):
    return lambda at: F.substring(F.col(column), at, F.lit(size))


def capability(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, category): the first rule (rule, fragment, category) whose fragment the name contains, whatever its case.

    A fragment is sought by its first three characters, or all if it has fewer: names are joined by
    equality with those, and only what meets is compared in full, however many rules there are.
    """
    each = names.select("name").where("name is not null").distinct().withColumn("upper_", F.upper("name"))
    size = F.length("upper_")
    pieces = [F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), _piece("upper_", n)) for n in (1, 2, 3)]
    keyed = each.select("name", "upper_", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *pieces))).alias("key_"))
    sought = rules.withColumn("fragment_", F.upper("fragment")).withColumn("key_", F.substring("fragment_", 1, 3))
    met = keyed.join(sought, "key_").where(F.contains("upper_", "fragment_"))
    return met.groupBy("name").agg(F.min_by("category", "rule").alias("category"))


def closest_ancestor(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project): the project file in the nearest directory above each file, null without one."""
    parts = F.split("path", "/")
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))).alias("u")).select("path", "u.depth", "u.dir")
    homes = projects.select(F.col("path").alias("project"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    found = up.join(homes, "dir").groupBy("path").agg(F.max_by("project", F.struct("depth", "project")).alias("project"))
    return files.select("path").join(found, "path", "left")


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def closest_solution(projects: DataFrame, solutions: DataFrame, most: int = 5) -> DataFrame:
    """(path, solution): the solution file nearest above each project, at most ``most`` levels up; of one level a .sln before a .slnx."""
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    up = projects.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(most - 1))), lambda n: F.struct(n.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "/").alias("dir")))).alias("u")).select("path", "u.up", "u.dir")
    homes = solutions.select(F.col("path").alias("solution"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    found = up.join(homes, "dir").groupBy("path").agg(F.min(F.struct("up", F.col("solution").endswith(".slnx").alias("x"), "solution"))["solution"].alias("solution"))
    return projects.select("path").join(found, "path", "left")


def landing(applications: DataFrame) -> DataFrame:
    """The applications that are no other's children."""
    children = applications.select(F.explode("children").alias("name"))
    return applications.join(children, "name", "left_anti")


def zipped(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(key columns, at, left, right): two arrays by place, as far as the shorter goes."""
    n = F.least(F.size(left), F.size(right))
    both = F.arrays_zip(F.slice(left, F.lit(1), n).alias("l"), F.slice(right, F.lit(1), n).alias("r"))
    rest = [c for c in rows.columns if c not in (left, right)]
    return rows.select(*rest, F.posexplode(both).alias("at", "z")).select(*rest, "at", F.col("z.l").alias(left), F.col("z.r").alias(right))


def tokens_of(locations: DataFrame, credentials: DataFrame) -> DataFrame:
    """(location, token): the token of a location's host, null for unknown hosts and what is no address."""
    host = F.lower(F.nullif(F.regexp_extract("location", r"^(?:[a-z][a-z0-9+.-]*)://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    met = locations.withColumn("host", host).join(credentials.select(F.lower("host").alias("host"), "token"), "host", "left")
    return met.select("location", "token")
