"""Graph queries as frontier joins: bounded traversal, reverse closure, reachability, order and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.lineage import durable, few, stored


def node_lookup(nodes: DataFrame, identity: str) -> DataFrame:
    return nodes.where(F.col("identity") == identity).limit(1)


def out_edges(edges: DataFrame, identity: str) -> DataFrame:
    return edges.where(F.col("from_id") == identity)


def search(nodes: DataFrame, term: str) -> DataFrame:
    """Case-insensitive containment in the identity or any property value; an empty term finds everything."""
    t = F.upper(F.lit(term))
    return nodes.where(F.contains(F.upper("identity"), t) | F.exists(F.map_values("properties"), lambda v: F.contains(F.upper(v), t)))


#: Rounds after which a growing union is written anew.
COMPACT = 8


def _grown(seen: DataFrame, fresh: DataFrame, rounds: int) -> DataFrame:
    both = seen.unionByName(fresh)
    return durable(both) if rounds % COMPACT == 0 else both


def traverse(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """(node, via, depth, kind): each node once, by the first edge in list order that reaches it; the start is not reported.

    The edges are written once; each level scans them and meets its frontier, which is sent to all while it is small.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, None, 0, 0)], "node string, via string, depth int, place long")
    frontier = seen
    steps = stored(edges.select("from_id", "to_id", "seq", "type")) if depth > 1 else edges
    for level in range(1, depth + 1):
        met = steps.join(few(frontier.select(F.col("node").alias("from_id"), F.col("place").alias("from_place"))), "from_id")
        best = met.join(seen.select(F.col("node").alias("to_id")), "to_id", "left_anti").groupBy("to_id").agg(F.min(F.struct("from_place", "seq", "type")).alias("m"))
        fresh = durable(best.select(F.col("to_id").alias("node"), F.col("m.type").alias("via"), F.lit(level).alias("depth"), F.col("m.seq").alias("place")))
        if fresh.isEmpty():
            break
        seen, frontier = _grown(seen, fresh, level), fresh
    kinds = nodes.select(F.col("identity").alias("node"), "kind")
    found = seen.where("depth > 0")
    return kinds.join(few(found), "node", "right").select("node", "via", "depth", F.coalesce("kind", F.lit("?")).alias("kind"))


def impact(edges: DataFrame, target: str, max_levels: int | None = None) -> DataFrame:
    """(node, level): everything that reaches ``target``; the target itself only through a cycle."""
    spark = edges.sparkSession
    pairs = stored(edges.select("from_id", "to_id"))
    frontier = spark.createDataFrame([(target,)], "to_id string")
    seen, level = None, 0
    while max_levels is None or level < max_levels:
        level += 1
        fresh = pairs.join(few(frontier), "to_id").select(F.col("from_id").alias("node")).distinct()
        if seen is not None:
            fresh = fresh.join(seen.select("node"), "node", "left_anti")
        fresh = durable(fresh.withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            break
        seen = fresh if seen is None else _grown(seen, fresh, level)
        frontier = fresh.select(F.col("node").alias("to_id"))
    return seen if seen is not None else spark.createDataFrame([], "node string, level int")


def reach(edges: DataFrame, sources: DataFrame, types: list[str]) -> DataFrame:
    """(source, node): nodes reached from ``sources(source, node)`` over edges of the given types, the start included."""
    step = stored(edges.where(F.col("type").isin(types)).select(F.col("from_id").alias("node"), F.col("to_id").alias("next")))
    seen = frontier = durable(sources.select("source", "node").distinct())
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        fresh = step.join(few(frontier), "node").select("source", F.col("next").alias("node")).distinct()
        frontier = durable(fresh.join(seen, ["source", "node"], "left_anti"))
        seen = _grown(seen, frontier, rounds)
    return seen


def nearest_ancestor(children: DataFrame, parents: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): for children(node) the value of the nearest ancestor that has one, over parents(node, parent) and values(node, value).

    A child whose ancestors have no value has no row, also where they go round in a circle.
    """
    at = durable(children.select("node", F.col("node").alias("here")).distinct())
    been, found, rounds = at, None, 0
    step = stored(parents.select(F.col("node").alias("here"), "parent"))
    while not at.isEmpty():
        rounds += 1
        up = at.join(step, "here").select("node", F.col("parent").alias("here"))
        hit = durable(up.join(values.select(F.col("node").alias("here"), "value"), "here").select("node", "value"))
        found = hit if found is None else found.unionByName(hit)
        at = durable(up.join(hit.select("node"), "node", "left_anti").join(been, ["node", "here"], "left_anti").distinct())
        been = _grown(been, at, rounds)
    return found if found is not None else children.join(values, "node").select("node", "value").where("false")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) with every edge's (child, parent) child on a lower level; nodes on or above a cycle are left out."""
    todo, placed, level = durable(nodes.select("node").distinct()), None, 0
    while True:
        waits = edges.join(todo.select(F.col("node").alias("child")), "child").select(F.col("parent").alias("node"))
        ready = durable(todo.join(waits, "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        todo = durable(todo.join(ready, "node", "left_anti"))
        level += 1
    return placed if placed is not None else nodes.sparkSession.createDataFrame([], "node string, level int")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes on cycles of edges(child, parent) with the least node of their cycle's component.

    Nodes without a way in or out are peeled off. Every node then takes the least node that reaches
    it as its colour; what leads back to a colour's own node within the colour is one component and
    goes, and so do edges between colours. No more rows are made than there are edges.
    """
    pairs = stored(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).where("a is not null and b is not null").distinct())
    out = pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    while True:
        n = -1
        while n != (n := pairs.count()) and n:  # peel until nothing goes
            kept = pairs.join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            pairs = durable(kept.select("a", "b"))
        if not n:
            return out
        colour = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            sent = pairs.join(colour.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "c")
            after = durable(colour.unionByName(sent).groupBy("node").agg(F.min("c").alias("c")))
            still = after.join(colour, ["node", "c"], "left_anti").isEmpty()
            colour = after
            if still:
                break
        ends = pairs.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        inner = durable(ends.where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        back = frontier = durable(inner.where("b = c").select(F.col("a").alias("node"), "c").distinct())
        rounds = 0
        while not frontier.isEmpty():
            rounds += 1
            fresh = inner.join(frontier.select(F.col("node").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct()
            frontier = durable(fresh.join(back, ["node", "c"], "left_anti"))
            back = _grown(back, frontier, rounds)
        out = durable(out.unionByName(back.select("node", F.col("c").alias("root"))))
        pairs = durable(inner.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves."""
    return strong_components(edges).select("node").distinct()


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(root, path): a shortest cycle through the least node of each component, the least by name of those, closed with the node itself."""
    found = stored(strong_components(edges))
    inner = edges.select(F.col("child").alias("node"), F.col("parent").alias("next")).distinct()
    inner = inner.join(found, "node").join(found.select(F.col("node").alias("next"), F.col("root").alias("other")), "next").where("root = other").select("root", "node", "next")
    inner = durable(inner)
    frontier = durable(found.select("root").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path")))
    seen, out, rounds = frontier.select("root", "node"), None, 0
    while not frontier.isEmpty():
        rounds += 1
        step = frontier.join(inner, ["root", "node"]).select("root", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        step = durable(step.groupBy("root", "node").agg(F.min("path").alias("path")))
        closed = step.where("root = node").select("root", "path")
        out = closed if out is None else out.unionByName(closed)
        frontier = durable(step.join(closed.select("root"), "root", "left_anti").join(seen, ["root", "node"], "left_anti"))
        seen = _grown(seen, frontier.select("root", "node"), rounds)
    return (out if out is not None else frontier.select("root", "path")).select("root", F.array_join("path", " -> ").alias("path"))


def inherited(types: DataFrame, most: int = 64) -> DataFrame:
    """(node, value): of ``types(node, parent, value)`` each node's own value, or that of the nearest base type that has one.

    Every round doubles how far a node has looked, so rounds grow with the logarithm of the longest
    chain; a chain that goes round in a circle ends after ``most`` rounds with what it met.
    """
    own = durable(types.select("node", F.when(F.col("value").isNull(), F.col("parent")).alias("next"), "value"))
    for _ in range(most):
        if own.where("next is not null").isEmpty():
            break
        up = own.select(F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("value").alias("theirs"))
        open_, done = own.where("next is not null").join(up, "next", "left"), own.where("next is null")
        step = open_.select("node", F.when(F.col("theirs").isNull(), F.col("beyond")).alias("next"), F.col("theirs").alias("value"))
        own = durable(done.unionByName(step))
    return own.where("value is not null").select("node", "value")


def authorization(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(method, access) of ``methods(method, node, attributes)`` with ``types(node, parent, attributes)``: what decides who may call a method.

    Its own attributes come first, then its class's, then those of the nearest base that has any;
    where both stand side by side AllowAnonymous outweighs Authorize. Null: nothing is said.
    """
    said = lambda: F.when(F.col("attributes").contains("AllowAnonymous"), "anonymous").when(F.col("attributes").contains("Authorize"), F.regexp_extract("attributes", r"Authorize(?:\([^)]*\))?", 0))
    of_type = inherited(types.select("node", "parent", said().alias("value"))).withColumnRenamed("value", "theirs")
    return methods.select("method", "node", said().alias("own")).join(of_type, "node", "left").select("method", F.coalesce("own", "theirs").alias("access"))
