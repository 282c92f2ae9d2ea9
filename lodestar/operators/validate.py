"""The validation gate: endpoint classes, external nodes, invariants, unregistered kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.lineage import durable

NEVER = (1 << 62)


def endpoint_classes(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Each edge with ``class``: both, one or neither of its endpoints in ``known(identity)``."""
    ids = known.select("identity").distinct()
    met = edges.join(ids.select(F.col("identity").alias("from_id"), F.lit(1).alias("f")), "from_id", "left").join(ids.select(F.col("identity").alias("to_id"), F.lit(1).alias("t")), "to_id", "left")
    n = F.coalesce("f", F.lit(0)) + F.coalesce("t", F.lit(0))
    return met.withColumn("class", F.when(n == 2, "both").when(n == 1, "one").otherwise("neither")).drop("f", "t")


def accepted(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Each edge with ``accepted``, as if taken in seq order with every accepted edge making its endpoints known.

    A fixpoint of known_at(node) = the least seq of an accepted incident edge (known nodes: -1); an
    edge is accepted when an endpoint is known before it. Each round is two joins and a minimum.
    """
    ends = edges.where("from_id <> to_id").select("seq", "from_id", "to_id")
    at = durable(known.select(F.col("identity").alias("node"), F.lit(-1).cast("long").alias("known_at")).distinct())
    while True:
        f, t = at.select(F.col("node").alias("from_id"), F.col("known_at").alias("f")), at.select(F.col("node").alias("to_id"), F.col("known_at").alias("t"))
        ok = ends.join(f, "from_id", "left").join(t, "to_id", "left").where(F.least(F.coalesce("f", F.lit(NEVER)), F.coalesce("t", F.lit(NEVER))) < F.col("seq"))
        new = ok.select(F.explode(F.array("from_id", "to_id")).alias("node"), "seq").groupBy("node").agg(F.min("seq").alias("known_at"))
        after = durable(at.unionByName(new.select("node", "known_at")).groupBy("node").agg(F.min("known_at").alias("known_at")))
        same = after.count() == at.count() and after.join(at, ["node", "known_at"], "left_anti").isEmpty()
        at = after
        if same:
            break
    f, t = at.select(F.col("node").alias("from_id"), F.col("known_at").alias("f")), at.select(F.col("node").alias("to_id"), F.col("known_at").alias("t"))
    least = F.least(F.coalesce("f", F.lit(NEVER)), F.coalesce("t", F.lit(NEVER)))
    return edges.join(f, "from_id", "left").join(t, "to_id", "left").withColumn("accepted", (F.col("from_id") != F.col("to_id")) & (least < F.col("seq"))).drop("f", "t")


def external_nodes(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(identity, confidence): the unknown endpoints of accepted edges, as the first edge that names them has it."""
    taken = accepted(edges, known).where("accepted")
    named = taken.select(F.explode(F.array("from_id", "to_id")).alias("identity"), "seq", "confidence")
    unknown = named.join(known.select("identity"), "identity", "left_anti")
    return unknown.groupBy("identity").agg(F.min_by("confidence", "seq").alias("confidence"))


def unregistered(nodes: DataFrame, registered: DataFrame) -> DataFrame:
    return nodes.join(registered.select("kind"), "kind", "left_anti")


#: What a kind or relation type may look like.
NAME_FORM = r"^\s*[^/\s][^/]*$"


def invariants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, violations) of a snapshot; all zero for a sound one. Nodes and edges are read once and meet once, by identity."""
    evidence = [F.count_if(F.col("evidence").isNull() | (F.size("evidence") == 0)).alias("no_evidence")] if "evidence" in nodes.columns else [F.lit(0).cast("long").alias("no_evidence")]
    own = nodes.groupBy("identity").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("bad_confidence"),
        F.count_if(~F.coalesce(F.col("kind").rlike(NAME_FORM), F.lit(False))).alias("bad_kind"), *evidence)
    ends = edges.select(F.explode(F.array(*[F.struct(F.col(end).alias("identity"), F.lit(end).alias("end"), (F.col("from_id") == F.col("to_id")).alias("self"), (~F.coalesce(F.col("type").rlike(NAME_FORM), F.lit(False)) if "type" in edges.columns else F.lit(False)).alias("form")) for end in ("from_id", "to_id")])).alias("x")).select("x.*")
    at_from = F.col("end") == "from_id"
    met = ends.groupBy("identity").agg(F.count_if(at_from).alias("from_n"), F.count_if(~at_from).alias("to_n"), F.count_if(at_from & F.col("self")).alias("self_n"), F.count_if(at_from & F.col("form")).alias("form_n"))
    both = own.join(met, own.identity.eqNullSafe(met.identity), "full_outer")
    unknown = F.col("n").isNull()
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    total = both.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_identity"), add(F.when(unknown, F.col("from_n"))).alias("dangling_from"), add(F.when(unknown, F.col("to_n"))).alias("dangling_to"), add("self_n").alias("self_edge"),
        add("bad_confidence").alias("bad_confidence"), add("bad_kind").alias("bad_kind"), add("form_n").alias("bad_type"), add("no_evidence").alias("no_evidence"))
    return total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in total.columns])).alias("r")).select("r.*")


def rejected(found: DataFrame) -> DataFrame:
    """Discoveries that no snapshot takes, with the first ``reason``: without evidence, with a bad confidence, with a bad kind."""
    reason = (F.when(F.col("evidence").isNull() | (F.size("evidence") == 0), "no evidence").when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence")
              .when(~F.coalesce(F.col("kind").rlike(NAME_FORM), F.lit(False)), "kind"))
    return found.withColumn("reason", reason).where("reason is not null")


def registry(*declared: DataFrame) -> DataFrame:
    """(kind, namespace) of several registries in order, each kind once as it was first declared."""
    out = None
    for i, one in enumerate(declared):
        rows = one.select("kind", "namespace", F.lit(i).alias("registry"), "seq")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind").agg(F.min(F.struct("registry", "seq", "namespace")).alias("r")).select("kind", "r.namespace")
