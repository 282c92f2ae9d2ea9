"""Snapshots: latest, difference, grouping by owner, incremental carry-forward, composition."""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.identity import owning_app

EDGE_KEY = ["type", "from_id", "to_id"]


def latest(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("application").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys with ``change`` added or removed; properties do not count."""
    b, a = before.select(*key).distinct().withColumn("b_", F.lit(1)), after.select(*key).distinct().withColumn("a_", F.lit(1))
    both = b.join(a, key, "full_outer").where("a_ is null or b_ is null")
    return both.select(*key, F.when(F.col("b_").isNull(), "added").otherwise("removed").alias("change"))


def diff_by_owner(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of changes by owning application; an edge belongs to its source's owner, unowned changes are dropped."""
    owned = nodes.select(owning_app(F.col("identity")).alias("app"), F.lit("nodes").alias("item"), "change").unionByName(edges.select(owning_app(F.col("from_id")).alias("app"), F.lit("edges").alias("item"), "change"))
    n = lambda item, change: F.count_if((F.col("item") == item) & (F.col("change") == change)).alias(f"{item}_{change}")
    return owned.where("app is not null").groupBy("app").agg(n("nodes", "added"), n("nodes", "removed"), n("edges", "added"), n("edges", "removed"))


def cross_app(edges: DataFrame) -> DataFrame:
    return edges.where(~owning_app(F.col("from_id")).eqNullSafe(owning_app(F.col("to_id"))))


def basename(path):
    return F.lower(F.element_at(F.split(path, "[/\\\\]"), -1))


def invalidated(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts of which any evidence file (``files``) has the base name of a changed file, whatever its case."""
    names = changed.select(basename(F.col("file")).alias("name")).distinct()
    touched = facts.select("identity", F.explode("files").alias("file")).select("identity", basename(F.col("file")).alias("name")).join(names, "name", "left_semi").select("identity").distinct()
    return facts.join(touched, "identity", "left_semi")


def carry_nodes(previous: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """Previous nodes that are not stale, overwritten and joined by the fresh ones; ``origin`` says which."""
    kept = previous.join(stale.select("identity"), "identity", "left_anti").join(fresh.select("identity"), "identity", "left_anti")
    return kept.withColumn("origin", F.lit("carried")).unionByName(fresh.withColumn("origin", F.lit("fresh")))


def carry_edges(previous: DataFrame, stale: DataFrame, fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for edges, of which only those with both endpoints among ``nodes`` stay."""
    kept = previous.join(stale.select(*EDGE_KEY), EDGE_KEY, "left_anti").join(fresh.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    both = kept.withColumn("origin", F.lit("carried")).unionByName(fresh.withColumn("origin", F.lit("fresh")))
    ids = nodes.select("identity").distinct()
    return both.join(ids.withColumnRenamed("identity", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("identity", "to_id"), "to_id", "left_semi")


def composite(nodes: DataFrame, snapshots: DataFrame, children: list[str]) -> DataFrame:
    """The nodes of the children's latest snapshots, one row an identity."""
    chosen = latest(snapshots.where(F.col("application").isin(children)))
    rows = nodes.join(chosen, ["application", "snapshot_id"], "left_semi")
    return rows.groupBy("identity").agg(F.max_by(F.struct("kind", "application"), "application").alias("r")).select("identity", "r.kind", "r.application")


#: What a version's record tells of: kinds of changes, by what has changed.
LISTS = ("added_nodes", "removed_nodes", "added_edges", "removed_edges")


def change_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(app, list, label): what came and went by owner, a row each; an edge is its source's owner's, unowned changes are dropped."""
    edge = F.concat_ws(" ", "type", "from_id", F.lit("->"), "to_id")
    owned = nodes.select(owning_app(F.col("identity")).alias("app"), F.concat(F.col("change"), F.lit("_nodes")).alias("list"), F.col("identity").alias("label"))
    return owned.unionByName(edges.select(owning_app(F.col("from_id")).alias("app"), F.concat(F.col("change"), F.lit("_edges")).alias("list"), edge.alias("label"))).where("app is not null")


def _digested(batches):
    """The digest of each run of rows of one (app, list), labels joined by commas; a run may go on in the next batch."""
    key, sum_ = None, None
    for batch in batches:
        done = []
        for k, rows in itertools.groupby(zip(*[c.to_pylist() for c in batch.columns]), lambda r: r[:2]):
            text = ",".join(r[2] for r in rows).encode()
            if k == key:
                sum_.update(b",")
            else:
                if key is not None:
                    done.append((*key, sum_.hexdigest()))
                key, sum_ = k, hashlib.md5(usedforsecurity=False)
            sum_.update(text)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*done) if done else ([], [], []))], names=["app", "list", "digest"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*key, sum_.hexdigest())], names=["app", "list", "digest"])


def list_digests(labels: DataFrame) -> DataFrame:
    """(app, four digests): of each owner's lists of labels, sorted and joined by commas; empty for a list without labels.

    A list is sorted on disk and passes through one task, as its digest has to; no row and no task holds it.
    """
    ordered = labels.select("app", "list", "label").repartition("app", "list").sortWithinPartitions("app", "list", "label")
    each = ordered.mapInArrow(_digested, "app string, list string, digest string")
    return each.groupBy("app").agg(*[F.coalesce(F.max(F.when(F.col("list") == name, F.col("digest"))), F.lit("")).alias(name) for name in LISTS])


def changed_sets(repositories: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(repository) that are new in whole, and (name) of changed files, from (repository, commit, previous, files).

    Whole: all if forced, those without a previous commit, and those whose commit differs while the changed files are unknown (null).
    """
    moved = ~F.col("commit").eqNullSafe(F.col("previous"))
    whole = F.lit(True) if force else F.col("previous").isNull() | (moved & F.col("files").isNull())
    marked = repositories.withColumn("whole", whole).withColumn("moved", moved)
    names = marked.where(F.col("moved") & ~F.col("whole") & ~F.lit(force)).select(F.explode("files").alias("file")).select(basename(F.col("file")).alias("name")).distinct()
    return marked.where("whole").select("repository"), names


def own_facts(nodes: DataFrame, edges: DataFrame, application: str) -> tuple[DataFrame, DataFrame]:
    """The nodes that an application owns and the edges of which it owns both ends: what may be carried forward."""
    mine = lambda c: owning_app(F.col(c)).eqNullSafe(F.lit(application))
    return nodes.where(mine("identity")), edges.where(mine("from_id") & mine("to_id"))


def missing_children(snapshots: DataFrame, children: DataFrame) -> DataFrame:
    """(severity, message) of children(application) that have no snapshot."""
    gone = children.join(latest(snapshots).select("application"), "application", "left_anti")
    return gone.select(F.lit("Warning").alias("severity"), F.concat(F.lit("no snapshot of "), "application").alias("message"))


def publishes(diff_rows: DataFrame | None, force: bool = False) -> bool:
    """Whether a version is published: not if there is a difference to look at and it is empty, unless forced."""
    return force or diff_rows is None or not diff_rows.isEmpty()


def upserted(index: DataFrame, entries: DataFrame, key: str = "name") -> DataFrame:
    """An index with entries put in place of those of the same key, in order."""
    return index.join(entries.select(key), key, "left_anti").unionByName(entries).orderBy(key)


def version_change(application: str, version: int, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how much came and went, changes by owner if several own them, and edges between applications; what they are is in ``change_labels``."""
    across = ~owning_app(F.col("from_id")).eqNullSafe(owning_app(F.col("to_id")))
    rows = nodes.select(owning_app(F.col("identity")).alias("app"), F.concat(F.col("change"), F.lit("_nodes")).alias("list"), F.lit(False).alias("across"))
    rows = rows.unionByName(edges.select(owning_app(F.col("from_id")).alias("app"), F.concat(F.col("change"), F.lit("_edges")).alias("list"), across.alias("across")))
    each = rows.groupBy("app", "list").agg(F.count("*").alias("n"), F.count_if("across").alias("across"))  # a row for each list; the edges are compared once
    add = lambda name, what: F.coalesce(F.sum(F.when(F.col("list") == name, what)), F.lit(0)).cast("long")
    owned = F.when(F.col("app").isNotNull(), F.col("n"))
    total = each.agg(*[add(name, owned).alias(f"n_{name}") for name in LISTS], F.array_sort(F.collect_set("app")).alias("apps"), *[add(f"{change}_edges", F.col("across")).alias(f"{change}_integrations") for change in ("added", "removed")])
    composite_ = F.exists("apps", lambda a: a != application)
    return total.select(F.lit(application).alias("application"), F.lit(version).alias("version"), *[f"n_{name}" for name in LISTS], F.when(composite_, F.col("apps")).otherwise(F.array().cast("array<string>")).alias("impact"), "added_integrations", "removed_integrations")


SERIAL = "identity string, kind string, properties map<string,string>, confidence double"


def serialized(nodes: DataFrame) -> DataFrame:
    """(identity, json): each node as one JSON text."""
    return nodes.select("identity", F.to_json(F.struct("identity", "kind", "properties", "confidence")).alias("json"))


def deserialized(texts: DataFrame) -> DataFrame:
    """The nodes of (json) texts; what cannot be read gives no row."""
    read = texts.select(F.from_json("json", SERIAL).alias("n"))
    return read.select("n.*").where("identity is not null")
