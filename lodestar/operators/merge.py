"""Merging discoveries into canonical nodes and edges.

``seq`` is the emission order and decides every tie. All steps are partial aggregations by the
identity; nothing depends on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noisy_or(confidence: Column) -> Column:
    """1 - prod(1 - c) with c clamped to [0, 1] (no logarithms: a certain member stays certain)."""
    return F.lit(1.0) - F.product(F.lit(1.0) - F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))


def merged_confidence(found: DataFrame, key: str = "identity") -> DataFrame:
    return found.groupBy(key).agg(noisy_or(F.col("confidence")).alias("confidence"))


def merged_kind(found: DataFrame, key: str = "identity") -> DataFrame:
    """The kind of the most confident member, the first emitted on ties."""
    return found.groupBy(key).agg(F.max_by("kind", F.struct(F.col("confidence"), -F.col("seq"))).alias("kind"))


def alternate_kinds(found: DataFrame, key: str = "identity") -> DataFrame:
    """The losing kinds, comma-joined in the order first seen; only identities that have any."""
    firsts = found.groupBy(key, "kind").agg(F.min("seq").alias("seq"), F.max(F.struct(F.col("confidence"), -F.col("seq"))).alias("best"))
    grouped = firsts.groupBy(key).agg(F.max_by("kind", "best").alias("won"), F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("kinds"))
    lost = F.filter(F.transform("kinds", lambda k: k["kind"]), lambda k: k != F.col("won"))
    return grouped.where(F.size("kinds") > 1).select(key, F.array_join(lost, ",").alias("alternate_kinds"))


def merged_properties(found: DataFrame, key: str = "identity") -> DataFrame:
    """(key, property, value): of each property the most confident member's value, the last emitted on ties."""
    rows = found.select(key, "seq", "confidence", F.explode("properties").alias("property", "value"))
    return rows.groupBy(key, "property").agg(F.max_by("value", F.struct("confidence", "seq")).alias("value"))


def merged_evidence(found: DataFrame, key: str = "identity") -> DataFrame:
    """All evidence in emission order, duplicates kept."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "evidence")))
    return found.groupBy(key).agg(F.flatten(F.transform(ordered, lambda x: x["evidence"])).alias("evidence"))


def canonical_nodes(found: DataFrame) -> DataFrame:
    """One row an identity: kind, merged properties, evidence and confidence, and the least seq."""
    base = found.groupBy("identity").agg(
        F.min("seq").alias("seq"), noisy_or(F.col("confidence")).alias("confidence"),
        F.max_by("kind", F.struct(F.col("confidence"), -F.col("seq"))).alias("kind"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])).alias("evidence"))
    said = merged_properties(found).groupBy("identity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("properties"))
    others = alternate_kinds(found)
    joined = base.join(said, "identity", "left").join(others, "identity", "left")
    extra = F.when(F.col("alternate_kinds").isNotNull(), F.create_map(F.lit("AlternateKinds"), F.col("alternate_kinds")))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return joined.select("seq", "identity", "kind", F.map_concat(F.coalesce("properties", none), F.coalesce(extra, none)).alias("properties"), "evidence", "confidence")


def merged_edges(found: DataFrame) -> DataFrame:
    """One row for each (type, from_id, to_id) with all evidence in emission order, self-edges dropped."""
    evidence = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])).alias("evidence")] if "evidence" in found.columns else []
    return found.where("from_id <> to_id").groupBy("type", "from_id", "to_id").agg(
        F.min("seq").alias("seq"), noisy_or(F.col("confidence")).alias("confidence"), F.count("*").alias("members"), *evidence)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (never dropDuplicates, which keeps any row)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def by_specificity(nodes: DataFrame) -> DataFrame:
    """The nodes in order: identities of more segments first, then longer ones, then as emitted."""
    from lodestar.functions.identity import segments

    ordered = nodes.withColumn("depth_", F.size(segments(F.col("identity")))).withColumn("length_", F.length("identity"))
    return ordered.orderBy(F.desc("depth_"), F.desc("length_"), "seq").drop("depth_", "length_")
