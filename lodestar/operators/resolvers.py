"""The resolvers' registry: rules that add edges to a snapshot, repeated until they add none.

A resolver says which types of edges it reads and which it writes. One that reads none runs once. The
others run in rounds, each only on the edges that the round before added (``new``), beside all there
are (``edges``); what is there already is not added again. The result is the least set of edges that
no resolver adds to, so the order in which they are registered does not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import resolve
from lodestar.operators.facts import prop
from lodestar.operators.merge import first_by
from lodestar.operators.snapshots import EDGE_KEY
from lodestar.plans.lineage import stored

COLUMNS = ["type", "from_id", "to_id", "confidence"]
#: More rounds than this mean that a resolver makes up new ends for ever.
ROUNDS = 32


@dataclass(frozen=True)
class Resolver:
    """(nodes, edges, new) -> (from_id, to_id, confidence) of the type that it writes."""

    name: str
    run: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
    writes: str
    reads: tuple[str, ...] = ()


def _calls(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'ApiCall'").select(F.col("identity").alias("call_id"), prop("ApiCall", "verb").alias("verb"), prop("ApiCall", "route").alias("url"))


def _endpoints(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Endpoint'").select(F.col("identity").alias("endpoint_id"), prop("Endpoint", "verb").alias("verb"), prop("Endpoint", "route").alias("route"), "seq")


def routes(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """MAPS_TO from calls to the endpoints that answer them."""
    return resolve.route_matches(_calls(nodes), _endpoints(nodes)).select(F.col("call_id").alias("from_id"), F.col("endpoint_id").alias("to_id"), "confidence")


def audits(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """AUDITS from audit logs to the entities that they name."""
    logs = nodes.where("kind = 'AuditLog'").select(F.col("identity").alias("id"), prop("AuditLog", "entity").alias("name"))
    entities = nodes.where("kind = 'Entity'").select(F.col("identity").alias("id"), F.col("properties")["name"].alias("name"), "seq")
    return resolve.name_match(logs, entities).select(F.col("left_id").alias("from_id"), F.col("right_id").alias("to_id"), F.lit(0.7).alias("confidence"))


def _homes(nodes: DataFrame) -> DataFrame:
    """(identity, repository, path): where the first evidence of each node is."""
    first = F.get("evidence", F.lit(0))
    return nodes.select("identity", first["repository"].alias("repository"), F.concat(first["repository"], F.lit("/"), first["file"]).alias("path"))


def repositories(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """DEPENDS_ON from the repository of a call to that of the endpoint whose route it has exactly."""
    homes = _homes(nodes)
    exact = new.where((F.col("type") == "MAPS_TO") & (F.col("confidence") >= resolve.EXACT)).select("from_id", "to_id")
    met = exact.join(homes.select(F.col("identity").alias("from_id"), F.col("repository").alias("caller")), "from_id").join(homes.select(F.col("identity").alias("to_id"), F.col("repository").alias("server")), "to_id")
    known = nodes.where("kind = 'SourceRepository'").select("identity", F.col("properties")["name"].alias("name"))
    pairs = met.where("caller <> server").select("caller", "server").distinct()
    ends = pairs.join(known.select(F.col("name").alias("caller"), F.col("identity").alias("from_id")), "caller").join(known.select(F.col("name").alias("server"), F.col("identity").alias("to_id")), "server")
    return ends.select("from_id", "to_id", F.lit(0.85).alias("confidence"))


def uses(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """USES from the services of a project to the data stores of the same project, the nearest project file above each."""
    homes = _homes(nodes.where("kind in ('Service', 'DataStore', 'Project')")).join(nodes.select("identity", "kind"), "identity")
    projects = homes.where(F.col("kind") == "Project").select("path").distinct()
    placed = homes.where("kind <> 'Project'").join(resolve.closest_ancestor(homes.where("kind <> 'Project'").select("path").distinct(), projects), "path").where("project is not null")
    service, store = placed.where("kind = 'Service'").select(F.col("identity").alias("from_id"), "project"), placed.where("kind = 'DataStore'").select(F.col("identity").alias("to_id"), "project")
    return service.join(store, "project").select("from_id", "to_id", F.lit(0.7).alias("confidence")).distinct()


def subscribers(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """PUBLISHES from who publishes a message to who consumes it."""
    def pairs(published: DataFrame, consumed: DataFrame) -> DataFrame:
        out, taken = published.where("type = 'PUBLISHES'").select("from_id", F.col("to_id").alias("message")), consumed.where("type = 'CONSUMES'").select(F.col("from_id").alias("to_id"), F.col("to_id").alias("message"))
        return out.join(taken, "message").select("from_id", "to_id")

    both = pairs(new, edges).unionByName(pairs(edges, new)).distinct()
    return both.where("from_id <> to_id").withColumn("confidence", F.lit(0.8))


REGISTRY: tuple[Resolver, ...] = (
    Resolver("routes", routes, "MAPS_TO"), Resolver("uses", uses, "USES"), Resolver("audits", audits, "AUDITS"),
    Resolver("repositories", repositories, "DEPENDS_ON", ("MAPS_TO",)), Resolver("subscribers", subscribers, "PUBLISHES", ("PUBLISHES", "CONSUMES")))


def resolved(nodes: DataFrame, edges: DataFrame, registry: tuple[Resolver, ...] = REGISTRY) -> DataFrame:
    """(type, from_id, to_id, confidence): the edges that resolvers add to ``edges``, each once, as the first round that has it says."""
    keyed = edges.select(*COLUMNS)
    added, new, all_edges = None, keyed, keyed
    for turn in range(ROUNDS):
        parts = []
        for r in registry:
            if turn == 0 and not r.reads:
                parts.append(r.run(nodes, keyed, new).withColumn("type", F.lit(r.writes)))
            elif r.reads:
                parts.append(r.run(nodes, all_edges, new.where(F.col("type").isin(*r.reads))).withColumn("type", F.lit(r.writes)))
        if not parts:
            break
        out = parts[0].select(*COLUMNS)
        for p in parts[1:]:
            out = out.unionByName(p.select(*COLUMNS))
        new = stored(first_by(out.join(all_edges, EDGE_KEY, "left_anti"), EDGE_KEY, ["confidence"]).select(*COLUMNS))
        if new.isEmpty():
            break
        added = new if added is None else added.unionByName(new)
        all_edges = all_edges.unionByName(new)
    else:
        raise RuntimeError(f"resolvers still add edges after {ROUNDS} rounds")
    return added if added is not None else keyed.limit(0)
