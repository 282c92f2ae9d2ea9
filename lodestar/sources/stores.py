"""Durable tables below one folder: rows that are appended, and attempts that a claim makes visible.

What a run writes goes to a folder of its own; a claim, a small file that is created only if it is not
there, names that folder. Whoever claims first is read, so a retry or a rival that writes the same
snapshot again changes nothing, and what a failed attempt left is never read.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.lineage import empty

EVIDENCE = "array<struct<repository:string,commit:string,engine:string,method:string,confidence:double,file:string,line:int,symbol:string>>"
NODES = f"seq long, identity string, kind string, properties map<string,string>, evidence {EVIDENCE}, confidence double"
EDGES = f"type string, from_id string, to_id string, seq long, confidence double, evidence {EVIDENCE}"
SNAPSHOTS = "application string, snapshot_id string, created_at timestamp, attempt string"
PAGES = "path string, part int, content string, content_type string, version int"
#: So long a run that says nothing keeps others of its application out.
LEASE_SECONDS = 6 * 3600


def _safe(name: str) -> str:
    """A name as a file's name: other characters than letters, digits, dash and underscore as their codes."""
    return re.sub(r"[^A-Za-z0-9_-]", lambda m: f"~{ord(m[0]):x}~", name)


class Store:
    """Tables and claims below one folder; nothing is ever updated in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files and claims

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def claim(self, path: str, **said) -> bool:
        """Create a small file unless it is there; whether this call did. Of two at the same time one does."""
        fs, p = self._fs(f"claims/{path}.json")
        try:
            out = fs.create(p, False)
        except Exception:  # noqa: BLE001  the file systems have different errors for it
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return True

    def claimed(self, path: str) -> dict | None:
        """What a claim says, if there is one."""
        fs, p = self._fs(f"claims/{path}.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "{}")
        finally:
            stream.close()

    def release(self, path: str) -> None:
        self.delete(f"claims/{path}.json")

    # ---- tables

    def append(self, table: str, rows: DataFrame, *partition: str) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(*partition) if partition else writer).parquet(f"{self.root}/{table}")

    def has(self, table: str) -> bool:
        return self.exists(table)

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """A table's rows; without rows an empty one, if the schema is known."""
        if schema is not None:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}") if self.has(table) else empty(self.spark, schema)
        return self.spark.read.parquet(f"{self.root}/{table}")

    # ---- snapshots

    def commit_snapshot(self, application: str, snapshot_id: str, created_at: str, nodes: DataFrame, edges: DataFrame) -> bool:
        """Writes a snapshot that keeps the invariants, unless one of this id is there; whether it did."""
        from lodestar.operators.validate import invariants

        name = f"snapshots/{_safe(application)}/{_safe(snapshot_id)}"
        if self.claimed(name) is not None:
            return False
        bare = nodes.drop("evidence")  # an external node has its edge's, a resolved edge none
        broken = [r["rule"] for r in invariants(bare, edges).where("violations > 0").collect()]
        if broken:
            raise ValueError(f"snapshot breaks {', '.join(broken)}")
        attempt = uuid.uuid4().hex
        nodes.write.parquet(f"{self.root}/attempts/{attempt}/nodes")
        edges.write.parquet(f"{self.root}/attempts/{attempt}/edges")
        won = self.claim(name, application=application, snapshot_id=snapshot_id, created_at=created_at, attempt=attempt)
        if not won:
            self.delete(f"attempts/{attempt}")
        return won

    def snapshots(self, application: str | None = None) -> DataFrame:
        """(application, snapshot_id, created_at, attempt) of all snapshots, or of one application's."""
        at = "claims/snapshots/" + (f"{_safe(application)}" if application is not None else "*")
        if not self.exists(at if application is not None else "claims/snapshots"):
            return empty(self.spark, SNAPSHOTS)
        return self.spark.read.schema(SNAPSHOTS).json(f"{self.root}/{at}/*.json")

    def snapshot(self, application: str) -> str | None:
        """The id of the application's latest snapshot, if it has any."""
        last = self.snapshots(application).agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id"))).first()
        return last[0]

    def read_snapshot(self, table: str, application: str, snapshot_id: str) -> DataFrame:
        """The rows of one snapshot; nothing else is read."""
        said = self.claimed(f"snapshots/{_safe(application)}/{_safe(snapshot_id)}")
        if said is None:
            raise KeyError(f"no snapshot {snapshot_id} of {application}")
        return self.spark.read.schema(NODES if table == "nodes" else EDGES).parquet(f"{self.root}/attempts/{said['attempt']}/{table}")

    def latest(self, table: str, application: str) -> DataFrame:
        """The rows of the application's latest snapshot."""
        return self.read_snapshot(table, application, self.snapshot(application))

    def vacuum(self) -> int:
        """Delete the attempts that no claim names; how many. Not while a run is under way."""
        fs, p = self._fs("attempts")
        if not fs.exists(p):
            return 0
        named = {r["attempt"] for r in self.snapshots().select("attempt").collect()}  # a row a snapshot
        gone = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName() not in named]
        for name in gone:
            self.delete(f"attempts/{name}")
        return len(gone)

    # ---- runs

    def begin(self, application: str, run: str, now: float | None = None, lease: float = LEASE_SECONDS) -> bool:
        """Take an application for one run; False while another has it. A run that has not ended within the lease has it no more."""
        name, now = f"running/{_safe(application)}", time.time() if now is None else now
        if self.claim(name, run=run, since=now):
            return True
        held = self.claimed(name)
        if held is not None and held.get("run") != run and now - float(held.get("since") or 0) <= lease:
            return False
        self.release(name)
        return self.claim(name, run=run, since=now)

    def end(self, application: str) -> None:
        self.release(f"running/{_safe(application)}")

    def last_version(self, application: str) -> int:
        """The number of the last published version, 0 before the first."""
        rows = self.read("versions", "application string, version int, created_at timestamp, pages long")
        return rows.where(F.col("application") == application).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def empty_nodes(self) -> DataFrame:
        return empty(self.spark, NODES)

    def empty_edges(self) -> DataFrame:
        return empty(self.spark, EDGES)


def safe_path(path: Column) -> Column:
    """Forward slashes only; a path with a . or .. step is an error."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(clean.rlike(r"(^|/)\.\.?(/|$)"), F.raise_error(F.concat(F.lit("bad path "), path))).otherwise(clean)


class Pages:
    """Documents by (application, path), in parts. Every version holds all pages that readers see, so old ones are never read."""

    def __init__(self, store: Store):
        self.store = store

    def _folder(self, application: str, version: int) -> str:
        return f"pages/{_safe(application)}/{version:08d}"

    def _current(self, application: str) -> int | None:
        """The version that is claimed last, if it is not a cleared one."""
        fs, p = self.store._fs(f"claims/pages/{_safe(application)}")
        if not fs.exists(p):
            return None
        names = sorted(s.getPath().getName().removesuffix(".json") for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        last = int(names[-1])
        return None if (self.store.claimed(f"pages/{_safe(application)}/{names[-1]}") or {}).get("cleared") else last

    def write(self, application: str, pages: DataFrame, version: int) -> bool:
        """Put ``pages(path, part, content, content_type)`` in place of those of the same paths; whether this call made the version."""
        fresh = pages.select(safe_path(F.col("path")).alias("path"), F.col("part").cast("int").alias("part"), "content", "content_type", F.lit(version).alias("version"))
        kept = self._parts(application).join(fresh.select("path").distinct(), "path", "left_anti")
        attempt = f"{self._folder(application, version)}-{uuid.uuid4().hex}"
        kept.unionByName(fresh).write.partitionBy("version").parquet(f"{self.store.root}/{attempt}")
        won = self.store.claim(f"pages/{_safe(application)}/{version:08d}", folder=attempt)
        if not won:
            self.store.delete(attempt)
        return won

    def clear(self, application: str, version: int) -> bool:
        """Make all pages go with this version."""
        return self.store.claim(f"pages/{_safe(application)}/{version:08d}", cleared=True)

    def _parts(self, application: str) -> DataFrame:
        last = self._current(application)
        if last is None:
            return empty(self.store.spark, PAGES)
        folder = self.store.claimed(f"pages/{_safe(application)}/{last:08d}")["folder"]
        return self.store.spark.read.schema(PAGES).parquet(f"{self.store.root}/{folder}").select("path", "part", "content", "content_type", "version")

    def list(self, application: str) -> DataFrame:
        """(path, version) of the pages that readers see, and the version that each is from."""
        return self._parts(application).select("path", "version").distinct()

    def read(self, application: str) -> DataFrame:
        """(path, part, content, content_type, version): the pages' parts, to be read in order."""
        return self._parts(application)

    def whole(self, application: str, path: str) -> str | None:
        """The text of one page."""
        parts = self._parts(application).where(F.col("path") == path).orderBy("part").select("content").collect()
        return "\n".join(r["content"] for r in parts) if parts else None
