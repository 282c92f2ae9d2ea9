"""A run of the engine: from the files of an application's repositories to a committed snapshot and its pages.

    files -> scan -> extract -> discoveries -> reject, merge, validate -> resolve -> children -> commit -> difference -> pages

What a file says is kept by what it follows from: the file's path and text, and what the types that it
names declare (``scope``). A run scans only files that no run has seen, and extracts only from files
whose text or scope is new; all the rest is read from the store. Whatever has changed, the result is
that of a run over everything, and an unchanged tree runs no extractor.

An extractor that fails, a technology without one and a run that finds nothing are diagnostics, and
the run goes on. One run at a time has an application.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.identity import encode
from lodestar.operators import dotnet, extract, lexing, merge, reports, resolvers, validate
from lodestar.operators import snapshots as S
from lodestar.operators.facts import SCHEMA, Extractor, Sources, union
from lodestar.plans.lineage import durable, empty, stored
from lodestar.sources.repositories import artifacts, notes
from lodestar.sources.stores import EVIDENCE, Pages, Store

#: Kinds that are one node for all repositories of an application.
SHARED = ("Endpoint", "Technology", "Cache", "AuthScheme", "Cors", "Authorization", "HealthCheck", "Logging", "Messaging", "BackgroundJob", "Middleware", "Resilience", "MessageBroker", "DataAccess", "Configuration", "DatabaseOperation")
#: Code that is not an application's own.
SKIPPED = r"(?:^|/)(?:bin|obj|node_modules|\.next|dist|build)/"

_SCANS = f"key string, path string, repository string, text string, tokens array<struct<{lexing.TOKEN.replace(' ', ':').replace(',:', ',')}>>"
_TYPES = "key string, path string, line int, name string, word string, attributes string, parameters string, bases array<string>, repository string, namespace string, imports array<string>, text string, from_line int"
_WORDS, _DIGESTS = "key string, word string", "key string, word string, home string, digest decimal(38,0)"
_DONE = "key string, scope long, edition string, attempt string"
_FACTS = f"key string, scope long, edition string, attempt string, extractor string, {SCHEMA}"
_TREE_FACTS = f"attempt string, extractor string, {SCHEMA}"


@dataclass(frozen=True)
class Spec:
    """What an extractor claims: the technologies it is for, its place among others (higher first) and those it must follow."""

    name: str
    run: Callable[[Sources], DataFrame]
    technologies: tuple[str, ...]
    priority: int = 0
    after: tuple[str, ...] = ()

    @property
    def reads(self) -> str:
        return self.run.reads if isinstance(self.run, Extractor) else ".*"

    @property
    def tree(self) -> bool:
        return isinstance(self.run, Extractor) and self.run.tree

    @property
    def edition(self) -> str:
        return f"{self.name}:{self.run.version if isinstance(self.run, Extractor) else 0}"


def _specs() -> list[Spec]:
    def claimed(name: str) -> tuple[str, ...]:
        if name in ("vulnerabilities", "secret_findings"):
            return ("security",)
        if name.startswith("react"):
            return ("react", "nextjs")
        if name.startswith("angular"):
            return ("angular",)
        return ("nextjs",) if name.startswith("next") else ("react", "nextjs", "angular") if name == "frontend_auth" else ("dotnet",)
    return [Spec(name, run, claimed(name), 1 if name == "packages" else 0) for name, run in (extract.EXTRACTORS | dotnet.EXTRACTORS).items()]


def ordered(specs: list[Spec]) -> list[Spec]:
    """Specs after those they must follow, by priority, then as given; unknown ones and circles are errors."""
    known, out, state = {s.name: s for s in specs}, [], {}

    def visit(spec: Spec, path: tuple[str, ...]) -> None:
        if state.get(spec.name) == "done":
            return
        if spec.name in path:
            raise ValueError("circle: " + " -> ".join(path[path.index(spec.name):] + (spec.name,)))
        for name in spec.after:
            if name not in known:
                raise ValueError(f"{spec.name} follows the unknown {name}")
            visit(known[name], path + (spec.name,))
        state[spec.name] = "done"
        out.append(spec)

    for spec in sorted(specs, key=lambda s: -s.priority):
        visit(spec, ())
    return out


@dataclass
class Result:
    status: str
    snapshot_id: str | None = None
    version: int | None = None
    diagnostics: list[tuple[str, str, str]] = field(default_factory=list)
    #: Files that were scanned, and files that extractors read, because no run had.
    scanned: int = 0
    analysed: int = 0


class Log:
    """What a run does, as rows for the store's ``log``."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def __call__(self, step: str, message: str, level: str = "Information") -> None:
        self.rows.append((len(self.rows), time.time(), level, step, message))


# ---- what files say --------------------------------------------------------------------------


def tree_of(files: DataFrame) -> DataFrame:
    """(path, text, repository, file, commit, key) of a tree's files: ``path`` has the repository in front, ``key`` is the digest of path and text. Build output is left out."""
    kept = files.where(~F.col("path").rlike(SKIPPED))
    path = F.concat("repository", F.lit("/"), "path")
    key = F.sha2(F.concat(path, F.lit("\x00"), F.coalesce("text", F.lit(""))).cast("binary"), 256)
    return kept.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"), "repository", F.col("path").alias("file"), "commit", key.alias("key"))


def scans(store: Store, tree: DataFrame) -> tuple[DataFrame, DataFrame, int, bool]:
    """(scans, types, number of new files, whether the scans are written) of the tree's files, of which only new ones are scanned."""
    first = not any(map(store.has, ("scans", "types", "words", "digests")))
    files, different = tree.agg(F.count("*"), F.count_distinct("key")).first()
    new = tree if files == different else tree.dropDuplicates(["key"])
    if not first and store.has("digests"):  # files that were scanned before there were digests are scanned again
        new = stored(new.join(store.read("scans", _SCANS).select("key").distinct(), "key", "left_anti"))
        count = new.count()
    else:
        count = different
    found = None
    if count:
        found = stored(lexing.scan(new, briefly=True).select("key", "path", "repository", "text", "tokens", "words"))
        declared = stored(dotnet.types(found.drop("tokens", "words")).select(*[c.split(" ")[0] for c in _TYPES.split(", ")]))
        store.append("words", found.select("key", F.explode("words").alias("word")))
        store.append("types", declared)
        store.append("digests", dotnet.digests(declared))
        store.append("scans", found.drop("words"))  # last: a file is known when all that is told of it is there
        if first:
            return found.drop("words"), declared, count, True
    keys = tree.select("key").distinct()
    types = stored(store.read("types", _TYPES).dropDuplicates(["key", "line", "name"]).join(keys, "key", "left_semi"))  # written once: each rule of each extractor reads them
    return store.read("scans", _SCANS).dropDuplicates(["key"]).join(keys, "key", "left_semi"), types, count, False


def scopes(store: Store, tree: DataFrame) -> DataFrame:
    """(key, scope) of every file: a digest of what the types and entity sets that it names declare (``dotnet.digests``), zero for files that name none."""
    keys = tree.select("key", "repository").distinct()
    # an attempt that failed may have left the same rows
    digests = store.read("digests", _DIGESTS).join(keys.select("key"), "key", "left_semi").distinct().groupBy("word", "home").agg(F.sum("digest").cast("decimal(38,0)").alias("digest"))
    # most words name no type: those that do are few enough to be made different and to meet the files
    told = store.read("words", _WORDS).join(digests.select("word").distinct(), "word", "left_semi").distinct()
    named = told.join(keys, "key").join(digests, "word").where("home is null or home = repository")
    known = named.groupBy("key").agg(F.sum(F.xxhash64("word", "digest").cast("decimal(38,0)")).alias("sum"))
    return keys.select("key").distinct().join(known, "key", "left").select("key", F.when(F.col("sum").isNull(), 0).otherwise(F.xxhash64("sum")).alias("scope"))


#: Extractors whose rows are written together.
TOGETHER = 8


def _extracted(specs: list[Spec], sources: Sources, said: list[tuple[str, str, str]]) -> tuple[DataFrame | None, bool]:
    """The rows of extractors with ``extractor``, and whether none failed; failures go to ``said``.

    Extractors are planned one by one and written a few at a time; where that fails each is tried alone.
    """
    columns, out, clean = ["extractor", *[c.split(" ")[0] for c in SCHEMA.split(", ")]], None, True

    def fail(spec: Spec, problem: Exception) -> None:
        nonlocal clean
        said.append(("Error", f"{spec.name} failed: {str(problem).splitlines()[0][:200]}", spec.name))
        clean = False

    for at in range(0, len(specs), TOGETHER):
        plans = []
        for spec in specs[at : at + TOGETHER]:
            try:
                plans.append((spec, spec.run(sources).withColumn("extractor", F.lit(spec.name)).select(*columns)))
            except Exception as problem:  # noqa: BLE001  whatever an extractor does, the others go on
                fail(spec, problem)
        if not plans:
            continue
        try:
            done = [stored(union(*[rows for _, rows in plans]))]
        except Exception:  # noqa: BLE001
            done = []
            for spec, rows in plans:
                try:
                    done.append(stored(rows))
                except Exception as problem:  # noqa: BLE001
                    fail(spec, problem)
        for rows in done:
            out = rows if out is None else out.unionByName(rows)
    return out, clean


def discover(store: Store, tree: DataFrame, specs: list[Spec], result: Result, log: Log, force: bool = False) -> DataFrame:
    """The rows of all extractors that the tree's technologies ask for, by what is new of the tree and what the store has."""
    said = result.diagnostics
    found = {r["technology"] for r in artifacts(tree).select("technology").distinct().collect()}  # a row for each technology
    for technology in sorted(found - {t for s in specs for t in s.technologies} - {"security"}):
        said.append(("Warning", f"no extractor for {technology}", "engine"))
    chosen = [s for s in ordered(specs) if found.intersection(s.technologies)]
    nothing = empty(store.spark, f"extractor string, {SCHEMA}")
    if not chosen:
        return nothing
    everything, types, result.scanned, written = scans(store, tree)

    def all_scans() -> DataFrame:
        """The scans of the whole tree, written when a rule first asks for them: most runs read those of a few files."""
        nonlocal everything, written
        if not written:
            everything, written = stored(everything), True
        return everything

    log("scan", f"{result.scanned} files scanned")
    local, wide = [s for s in chosen if not s.tree], [s for s in chosen if s.tree]
    clean, out = True, nothing
    if local:
        edition = hashlib.sha256("\n".join(s.edition for s in local).encode()).hexdigest()
        at = stored(scopes(store, tree).withColumn("edition", F.lit(edition)))
        known = ["key", "scope", "edition"]
        before = store.read("analysed", _DONE).groupBy(*known).agg(F.min("attempt").alias("attempt"))
        todo = stored(at if force else at.join(before, known, "left_anti"))
        result.analysed = todo.count()
        log("extract", f"{result.analysed} files for {len(local)} extractors")
        fresh = None
        if result.analysed:
            whole = result.analysed == at.count()
            some = all_scans() if whole else stored(everything.join(todo.select("key"), "key", "left_semi"))
            tokens = stored(lexing.explode(some.where(F.col("path").rlike(lexing.SCRIPT))))
            near = Sources(some, tokens, types if whole else stored(types.join(todo.select("key"), "key", "left_semi")), types)
            fresh, clean = _extracted(local, near, said)
        if fresh is not None:
            attempt = uuid.uuid4().hex  # what an attempt that failed has left is read by nobody
            homes = some.select("path", "key").join(todo, "key").withColumn("attempt", F.lit(attempt))
            kept = stored(fresh.join(homes, "path").select(*[c.split(" ")[0] for c in _FACTS.split(", ")]))
            out = out.unionByName(kept.select(out.columns))
            if clean and not force:
                store.append("facts", kept)
                store.append("analysed", todo.withColumn("attempt", F.lit(attempt)))
        if not force:
            rest = at.join(todo, known, "left_anti").join(before, known)
            out = out.unionByName(store.read("facts", _FACTS).join(rest.select(*known, "attempt"), [*known, "attempt"], "left_semi").select(out.columns))
    for spec in wide:
        matched = tree.where(F.col("path").rlike(spec.reads)).select("key").distinct()
        digest = matched.agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")).cast("string").alias("d"), F.count("*").alias("n")).first()
        if not digest["n"]:
            continue
        claim = "trees/" + hashlib.sha256(f"{spec.edition}:{digest['n']}:{digest['d']}".encode()).hexdigest()
        held = None if force else store.claimed(claim)
        if held is None:
            log("extract", f"all files for {spec.name}")
            rows, _ = _extracted([spec], Sources(all_scans(), None, types, types), said)
            if rows is None:
                continue
            if not force:
                attempt = uuid.uuid4().hex
                store.append("tree_facts", rows.withColumn("attempt", F.lit(attempt)).select("attempt", *out.columns))
                store.claim(claim, attempt=attempt)
            out = out.unionByName(rows)
        else:
            out = out.unionByName(store.read("tree_facts", _TREE_FACTS).where(F.col("attempt") == held["attempt"]).select(out.columns))
    return stored(out)


def discoveries(rows: DataFrame, tree: DataFrame, application: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Node and edge discoveries of extractors' rows; they are emitted by extractor, then file, then line.

    An edge's ends are the nodes of these names in the file's repository, or in the application; a
    name that no node has stays an unknown identity, which validation judges.
    """
    homes = tree.select("path", "repository", "file", "commit").distinct()
    ranks = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(order)], "extractor string, rank long")
    met = rows.join(F.broadcast(ranks), "extractor").join(homes, "path")
    place = lambda c, bits: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    spot = met.withColumn("path_", F.xxhash64("path")).withColumn("rest_", F.xxhash64("kind", "name", "source")).withColumn("line_", F.col("line").cast("long"))
    seq = F.shiftleft(place("rank", 7), 55) + F.shiftleft(place("path_", 27), 28) + F.shiftleft(place("line_", 17), 11) + place("rest_", 11)
    evidence = F.array(F.struct("repository", "commit", F.col("extractor").alias("engine"), F.lit("Probabilistic").alias("method"), "confidence", "file", "line", F.col("name").alias("symbol")))
    base = spot.select(seq.alias("seq"), "repository", "kind", "name", "source", "properties", "confidence", evidence.alias("evidence"))
    app = F.lit(application)
    scope = lambda kind, repository: F.when(kind.isin(*SHARED), F.concat(F.lit("node://app:"), encode(app))).otherwise(F.concat(F.lit("node://app:"), encode(app), F.lit("/repo:"), encode(repository)))
    mint = lambda kind, repository, name: F.concat(scope(kind, repository), F.lit("/"), F.lower(kind), F.lit(":"), encode(name))
    bag = F.map_concat(F.create_map(F.lit("name"), F.col("name")), "properties")
    nodes = stored(base.where("source is null").select("seq", mint(F.col("kind"), F.col("repository"), F.col("name")).alias("identity"), "kind", bag.alias("properties"), "evidence", "confidence", "repository", "name"))
    # of several nodes of a name the most confident, then the least identity
    best = F.struct(-F.col("confidence"), F.col("identity"))
    local = nodes.groupBy("repository", "name").agg(F.min(best)["identity"].alias("local"))
    wide = nodes.where(F.col("kind").isin(*SHARED)).groupBy("name").agg(F.min(best)["identity"].alias("wide"))
    edges = base.where("source is not null").select("seq", F.col("kind").alias("type"), "repository", "source", F.col("name").alias("target"), "evidence", "confidence")

    def placed(rows: DataFrame, end: str, to: str) -> DataFrame:
        rows = rows.join(local.select("repository", F.col("name").alias(end), "local"), ["repository", end], "left").join(wide.select(F.col("name").alias(end), "wide"), end, "left")
        unknown = F.concat(F.lit("node://app:"), encode(app), F.lit("/repo:"), encode(F.col("repository")), F.lit("/name:"), encode(F.col(end)))
        return rows.withColumn(to, F.coalesce("local", "wide", unknown)).drop("local", "wide")

    edges = placed(placed(edges, "source", "from_id"), "target", "to_id").select("seq", "type", "from_id", "to_id", "evidence", "confidence")
    return nodes.drop("repository", "name"), stored(edges)


def repository_nodes(tree: DataFrame, application: str) -> DataFrame:
    """A node for each repository of the tree."""
    each = tree.groupBy("repository").agg(F.min("commit").alias("commit"))
    identity = F.concat(F.lit("node://app:"), encode(F.lit(application)), F.lit("/repo:"), encode(F.col("repository")))
    evidence = F.array(F.struct("repository", "commit", F.lit("engine").alias("engine"), F.lit("Deterministic").alias("method"), F.lit(1.0).alias("confidence"), F.lit("").alias("file"), F.lit(0).alias("line"), F.col("repository").alias("symbol")))
    return each.select(F.lit(-1).cast("long").alias("seq"), identity.alias("identity"), F.lit("SourceRepository").alias("kind"), F.create_map(F.lit("name"), F.col("repository")).alias("properties"), evidence.cast(EVIDENCE).alias("evidence"), F.lit(1.0).alias("confidence"))


# ---- a run -----------------------------------------------------------------------------------


def run(spark: SparkSession, store: Store, application: str, files: DataFrame, snapshot_id: str, created_at: str, force: bool = False, specs: list[Spec] | None = None, pages: tuple[str, ...] | None = None, children: tuple[str, ...] = ()) -> Result:
    """Analyse ``files(path, text, repository, commit)`` and commit a snapshot; publish pages if anything differs.

    Forced, nothing is taken from earlier runs. ``pages`` names the sections that are published, all
    without it. ``children`` are applications whose latest snapshots are part of this one. A run of an
    id that is committed already changes nothing; while another run has the application, none begins.
    """
    if not store.begin(application, snapshot_id):
        return Result("Rejected", diagnostics=[("Warning", "another run has the application", "engine")])
    try:
        return _run(spark, store, application, files, snapshot_id, created_at, force, _specs() if specs is None else specs, pages, children)
    finally:
        store.end(application)


def _run(spark, store, application, files, snapshot_id, created_at, force, specs, pages, children) -> Result:
    result, log = Result("Completed", snapshot_id), Log()
    said = result.diagnostics
    tree = stored(tree_of(files))
    before = store.snapshot(application)
    rows = discover(store, tree, specs, result, log, force)
    order = [s.name for s in ordered(specs)]
    if rows.isEmpty():
        said.append(("Warning", "nothing was discovered", "engine"))
    found, links = discoveries(rows, tree, application, order)
    for r in validate.rejected(found).groupBy("reason").count().collect():  # a row for each reason
        said.append(("Warning", f"{r['count']} discoveries rejected: {r['reason']}", "validation"))
    nodes = merge.canonical_nodes(found.where("size(evidence) > 0 and confidence between 0 and 1"))
    nodes = stored(nodes.unionByName(repository_nodes(tree, application).select(nodes.columns)) if not rows.isEmpty() else nodes)
    log("merge", f"{nodes.count()} nodes")
    edges = merge.merged_edges(links).drop("members")
    fresh = stored(validate.accepted(edges, nodes).where("accepted").drop("accepted"))
    neither = links.join(fresh, S.EDGE_KEY, "left_anti").count()
    if neither:
        said.append(("Debug", f"{neither} relations between unknown nodes dropped", "validation"))
    nodes = stored(nodes.unionByName(_external(fresh, nodes)))
    columns = fresh.columns
    if children:
        nodes, fresh = _with_children(store, children, nodes, fresh, said)
    more = resolvers.resolved(nodes, fresh).withColumn("evidence", F.array().cast(EVIDENCE)).withColumn("seq", F.lit(0).cast("long")).select(*columns)
    ids = nodes.select("identity")
    more = more.join(ids.withColumnRenamed("identity", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("identity", "to_id"), "to_id", "left_semi").select(*columns)
    edges = stored(fresh.select(*columns).unionByName(more))
    log("resolve", f"{edges.count()} edges")
    committed = store.commit_snapshot(application, snapshot_id, created_at, nodes, edges)
    log("commit", "committed" if committed else "committed before", "Information" if committed else "Warning")
    if not committed:
        said.append(("Warning", f"{snapshot_id} is committed already", "engine"))
        return result
    differing = None
    if before is not None:
        differing = S.diff(store.read_snapshot("nodes", application, before), nodes, ["identity"]), S.diff(store.read_snapshot("edges", application, before), edges, S.EDGE_KEY)
    both = None if differing is None else differing[0].select("change").unionByName(differing[1].select("change"))
    if S.publishes(both, force):
        result.version = _publish(store, application, nodes, edges, differing, created_at, pages, files)
        log("publish", f"version {result.version}")
    if any(level == "Error" for level, _, _ in said):
        result.status = "Partial"
    key = (F.lit(application).alias("application"), F.lit(snapshot_id).alias("snapshot_id"))
    store.append("log", spark.createDataFrame(log.rows, "at int, time double, level string, step string, message string").select(*key, "at", F.col("time").cast("timestamp").alias("time"), "level", "step", "message"))
    store.append("diagnostics", spark.createDataFrame([(application, snapshot_id, *d) for d in said] or [], "application string, snapshot_id string, severity string, message string, source string"))
    store.append("runs", spark.createDataFrame([(application, snapshot_id, result.status, created_at, result.version, result.scanned, result.analysed)], "application string, snapshot_id string, status string, started_at string, version int, scanned long, analysed long"))
    return result


def _with_children(store: Store, children: tuple[str, ...], nodes: DataFrame, edges: DataFrame, said: list) -> tuple[DataFrame, DataFrame]:
    """Own facts and those of the children's latest snapshots; what is the application's own wins."""
    for child in children:
        last = store.snapshot(child)
        if last is None:
            said.append(("Warning", f"no snapshot of {child}", "engine"))
            continue
        theirs, links = store.read_snapshot("nodes", child, last), store.read_snapshot("edges", child, last).where("size(evidence) > 0")
        nodes = nodes.unionByName(theirs.select(nodes.columns).join(nodes.select("identity"), "identity", "left_anti").select(nodes.columns))
        edges = edges.unionByName(links.select(edges.columns).join(edges.select(*S.EDGE_KEY), S.EDGE_KEY, "left_anti").select(edges.columns))
    return stored(nodes), stored(edges)


def _external(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for the unknown ends of accepted edges, with the first edge's evidence."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("identity"), "seq", "evidence", "confidence").join(nodes.select("identity"), "identity", "left_anti")
    first = ends.groupBy("identity").agg(F.min(F.struct("seq", "evidence", "confidence")).alias("e"))
    bare = F.create_map().cast("map<string,string>")
    return first.select(F.col("e.seq").alias("seq"), "identity", F.lit("External").alias("kind"), bare.alias("properties"), F.col("e.evidence").alias("evidence"), F.col("e.confidence").alias("confidence")).select(*nodes.columns)


def _publish(store: Store, application: str, nodes: DataFrame, edges: DataFrame, differing, created_at: str, titles: tuple[str, ...] | None, files: DataFrame) -> int:
    """The pages of the next version, its row, why pages are plain text, and, from the second on, what changed."""
    version = store.last_version(application) + 1
    pages = durable(reports.project(nodes, edges, titles).unionByName(reports.notes_page(notes(files))))
    Pages(store).write(application, pages.select("path", "part", "content", F.lit("text/markdown").alias("content_type")), version)
    told = pages.select("path").distinct()
    store.append("versions", told.agg(F.count("*").alias("pages")).select(F.lit(application).alias("application"), F.lit(version).alias("version"), F.lit(created_at).cast("timestamp").alias("created_at"), "pages"))
    store.append("fallbacks", told.select(F.lit(application).alias("application"), F.lit(version).alias("version"), "path", F.lit("NoProvider").alias("reason"), F.lit(created_at).cast("timestamp").alias("at")))
    if differing is not None and version > 1:
        labels = S.change_labels(*differing).select(F.lit(application).alias("application"), F.lit(version).alias("version"), "app", "list", "label")
        store.append("version_labels", labels)
        store.append("version_changes", S.version_change(application, version, *differing))
    return version


def run_estate(spark: SparkSession, store: Store, applications: DataFrame, files: DataFrame, run_id: str, created_at: str, specs: list[Spec] | None = None, pages: tuple[str, ...] | None = None) -> dict[str, Result]:
    """A run of every application of an estate (name, repos, children, skip_if_unchanged, force), children before parents.

    ``files`` says in ``repository`` whose a file is. An application that asks for it is skipped where
    its repositories have the commits of its last run and no child has published since.
    """
    from lodestar.sources.config import check

    rows = {r["name"]: r for r in applications.collect()}  # a row for each declared application
    out: dict[str, Result] = {}
    for name in check([(r["name"], r["repos"], r["children"], r["skip_if_unchanged"], r["force"]) for r in rows.values()]):
        app = rows[name]
        mine = files.where(F.col("repository").isin(*app["repos"])) if app["repos"] else files.limit(0)
        commits = mine.agg(F.to_json(F.array_sort(F.collect_set(F.struct("repository", "commit")))).alias("c")).first()["c"]
        last = store.read("estate_runs", "name string, commits string, run_id string, at string").where(F.col("name") == name).agg(F.max_by("commits", "at")).first()[0]
        if app["skip_if_unchanged"] and not app["force"] and last == commits and not any(out[c].version for c in app["children"]):
            out[name] = Result("Skipped", diagnostics=[("Information", "nothing has changed", "engine")])
            continue
        out[name] = run(spark, store, name, mine, run_id, created_at, bool(app["force"]), specs, pages, tuple(app["children"]))
        if out[name].status in ("Completed", "Partial"):
            store.append("estate_runs", spark.createDataFrame([(name, commits, run_id, created_at)], "name string, commits string, run_id string, at string"))
    return out
