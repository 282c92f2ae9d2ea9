"""What extractors say and reports read: rows of one schema, and the properties that each kind has.

A row is a node (kind, name, properties) or a relation: its kind is in capitals, ``source`` names the
node that it comes from and ``name`` the one that it goes to. Both sides of the engine name properties
through this module, which knows them all: one that is not declared is an error where the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import lexing
from lodestar.plans.lineage import stored

SCHEMA = "path string, line int, kind string, name string, source string, properties map<string,string>, confidence double"

#: The properties of each kind's nodes, besides ``name``.
PROPERTIES: dict[str, tuple[str, ...]] = {
    "AnalyticsChart": ("library",), "ApiCall": ("verb", "route"), "AuditLog": ("entity", "source"), "AuthProvider": ("import",), "AuthScheme": ("detail", "arg"), "Authorization": ("detail", "arg"),
    "AuthorizationPolicy": ("requirements",), "AzureFunction": ("trigger",), "BackgroundJob": ("bases", "detail", "arg"), "BusinessRule": ("owner", "method"), "Cache": ("detail", "arg"), "Command": ("returns",),
    "Component": ("role",), "Configuration": ("source",), "Consumer": (), "Context": ("kind",), "Controller": ("bases",), "Cors": ("detail", "arg", "origins"), "DataAccess": ("approach", "db"), "DataGrid": ("columns",),
    "DataStore": ("kind",), "DatabaseOperation": ("owner", "method", "operation", "entity", "approach", "operators", "tracking", "async", "sql"), "Endpoint": ("verb", "route", "authorization", "action", "parameters"),
    "Entity": ("fields", "validated", "key", "tableName", "primaryKey", "indexedProperties"), "Event": ("category",), "Filter": ("component", "shape", "targetField", "kind"), "FormField": ("form", "validation"), "Guard": ("contract",),
    "Handler": (), "HealthCheck": ("detail", "arg"), "Hook": (), "ImportExport": ("kind", "async"), "Interceptor": ("contract",), "Interface": (), "Logging": ("detail", "arg"), "Message": ("kind",), "MessageBroker": (),
    "Messaging": ("detail", "arg"), "Middleware": ("bases", "detail", "order", "arg"), "Migration": ("operations",), "OutboundCall": ("owner", "verb", "route"), "Project": ("kind", "framework"), "Query": ("returns",),
    "Repository": ("bases", "lifetime"), "Resilience": ("detail", "arg"), "Resolver": ("contract",), "Role": ("value",), "Route": ("path", "protected", "roles", "kind", "component", "loads", "redirectTo"),
    "Service": ("bases", "lifetime"), "StatusWorkflow": ("values",), "Technology": ("category", "package", "version", "usage"), "TokenAttachment": (), "TokenStorage": ("operation",),
    "UIComponent": ("kind", "rendering", "props", "hooks", "displayName", "emptyStateLabel", "selector"), "UIService": (), "Validator": ("rules",), "Vulnerability": ("severity", "type", "hits")}
#: Properties that hold lists: what stands between their items.
LISTS = {"fields": "; ", "rules": "; ", "operations": "; ", "requirements": "; ", "usage": "; "}


def check(kind: str, *names: str) -> None:
    """An error if a kind has no such property."""
    unknown = [n for n in names if n not in PROPERTIES.get(kind, ())]
    if unknown:
        raise ValueError(f"{kind} has no property {', '.join(unknown)}")


def prop(kind: str, name: str, properties: str = "properties") -> Column:
    """A declared property of a kind's nodes."""
    check(kind, name)
    return F.col(properties)[name]


class Properties:
    """Named values of a node; those that are null or empty are not there."""

    def __init__(self, **given: Column) -> None:
        self.given = given

    def column(self) -> Column:
        pairs = [F.struct(F.lit(k).alias("key"), lexing.shown(c.cast("string")).alias("value")) for k, c in self.given.items()]
        if not pairs:
            return F.create_map().cast("map<string,string>")
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull() & (p["value"] != "")))


def facts(rows: DataFrame, kind: Column | str, name: Column, said: Properties | Column | None, confidence: float | Column, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the schema: nodes with the properties ``said``, or relations that come from ``said``; ``kinds`` are those that a computed kind can be."""
    relation = said is not None and not isinstance(said, Properties)
    if not relation:
        for k in (kind,) if isinstance(kind, str) else kinds:
            check(k, *(said.given if said else ()))
    k = F.lit(kind) if isinstance(kind, str) else kind
    c = F.lit(confidence) if isinstance(confidence, float) else confidence
    bag = F.lit(None).cast("map<string,string>") if relation else (said or Properties()).column()
    source = lexing.shown(said) if relation else F.lit(None).cast("string")
    return rows.select("path", F.col("line").cast("int").alias("line"), k.alias("kind"), lexing.shown(name).alias("name"), source.alias("source"), bag.alias("properties"), c.alias("confidence"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rendered(rows: DataFrame) -> DataFrame:
    """(path, line, kind, name, detail, confidence): the source of a relation, or the properties as text."""
    pairs = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return rows.select("path", "line", "kind", "name", F.coalesce("source", F.nullif(pairs, F.lit(""))).alias("detail"), "confidence")


class Sources:
    """Scanned files to be analysed (``files``, ``tokens``, ``types``) within a whole tree, whose declared types are ``known``."""

    def __init__(self, scanned: DataFrame, tokens: DataFrame | None = None, types: DataFrame | None = None, known: DataFrame | None = None) -> None:
        self.scanned, self.files = scanned, scanned.drop("tokens", "words")
        self._tokens, self._types, self._known = tokens, types, known

    @classmethod
    def of(cls, files: DataFrame) -> "Sources":
        """Files that are a whole tree by themselves; the scan is written once."""
        return cls(stored(lexing.scan(files, briefly=True)))

    @property
    def tokens(self) -> DataFrame:
        if self._tokens is None:
            self._tokens = stored(lexing.explode(self.scanned))  # an extractor reads them many times
        return self._tokens

    @property
    def types(self) -> DataFrame:
        if self._types is None:
            from lodestar.operators.dotnet import types
            self._types = stored(types(self.files))
        return self._types

    @property
    def known(self) -> DataFrame:
        return self.types if self._known is None else self._known

    def like(self, pattern: str) -> DataFrame:
        """The files whose path fits."""
        return self.files.where(F.col("path").rlike(pattern))

    def script(self, pattern: str = lexing.SCRIPT, few: bool = False) -> DataFrame:
        """The tokens of the files whose path fits. Rules that look at them ``few`` times, and at single neighbours only, cost less than writing tokens would: unless they are written already, each look takes them from the scan."""
        tokens = lexing.beside(self.scanned) if few and self._tokens is None else self.tokens
        return tokens.where(F.col("path").rlike(pattern))


@dataclass(frozen=True)
class Extractor:
    """A table function from sources to facts. ``reads`` fits the paths that it reads; the rows of a file follow from that file and the types it names, or, with ``tree``, from all files it reads."""

    name: str
    run: Callable[[Sources], DataFrame]
    reads: str
    tree: bool = False
    version: int = 1
    about: str = ""

    def __call__(self, files: DataFrame | Sources) -> DataFrame:
        return self.run(files if isinstance(files, Sources) else Sources.of(files))


def extractor(reads: str, tree: bool = False, version: int = 1):
    """Makes a function of sources an extractor; it can also be given plain files(path, text)."""
    def make(f: Callable[[Sources], DataFrame]) -> Extractor:
        return Extractor(f.__name__, f, reads, tree, version, f.__doc__ or "")
    return make
