"""Extractors for C# and its project files: lexical stand-ins for compiler analysis.

Patterns run over the code of the scan, which has no comments and in which strings are opaque. A file
is cut at its type declarations and a type at its methods, so that every rule knows the type
and method it stands in; "in source" means that a type of that name is declared in the tree.
Confidences are lower than a compiler's facts would deserve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import lexing
from lodestar.operators.extract import occurrences, stem, whole_files
from lodestar.operators.facts import Properties as properties, Sources, extractor, facts, union
from lodestar.operators.merge import first_by
from lodestar.operators.resolve import capability

#: One attribute list in its brackets, and any number of them.
_BRACKETS = r"\[(?:[^\]\n\"]|\"[^\"\n]*\")*\]\s*"
_ATTRIBUTES = rf"((?:{_BRACKETS})*)"
_TYPE = r"(?m)^[ \t]*" + _ATTRIBUTES + r"(?:(?:public|internal|private|protected|sealed|abstract|partial|static|readonly)\s+)*(class|interface|record(?:[ \t]+(?:class|struct))?|struct)[ \t]+(\w+)(?:<[^>{(]*>)?[ \t]*(\([^)]*\))?\s*(?::\s*([^{;]+))?"
_METHOD = r"(?m)^[ \t]*" + _ATTRIBUTES + r"(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|abstract)\s+)+(?!class\b|interface\b|record\b|struct\b|new\b)([\w.<>?\[\], ]+?)\s+(\w+)\s*\(([^)]*)\)"
_PROPERTY = r"(?m)^[ \t]*" + _ATTRIBUTES + r"(?:public\s+)(?:virtual\s+|required\s+|override\s+)*([\w.<>?\[\], ]+?)\s+(\w+)\s*(?:\{\s*get|=>)"
#: What stands between parentheses, nested up to four deep.
_NESTED = r"(?>[^()]+|\((?>[^()]+|\((?>[^()]+|\((?>[^()]+|\([^()]*\))*+\))*+\))*+\))*+"
_STRING = r"\$?@?\"([^\"]*)\""
SHARP = lexing.SHARP
_COLLECTION = r"^(?:ICollection|IList|List|IEnumerable|HashSet|ISet|IReadOnlyCollection|IReadOnlyList|Collection)<\s*([\w.]+)\s*>\??$|^([\w.]+)\[\]$"


def types(files: DataFrame) -> DataFrame:
    """(path, line, name, word, attributes, parameters, bases, repository, namespace, imports, text, from_line): a row for each declared type, its text up to the next one.

    Files may say which repository they are in; a ``key`` of theirs stays.
    """
    keys = ["key"] if "key" in files.columns else []
    home = F.col("repository") if "repository" in files.columns else F.lit("")
    src = files.where(F.col("path").rlike(SHARP)).select("path", "text", *keys, home.alias("repository"), F.regexp_extract("text", r"(?m)^\s*namespace\s+([\w.]+)", 1).alias("namespace"), F.regexp_extract_all("text", F.lit(r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;"), 1).alias("imports"))
    rows = occurrences(src, _TYPE, 1, 2, 3, 4, 5, keep=("repository", "namespace", "imports", *keys), rest=True)
    bases = F.regexp_extract_all("g5", F.lit(r"[\w.]+(?:<(?:[^<>]|<[^<>]*>)*>)?"), 0)
    return rows.select("path", "line", F.col("g3").alias("name"), F.col("g2").alias("word"), F.col("g1").alias("attributes"), F.col("g4").alias("parameters"), F.coalesce(bases, F.array().cast("array<string>")).alias("bases"), "repository", "namespace", "imports", "text", "from_line", *keys)


def methods(declared: DataFrame) -> DataFrame:
    """(path, line, owner, method, attributes, returns, parameters, text, from_line) of the methods of types, each with its text up to the next one."""
    rows = occurrences(declared.withColumnRenamed("name", "owner"), _METHOD, 1, 2, 3, 4, keep=("owner", "repository"), rest=True)
    return rows.select("path", "line", "owner", "repository", F.col("g3").alias("method"), F.col("g1").alias("attributes"), F.col("g2").alias("returns"), F.col("g4").alias("parameters"), "text", "from_line")


def in_source(rows: DataFrame, column: str, declared: DataFrame) -> DataFrame:
    """The rows whose ``column`` names a type of ``declared``."""
    return rows.join(declared.select(F.col("name").alias(column)).distinct(), column, "left_semi")


def short(base: Column) -> Column:
    """A base type's name without name space and type arguments."""
    return F.element_at(F.split(F.regexp_replace(base, "<.*$", ""), r"\."), -1)


def argument(base: Column) -> Column:
    """The first type argument's short name, null without one."""
    inside = F.nullif(F.regexp_extract(base, r"<\s*([\w.]+)", 1), F.lit(""))
    return F.element_at(F.split(inside, r"\."), -1)


def any_base(*names: str) -> Column:
    return F.exists("bases", lambda b: short(b).isin(*names))


def the_base(*names: str) -> Column:
    """The first base of one of these names, null without one."""
    return F.get(F.filter("bases", lambda b: short(b).isin(*names)), F.lit(0))


def _is_class() -> Column:
    return ~F.col("word").startswith("interface")


# ---- types ---------------------------------------------------------------------------------


@extractor(SHARP)
def csharp_types(src: Sources) -> DataFrame:
    """Controllers, services, repositories, background jobs and middleware by base, else by name."""
    n, named = F.col("name"), lambda suffix: F.col("name").endswith(suffix)
    by_base = (F.when(any_base("Controller", "ControllerBase"), "Controller").when(any_base("BackgroundService", "IHostedService"), "BackgroundJob")
               .when(F.exists("bases", lambda b: short(b).rlike("^I.*Service$")), "Service").when(F.exists("bases", lambda b: short(b).rlike("^I.*Repository$")), "Repository"))
    by_name = F.when(named("Controller"), "Controller").when(named("Service"), "Service").when(named("Repository"), "Repository").when(named("Middleware"), "Middleware")
    rows = src.types.where(_is_class()).withColumn("kind_", F.coalesce(by_base, by_name)).where("kind_ is not null")
    return facts(rows, F.col("kind_"), n, properties(bases=F.array_join("bases", ", ")), F.when(by_base.isNotNull(), 0.7).otherwise(0.6), ("Controller", "Service", "Repository", "BackgroundJob", "Middleware"))


@extractor(SHARP)
def csharp_contracts(src: Sources) -> DataFrame:
    """Interfaces; IMPLEMENTS and EXTENDS to types in source."""
    declared = src.types
    each = declared.select("path", "line", "name", "word", F.explode("bases").alias("b")).withColumn("base", short(F.col("b")))
    known = src.known.select(F.col("name").alias("base"), F.when(_is_class(), "EXTENDS").otherwise("IMPLEMENTS").alias("how")).distinct()
    met = each.join(known, "base").where("base <> name")
    kind = F.when(F.col("word") == "interface", "EXTENDS").otherwise(F.col("how"))
    return union(facts(declared.where("word = 'interface'"), "Interface", F.col("name"), None, 0.8), facts(met, kind, F.col("base"), F.col("name"), 0.7))


#: The endings of names that are no entities.
TRANSFER = r"(?:Request|Response|Dto|DTO|ViewModel|Vm|Command|Query|Payload)$"
#: The attributes that validate a property.
VALIDATING = r"\[(?:[^\]]*,\s*)?(?:Required|MaxLength|MinLength|StringLength|Range|EmailAddress|Phone|Url|RegularExpression|Compare|CreditCard)\b"


def _properties() -> Column:
    """array<struct<attributes, type, property>> of the properties in ``text``, by one pass of the pattern."""
    said = "".join(f"${g}{lexing.CUT}" for g in (1, 2, 3))
    marked = F.regexp_replace(lexing.unmarked(F.col("text")), F.lit(_PROPERTY), F.lit(lexing.MATCH + said))
    cut = F.transform(F.slice(F.split(marked, lexing.MATCH, -1), F.lit(2), F.lit(1 << 30)), lambda p: F.split(p, lexing.CUT, 4))
    return F.transform(cut, lambda c: F.struct(F.get(c, F.lit(0)).alias("attributes"), F.trim(F.get(c, F.lit(1))).alias("type"), F.get(c, F.lit(2)).alias("property")))


def _members(declared: DataFrame) -> DataFrame:
    """(path, line, name, at, attributes, type, property, element): the properties of each type in order, with a collection's element."""
    each = declared.select("path", "line", "name", F.posexplode(_properties()).alias("at", "p")).select("path", "line", "name", "at", "p.attributes", "p.type", "p.property")
    return each.withColumn("element", F.coalesce(F.nullif(F.regexp_extract("type", _COLLECTION, 1), F.lit("")), F.nullif(F.regexp_extract("type", _COLLECTION, 2), F.lit(""))))


def digests(declared: DataFrame) -> DataFrame:
    """(key, word, home, digest): of each file what its types and entity sets declare under a name; a set's name means something in its repository (``home``) alone.

    A declaration is a type's name, kind, bases, name space and properties, wherever it is declared;
    what its methods do is not part of it.
    """
    none = F.lit(0).cast("decimal(38,0)")
    each = F.transform(_properties(), lambda p, i: F.xxhash64(p["type"], p["property"], i))
    members = F.aggregate(each, none, lambda a, x: (a + x.cast("decimal(38,0)")).cast("decimal(38,0)"))
    own = declared.select("key", F.col("name").alias("word"), F.lit(None).cast("string").alias("home"), F.xxhash64("word", "bases", "namespace", "repository", members).alias("digest"))
    sets = _sets(declared).select("key", F.col("set").alias("word"), F.col("repository").alias("home"), F.xxhash64("entity").alias("digest"))
    return own.unionByName(sets).groupBy("key", "word", "home").agg(F.sum(F.col("digest").cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"))


def _entity_like(declared: DataFrame) -> DataFrame:
    return declared.where(_is_class() & ~F.col("name").rlike(TRANSFER) & ~F.col("name").rlike("(?:Service|Controller|Repository|DbContext)$"))


@extractor(SHARP)
def csharp_entities(src: Sources) -> DataFrame:
    """Types of properties only: fields, validated ones and the key; HAS_MANY and REFERENCES to others in source."""
    declared = src.types
    plain = declared.where(_is_class() & ~F.col("name").rlike(TRANSFER) & ~F.col("name").rlike("(?:Service|Controller)$") & ~F.exists("bases", lambda b: b.contains("DbContext")) & ~F.col("text").rlike(_METHOD))
    members = _members(plain).withColumn("target", F.regexp_replace(F.coalesce("element", "type"), r"\?$", ""))
    known = _entity_like(src.known).select(F.col("name").alias("target"), F.lit(True).alias("known")).distinct()
    met = members.join(known, "target", "left").withColumn("nav", F.coalesce("known", F.lit(False)) & (F.col("target") != F.col("name")))
    item = F.struct("at", F.concat("property", F.lit(": "), "type").alias("shown"), "property", F.col("attributes").rlike(VALIDATING).alias("checked"), ((F.col("property") == "Id") | F.col("attributes").rlike(r"\[(?:[^\]]*,\s*)?Key\b")).alias("key"), "nav")
    g = met.groupBy("path", "line", "name").agg(F.array_sort(F.collect_list(item)).alias("m"))
    pick = lambda which, what: F.array_join(F.transform(F.filter("m", which), lambda x: x[what]), "; " if what == "shown" else ", ")
    keys = F.get(F.transform(F.filter("m", lambda x: x["key"]), lambda x: x["property"]), F.lit(0))
    nodes = facts(g, "Entity", F.col("name"), properties(fields=pick(lambda x: ~x["nav"], "shown"), validated=pick(lambda x: x["checked"], "property"), key=keys), 0.7)
    return union(nodes, facts(met.where("nav"), F.when(F.col("element").isNotNull(), "HAS_MANY").otherwise("REFERENCES"), F.col("target"), F.col("name"), 0.65))


def _contexts(declared: DataFrame) -> DataFrame:
    return declared.where(_is_class() & F.exists("bases", lambda b: short(b).endswith("DbContext")))


def _sets(declared: DataFrame) -> DataFrame:
    """(path, line, owner, entity, set): the entity sets of data contexts; a ``key`` of the types stays."""
    keys = ["key"] if "key" in declared.columns else []
    rows = occurrences(_contexts(declared).withColumnRenamed("name", "owner"), r"\bDbSet<\s*([\w.]+)\s*>\??\s+(\w+)", 1, 2, keep=("owner", "repository", *keys))
    return rows.select("path", "line", "owner", "repository", *keys, F.element_at(F.split("g1", r"\."), -1).alias("entity"), F.col("g2").alias("set"))


@extractor(SHARP)
def csharp_data_contexts(src: Sources) -> DataFrame:
    """Data contexts and the entities they own; relations, table names, keys and indexes of fluent configuration."""
    declared = src.types
    sets = _sets(declared)
    inline = occurrences(_contexts(declared), r"\.Entity<\s*([\w.]+)\s*>\s*\(", 1, rest=True).withColumnRenamed("g1", "root")
    apart = declared.withColumn("root", argument(the_base("IEntityTypeConfiguration"))).where("root is not null").select("path", "line", "root", "text", "from_line")
    chains = union(inline.select("path", "line", "root", "text", "from_line"), apart)
    step = rf"\.(HasOne|HasMany)(?:<\s*(\w+)\s*>)?\(\s*(?:\w+\s*=>\s*\w+\.(\w+))?{_NESTED}\)((?:\s*\.\w+(?:<[^>]*>)?\({_NESTED}\))*+)"
    calls = occurrences(chains, step, 1, 2, 3, 4, keep=("root",))
    members = _members(src.known).select(F.col("name").alias("root"), F.col("property").alias("g3"), F.regexp_replace(F.coalesce("element", "type"), r"\?$", "").alias("goes_to"))
    aimed = calls.join(first_by(members, ["root", "g3"], ["goes_to"]), ["root", "g3"], "left").withColumn("target", F.coalesce(F.nullif("g2", F.lit("")), "goes_to")).where("target <> root")
    back = F.regexp_extract("g4", r"\.(With(?:One|Many))\b", 1)
    how = (F.when((F.col("g1") == "HasOne") & (back == "WithOne"), "HAS_ONE").when((F.col("g1") == "HasMany") & (back == "WithMany"), "MANY_TO_MANY").when(F.col("g1") == "HasOne", "REFERENCES").otherwise("HAS_MANY"))
    related = in_source(aimed, "target", src.known)
    said = occurrences(chains, rf"\.(ToTable|HasKey|HasIndex)\(({_NESTED})\)", 1, 2, keep=("root",))
    of = F.when(F.col("g1") == "ToTable", F.regexp_extract("g2", _STRING, 1)).when(F.col("g2").rlike("^\\s*\""), F.regexp_extract("g2", _STRING, 1)).otherwise(F.array_join(F.regexp_extract_all("g2", F.lit(r"\b\w+\.(\w+)"), 1), ", "))
    said = said.withColumn("value", of).where("value <> ''")
    only = lambda call: F.when(F.col("g1") == call, F.col("value"))
    return union(
        facts(_contexts(declared), "DataStore", F.col("name"), properties(kind=F.lit("ef-dbcontext")), 0.8), facts(sets, "Entity", F.col("entity"), None, 0.8), facts(sets, "OWNS", F.col("entity"), F.col("owner"), 0.8),
        facts(related, how, F.col("target"), F.col("root"), 0.7), facts(said, "Entity", F.col("root"), properties(tableName=only("ToTable"), primaryKey=only("HasKey"), indexedProperties=only("HasIndex")), 0.8))


#: The operations of a migration.
MIGRATES = "CreateTable|DropTable|RenameTable|AddColumn|DropColumn|RenameColumn|AlterColumn|AddForeignKey|DropForeignKey|CreateIndex|DropIndex|AddPrimaryKey|DropPrimaryKey"


@extractor(SHARP)
def csharp_migrations(src: Sources) -> DataFrame:
    """Migrations with what their Up does, by the names it gives."""
    declared = src.types.where(_is_class() & any_base("Migration"))
    ups = methods(declared).where("method = 'Up'").select("path", F.col("owner").alias("name"), "text")
    call = rf"\.({MIGRATES})(?:<[^>]*>)?\(({_NESTED})\)"
    calls = F.arrays_zip(F.regexp_extract_all("text", F.lit(call), 1).alias("call"), F.regexp_extract_all("text", F.lit(call), 2).alias("given"))
    named = lambda g: F.coalesce(F.nullif(F.regexp_extract(g, r"\bname:\s*\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.regexp_extract(g, _STRING, 1), F.lit("")))
    shown = F.transform(calls, lambda c: F.when(named(c["given"]).isNull(), c["call"]).otherwise(F.concat(c["call"], F.lit("("), named(c["given"]), F.lit(")"))))
    met = declared.select("path", "line", "name").join(ups.select("path", "name", F.array_join(shown, "; ").alias("operations")), ["path", "name"], "left")
    return facts(met, "Migration", F.col("name"), properties(operations=F.col("operations")), 0.8)


# ---- data ----------------------------------------------------------------------------------

#: What the methods of a data library do; those with a second form end in Async there.
OPERATIONS = {
    "Read": "Find First FirstOrDefault Single SingleOrDefault ToList ToArray ToDictionary ToHashSet Any Load".split(),
    "Insert": "Add AddRange".split(), "Update": "Update UpdateRange ExecuteUpdate".split(), "Delete": "Remove RemoveRange ExecuteDelete".split(), "Persist": ["SaveChanges"],
    "Aggregate": "Count LongCount Sum Average Min Max".split(), "Transaction": "BeginTransaction Commit CommitTransaction Rollback RollbackTransaction".split()}
#: The steps of a query that are listed.
STEPS = (
    "Where", "Select", "SelectMany", "Join", "GroupJoin", "Include", "ThenInclude", "GroupBy", "OrderBy", "OrderByDescending", "ThenBy", "ThenByDescending", "Skip", "Take", "Distinct",
    "AsNoTracking", "AsTracking", "AsSplitQuery", "Union", "Concat", "Except", "Intersect")


def operation(method: Column) -> Column:
    bare = F.regexp_replace(method, "Async$", "")
    out = F.when(method.isin("AsEnumerable", "AsAsyncEnumerable"), "Read")
    for kind, names in OPERATIONS.items():
        out = out.when(bare.isin(*names), kind)
    return out


def _sql(given: Column) -> Column:
    return F.nullif(F.regexp_extract(given, r"(\$?@?\"[^\"]*\")", 1), F.lit(""))


@extractor(SHARP)
def csharp_database_operations(src: Sources) -> DataFrame:
    """Calls on entity sets, of saving and transactions, of raw SQL and of a mapper, with the entity, the query's steps and the SQL."""
    declared = src.types
    where = methods(declared.where(_is_class())).select("path", "owner", "method", "repository", "text", "from_line")
    keep = ("owner", "method", "repository")
    sets = _sets(src.known).select("repository", F.col("set").alias("g1"), "entity").distinct()
    chain = rf"\b\w+\.(?:(\w+)|Set<\s*(\w+)\s*>\(\))((?:\s*\.\s*\w+(?:<[^>()]*>)?\({_NESTED}\))+)"
    chained = occurrences(where, chain, 1, 2, 3, keep=keep).join(sets, ["repository", "g1"], "left").withColumn("entity", F.coalesce(F.nullif("g2", F.lit("")), "entity")).where("entity is not null")
    names = F.regexp_extract_all("g3", F.lit(r"\.\s*(\w+)(?:<[^>()]*>)?\((?=" + _NESTED + r"\)(?:\s*\.|\s*$))"), 1)
    chained = chained.withColumn("names", names)
    last = F.element_at("names", -1)
    raw = "FromSqlRaw|FromSqlInterpolated|ExecuteSqlRaw|ExecuteSqlRawAsync|ExecuteSqlInterpolated|ExecuteSqlInterpolatedAsync"
    queried = chained.where(F.size("names") > 0).withColumn("call", last).withColumn("operation", operation(F.col("call"))).where("operation is not null and operation not in ('Persist', 'Transaction')")
    steps = F.filter(F.slice("names", F.lit(1), F.size("names") - 1), lambda s: s.isin(*STEPS))
    queried = queried.select("path", "line", *keep, "call", "operation", "entity", F.lit("EF Core").alias("approach"), F.array_join(steps, ", ").alias("steps"), F.lit(None).cast("string").alias("sql"))
    saved = occurrences(where, r"(?i:\b(\w*(?:context|db|database|connection|transaction)\w*))\.(?:Database\.)?((?:SaveChanges|BeginTransaction|Commit|CommitTransaction|Rollback|RollbackTransaction)(?:Async)?)\(", 2, keep=keep)
    saved = saved.select("path", "line", *keep, F.col("g1").alias("call"), operation(F.col("g1")).alias("operation"), F.lit(None).cast("string").alias("entity"), F.lit("EF Core").alias("approach"), F.lit("").alias("steps"), F.lit(None).cast("string").alias("sql"))
    stored = lambda sql: sql.rlike(r"(?i)^\$?@?\"\s*(?:EXEC|CALL)")
    direct = occurrences(where, rf"(?:\.(\w+))?\.({raw})(?:<[^>]*>)?\(({_NESTED})\)", 1, 2, 3, keep=keep).join(sets, ["repository", "g1"], "left")
    direct = direct.withColumn("sql", _sql(F.col("g3"))).select("path", "line", *keep, F.col("g2").alias("call"), F.when(stored(F.col("sql")), "StoredProcedure").otherwise("RawSql").alias("operation"), "entity", F.lit("EF Core").alias("approach"), F.lit("").alias("steps"), "sql")
    mapped = where.join(declared.where(F.exists("imports", lambda i: i.startswith("Dapper"))).select("path").distinct(), "path", "left_semi")
    mapped = occurrences(mapped, rf"\.((?:Query(?:First|FirstOrDefault|Single|SingleOrDefault)?|Execute(?:Scalar|Reader)?)(?:Async)?)(?:<\s*(\w+)[^>]*>)?\(({_NESTED})\)", 1, 2, 3, keep=keep).withColumn("sql", _sql(F.col("g3")))
    kind = F.when(stored(F.col("sql")) | F.col("g3").contains("CommandType.StoredProcedure"), "StoredProcedure").when(F.col("g1").startswith("Query"), "Read").otherwise("Write")
    mapped = mapped.select("path", "line", *keep, F.col("g1").alias("call"), kind.alias("operation"), F.nullif("g2", F.lit("")).alias("entity"), F.lit("Dapper").alias("approach"), F.lit("").alias("steps"), "sql")
    rows = union(queried, saved, direct, mapped)
    detail = properties(owner=F.col("owner"), method=F.col("method"), operation=F.col("operation"), entity=F.col("entity"), approach=F.col("approach"), operators=F.col("steps"), tracking=F.when(F.col("steps").contains("AsNoTracking"), "no-tracking"), **{"async": F.when(F.col("call").endswith("Async"), "true")}, sql=F.col("sql"))
    return facts(rows, "DatabaseOperation", F.concat("owner", F.lit("."), "method", F.lit(":"), "call"), detail, 0.6)


#: Type names that tell how data is reached.
DATA_ACCESS = (
    ("SqlConnection", "ADO.NET", "SQL Server"), ("NpgsqlConnection", "ADO.NET", "PostgreSQL"), ("MySqlConnection", "ADO.NET", "MySQL"), ("SqliteConnection", "ADO.NET", "SQLite"),
    ("OracleConnection", "ADO.NET", "Oracle"), ("IMongoCollection", "MongoDB driver", "MongoDB"), ("IMongoDatabase", "MongoDB driver", "MongoDB"), ("MongoClient", "MongoDB driver", "MongoDB"))


@extractor(SHARP, tree=True)
def csharp_data_access(src: Sources) -> DataFrame:
    """How data is reached, each way once, in the first file that shows it."""
    code = src.like(SHARP)
    table = src.files.sparkSession.createDataFrame(DATA_ACCESS, "marker string, approach string, db string")
    seen = code.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(" + "|".join(m for m, _, _ in DATA_ACCESS) + r")\b"), 1))).alias("marker")).join(F.broadcast(table), "marker")
    ways = seen.select("path", F.concat("approach", F.lit(" ("), "db", F.lit(")")).alias("name"), "approach", "db")
    dapper = code.where(F.col("text").rlike(r"(?m)^\s*using\s+Dapper\b")).select("path", F.lit("Dapper (micro-ORM)").alias("name"), F.lit("Dapper (micro-ORM)").alias("approach"), F.lit("").alias("db"))
    found = first_by(union(ways, dapper), ["name"], ["path"]).withColumn("line", F.lit(1))
    return facts(found, "DataAccess", F.col("name"), properties(approach=F.col("approach"), db=F.col("db")), 0.7)


# ---- wiring --------------------------------------------------------------------------------


@extractor(SHARP)
def csharp_dependencies(src: Sources) -> DataFrame:
    """DEPENDS_ON: a type and the types in source that its constructors are given."""
    declared = src.types
    primary = declared.where(_is_class() & (F.coalesce("parameters", F.lit("")) != "")).select("path", "line", F.col("name").alias("owner"), F.col("parameters").alias("given"))
    made = occurrences(declared.where(_is_class()).withColumnRenamed("name", "owner"), r"(?m)^[ \t]*(?:public|internal|protected|private)\s+(\w+)\s*\(([^)]*)\)\s*(?::\s*(?:base|this)[^{]*)?(?=\{|=>)", 1, 2, keep=("owner",)).where("g1 = owner")
    every = union(primary, made.select("path", "line", "owner", F.col("g2").alias("given")))
    each = every.select("path", "line", "owner", F.explode(F.array_distinct(F.regexp_extract_all("given", F.lit(r"(?:[(,]|^)\s*(?:\[[^\]]*\]\s*)?(?:\w+\.)*(\w+)(?:<[^>]*>)?\??\s+\w+"), 1))).alias("target")).where("target <> owner")
    return facts(in_source(first_by(each, ["path", "owner", "target"], ["line"]), "target", src.known), "DEPENDS_ON", F.col("target"), F.col("owner"), 0.7)


@extractor(SHARP)
def csharp_registrations(src: Sources) -> DataFrame:
    """Registered services with their lifetime, of two type arguments, of a factory, or of open types; IMPLEMENTS what they stand for."""
    code = src.like(SHARP)
    life = r"\.Add(Scoped|Singleton|Transient)"
    forms = (life + r"<\s*([\w.]+(?:<[^<>]*>)?)\s*,\s*([\w.]+(?:<[^<>]*>)?)\s*>\s*\(", life + r"<\s*([\w.]+)\s*>\(\s*\w+\s*=>[^;]*?\bnew\s+([\w.]+)", life + r"\(\s*typeof\(([\w.]+)(?:<[^>]*>)?\)\s*,\s*typeof\(([\w.]+)(?:<[^>]*>)?\)")
    rows = union(*[occurrences(code, f, 1, 2, 3) for f in forms]).withColumn("made", short(F.col("g3"))).withColumn("contract", short(F.col("g2")))
    kind = F.when(F.col("made").endswith("Repository"), "Repository").otherwise("Service")
    return union(facts(rows, kind, F.col("made"), properties(lifetime=F.col("g1")), 0.8, ("Repository", "Service")), facts(rows, "IMPLEMENTS", F.col("contract"), F.col("made"), 0.8))


@extractor(SHARP)
def csharp_program(src: Sources) -> DataFrame:
    rows = whole_files(src.like(r"(?i)(?:^|/)Program\.cs$"))
    return facts(rows, "Component", F.lit("Program"), properties(role=F.lit("host")), 1.0)


#: Calls of the framework and what they set up (kind, name, detail).
SETUP = (
    ("AddMemoryCache", "Cache", "In-memory cache", "IMemoryCache"), ("AddDistributedMemoryCache", "Cache", "Distributed cache (in-memory)", "IDistributedCache"),
    ("AddStackExchangeRedisCache", "Cache", "Redis (distributed cache)", "StackExchange.Redis"), ("AddRedis", "Cache", "Redis (distributed cache)", "StackExchange.Redis"),
    ("AddResponseCaching", "Cache", "Response caching", ""), ("AddOutputCache", "Cache", "Output caching", ""), ("AddJwtBearer", "AuthScheme", "JWT Bearer", "jwt"), ("AddCookie", "AuthScheme", "Cookie", "cookie"),
    ("AddOpenIdConnect", "AuthScheme", "OpenID Connect", "oidc"), ("AddMicrosoftIdentityWebApi", "AuthScheme", "Microsoft Entra ID (Azure AD)", "azure-ad"),
    ("AddMicrosoftIdentityWebApp", "AuthScheme", "Microsoft Entra ID (Azure AD)", "azure-ad"), ("AddNegotiate", "AuthScheme", "Windows / Negotiate", "negotiate"),
    ("AddIdentityServerJwt", "AuthScheme", "IdentityServer JWT", "identityserver"), ("AddOktaMvc", "AuthScheme", "Okta", "okta"), ("AddOktaWebApi", "AuthScheme", "Okta", "okta"),
    ("AddAuth0WebAppAuthentication", "AuthScheme", "Auth0", "auth0"), ("AddAuth0Authentication", "AuthScheme", "Auth0", "auth0"), ("AddCors", "Cors", "CORS configured", "policy"),
    ("UseCors", "Cors", "CORS middleware", "middleware"), ("AddAuthorization", "Authorization", "Authorization policies", ""), ("AddHealthChecks", "HealthCheck", "Health checks", ""),
    ("MapHealthChecks", "HealthCheck", "Health check endpoint", "endpoint"), ("UseSerilog", "Logging", "Serilog", "structured logging"), ("UseSerilogRequestLogging", "Logging", "Serilog request logging", "request logging"),
    ("AddAuditLog", "Logging", "Audit logging", "audit"), ("UseAuditMiddleware", "Logging", "Audit logging", "audit"), ("AddMassTransit", "Messaging", "MassTransit", "bus"), ("AddCap", "Messaging", "CAP (event bus)", "bus"),
    ("AddRabbitMQ", "Messaging", "RabbitMQ", "broker"), ("AddRabbitMq", "Messaging", "RabbitMQ", "broker"), ("AddServiceBus", "Messaging", "Azure Service Bus", "broker"),
    ("AddAzureServiceBus", "Messaging", "Azure Service Bus", "broker"), ("AddHangfire", "BackgroundJob", "Hangfire", "jobs"), ("AddQuartz", "BackgroundJob", "Quartz.NET", "scheduler"),
    ("AddPolicyHandler", "Resilience", "Polly resilience", "retry / circuit-breaker"), ("AddResilienceHandler", "Resilience", "Polly resilience", "retry / circuit-breaker"),
    ("AddStandardResilienceHandler", "Resilience", "Polly resilience", "retry / circuit-breaker"), ("UseAuthentication", "Middleware", "Authentication", ""), ("UseAuthorization", "Middleware", "Authorization", ""),
    ("UseExceptionHandler", "Middleware", "Global exception handling", ""), ("UseAuditMiddlewareGlobal", "Middleware", "Global exception handling", ""), ("UseRateLimiter", "Middleware", "Rate limiting", ""),
    ("UseResponseCompression", "Middleware", "Response compression", ""), ("UseHttpsRedirection", "Middleware", "HTTPS redirection", ""))


@extractor(SHARP)
def csharp_infrastructure(src: Sources) -> DataFrame:
    """What the framework's calls set up, with their order, first text and allowed origins; timers and hosted services as background jobs."""
    code = src.like(SHARP)
    table = src.files.sparkSession.createDataFrame(SETUP, "g1 string, kind_ string, name_ string, detail_ string")
    calls = occurrences(code, rf"\.((?:Add|Use|Map)\w+)(?:<[^>]*>)?\(({_NESTED})", 1, 2).join(F.broadcast(table), "g1")
    listed = F.flatten(F.transform(F.regexp_extract_all("g2", F.lit(r"\.WithOrigins\(([^()]*)\)"), 1), lambda o: F.regexp_extract_all(o, F.lit(r"\"([^\"]+)\""), 1)))
    origins = F.when(F.col("g1") != "AddCors", F.lit(None)).when(F.col("g2").contains("AllowAnyOrigin("), "any").otherwise(F.array_join(listed, ", "))
    said = dict(detail=F.col("detail_"), arg=F.regexp_extract("g2", r"^\s*\"([^\"]*)\"", 1))
    others = calls.where("kind_ not in ('Cors', 'Middleware')")
    declared = src.types
    timed = declared.where(F.exists("imports", lambda i: i.isin("System.Threading", "System.Timers")) | F.col("text").rlike(r"System\.(?:Threading|Timers)\.\w*Timer")).withColumnRenamed("name", "owner")
    timers = occurrences(timed, r"\bnew\s+(?:System\.(?:Threading|Timers)\.)?(PeriodicTimer|Timer)\s*\(", 1, keep=("owner",))
    return union(
        facts(others, F.col("kind_"), F.col("name_"), properties(**said), 0.8, tuple({k for _, k, _, _ in SETUP} - {"Cors", "Middleware"})), facts(calls.where("kind_ = 'Cors'"), "Cors", F.col("name_"), properties(**said, origins=origins), 0.8),
        facts(calls.where("kind_ = 'Middleware'"), "Middleware", F.col("name_"), properties(**said, order=F.col("line")), 0.8), facts(timers, "BackgroundJob", F.concat("owner", F.lit(" ("), "g1", F.lit(")")), properties(detail=F.lit("timer")), 0.6),
        facts(declared.where(_is_class() & any_base("BackgroundService", "IHostedService")), "BackgroundJob", F.col("name"), properties(detail=F.lit("hosted service")), 0.8))


@extractor(SHARP)
def csharp_policies(src: Sources) -> DataFrame:
    """Authorization policies with what they require."""
    rows = occurrences(src.like(SHARP), rf"\.AddPolicy\(\s*\"([^\"]+)\"\s*,\s*({_NESTED})", 1, 2).where(F.col("g2").rlike(r"\.Require|Requirements|Assertion"))
    need = F.transform(F.regexp_extract_all("g2", F.lit(r"\.(Require\w+\([^()]*\))"), 1), lambda r: F.regexp_replace(r, r"[\"\s]", ""))
    return facts(rows, "AuthorizationPolicy", F.col("g1"), properties(requirements=F.array_join(need, "; ")), 0.6)


@extractor(SHARP)
def csharp_configuration_usage(src: Sources) -> DataFrame:
    """Keys, environment variables and feature flags that the code reads by a literal name."""
    code = src.like(SHARP)
    keyed = occurrences(code, r"(?i:\b\w*(?:config|configuration)\w*)(?:\[|\.(?:GetValue(?:<[^>]*>)?|GetSection)\()\s*\"([^\"]+)\"", 1).withColumn("source", F.lit("IConfiguration"))
    environment = occurrences(code, r"\bEnvironment\.GetEnvironmentVariable\(\s*\"([^\"]+)\"", 1).withColumn("source", F.lit("EnvironmentVariable"))
    flags = occurrences(code, r"(?i:\b\w*feature\w*)\.IsEnabledAsync\(\s*\"([^\"]+)\"", 1).withColumn("source", F.lit("FeatureFlag"))
    return facts(union(keyed, environment, flags), "Configuration", F.col("g1"), properties(source=F.col("source")), 0.6)


#: The interfaces of filters and their kind.
FILTERS = {"authorization": ("IAuthorizationFilter", "IAsyncAuthorizationFilter"), "action": ("IActionFilter", "IAsyncActionFilter"), "exception": ("IExceptionFilter", "IAsyncExceptionFilter"), "result": ("IResultFilter", "IAsyncResultFilter"), "endpoint": ("IEndpointFilter",)}


@extractor(SHARP)
def csharp_filters(src: Sources) -> DataFrame:
    kind = F.coalesce(*[F.when(any_base(*names), k) for k, names in FILTERS.items()])
    rows = src.types.where(_is_class()).withColumn("kind_", kind).where("kind_ is not null")
    return facts(rows, "Filter", F.col("name"), properties(kind=F.col("kind_")), 0.8)


# ---- messages ------------------------------------------------------------------------------


@extractor(SHARP)
def csharp_cqrs(src: Sources) -> DataFrame:
    """Commands, queries, events and handlers by their contracts; a request's kind by name space, name, then by whether it has a result. HANDLES to messages in source."""
    declared = src.types.where(_is_class())
    n, space = F.col("name"), F.lower("namespace")
    requests = declared.withColumn("contract", the_base("IRequest")).where("contract is not null").withColumn("result", argument(F.col("contract")))
    no_result = F.col("result").isNull() | (F.col("result") == "Unit")
    kind = (F.when(space.contains("command"), "Command").when(space.contains("quer"), "Query").when(n.endswith("Command"), "Command").when(n.endswith("Query"), "Query").when(no_result, "Command").otherwise("Query"))
    events = declared.where(any_base("INotification"))
    category = F.when(space.contains("integration"), "Integration").when(space.contains("domain"), "Domain").when(n.endswith("IntegrationEvent"), "Integration").when(n.endswith("DomainEvent"), "Domain")
    handlers = declared.withColumn("contract", F.explode(F.filter("bases", lambda b: short(b).isin("IRequestHandler", "INotificationHandler")))).withColumn("message", argument(F.col("contract")))
    handlers = in_source(handlers, "message", src.known.where(_is_class()))
    return union(
        facts(requests, kind, n, properties(returns=F.when(~no_result, F.col("result"))), 0.7, ("Command", "Query")), facts(events, "Event", n, properties(category=category), 0.7),
        facts(handlers, "Handler", n, None, 0.7), facts(handlers, "HANDLES", F.col("message"), n, 0.75))


def dispatched(where: DataFrame, sender: str, src: Sources) -> DataFrame:
    """(path, line, sender, message): the requests and events in source that pieces of code send to a mediator, made on the spot or held in a variable."""
    sent = occurrences(where, r"(?i:\b_?\w*(?:mediator|sender|publisher)\w*)\.(?:Send|Publish)(?:Async)?\(\s*(?:new\s+(\w+)|(\w+)\s*[,)])", 1, 2, keep=(sender, "text"))
    made = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"\b"), "g2", F.lit(r"\s*=\s*new\s+(\w+)")), F.lit(1))
    named = sent.withColumn("message", F.when(F.col("g1") != "", F.col("g1")).otherwise(made))
    return in_source(named, "message", src.known.where(any_base("IRequest", "INotification"))).select("path", "line", sender, "message")


@extractor(SHARP)
def csharp_dispatches(src: Sources) -> DataFrame:
    """DISPATCHES: a type and the requests and events in source that it sends, made on the spot or held in a variable of the method."""
    declared = src.types
    where = methods(declared.where(_is_class())).select("path", "owner", "text", "from_line")
    return facts(dispatched(where, "owner", src), "DISPATCHES", F.col("message"), F.col("owner"), 0.6)


#: The libraries of message brokers, and how they publish, consume and mark what could not be delivered.
BROKERS = (
    ("Azure.Messaging.ServiceBus", "Azure Service Bus"), ("Amazon.SQS", "AWS SQS"), ("Amazon.SimpleNotificationService", "AWS SNS"), ("Confluent.Kafka", "Apache Kafka"), ("RabbitMQ", "RabbitMQ"),
    ("MassTransit", "MassTransit"), ("NServiceBus", "NServiceBus"), ("DotNetCore.CAP", "CAP"))
PUBLISHES = "BasicPublish|PublishAsync|Publish|SendMessagesAsync|SendMessageAsync|SendAsync|Send|ProduceAsync|Produce"
CONSUMES = "Consume|ReceiveMessageAsync|ReceiveMessagesAsync|StartProcessingAsync"
CONSUMERS = ("IConsumer", "IHandleMessages", "IMessageHandler", "IIntegrationEventHandler", "ICapSubscribe")
UNDELIVERED = "x-dead-letter|DeadLetter|RedrivePolicy|ConfigureDeadLetter|dead-letter"


def imports_of(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, rule columns): the files that import a name space beginning with a rule's ``space``.

    Names meet rules by equality of their dotted beginnings, so neither side is sent to all tasks.
    """
    each = files.where(F.col("path").rlike(SHARP)).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;"), 1)).alias("import"))
    parts = F.split("import", r"\.")
    begun = each.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("space"))
    return begun.join(rules, "space").drop("space").distinct()


@extractor(SHARP, tree=True)
def csharp_messaging(src: Sources) -> DataFrame:
    """Consumers, messages and brokers with PUBLISHES and CONSUMES; calls count only in files that import a broker's library, but for notifications."""
    declared = src.types
    brokers = imports_of(src.files, src.files.sparkSession.createDataFrame(BROKERS, "space string, broker string"))
    listening = declared.where(_is_class() & any_base(*CONSUMERS)).withColumn("message", argument(the_base(*CONSUMERS)))
    consumed = in_source(listening, "message", src.known)
    inside = declared.join(brokers.select("path").distinct(), "path", "left_semi").withColumnRenamed("name", "owner")
    sent = in_source(occurrences(inside, rf"\.(?:{PUBLISHES})(?:<[^>]*>)?\([^;]*?\bnew\s+(\w+)", 1, keep=("owner",)).withColumnRenamed("g1", "message"), "message", src.known)
    taken = first_by(occurrences(inside, rf"\.({CONSUMES})(?:<[^>]*>)?\(", 1, keep=("owner",)), ["path", "owner"], ["line"])
    notes = occurrences(declared.withColumnRenamed("name", "owner"), r"(?i:\b\w*(?:email|notif|mail)\w*)\.(\w*Send\w*)\(", 1, keep=("owner",))
    first = first_by(brokers, ["broker"], ["path"]).withColumn("line", F.lit(1))
    lost = src.like(SHARP).join(brokers.select("path").distinct(), "path", "left_semi").where(lexing.shown(F.col("text")).rlike(UNDELIVERED))
    lost = lost.agg(F.min("path").alias("path")).where("path is not null").withColumn("line", F.lit(1))
    return union(
        facts(listening, "Consumer", F.col("name"), None, 0.7), facts(consumed, "Message", F.col("message"), None, 0.65), facts(consumed, "CONSUMES", F.col("message"), F.col("name"), 0.7),
        facts(sent, "Message", F.col("message"), None, 0.6), facts(sent, "PUBLISHES", F.col("message"), F.col("owner"), 0.65), facts(taken, "Consumer", F.col("owner"), None, 0.6),
        facts(notes, "Message", F.col("g1"), properties(kind=F.lit("notification")), 0.55), facts(notes, "PUBLISHES", F.col("g1"), F.col("owner"), 0.55),
        facts(first, "MessageBroker", F.col("broker"), None, 0.8), facts(lost, "Messaging", F.lit("Dead-letter queue (DLQ)"), None, 0.7))


@extractor(SHARP)
def csharp_outbound(src: Sources) -> DataFrame:
    """Calls that go out by a client, by verb and literal address."""
    rows = occurrences(src.types.withColumnRenamed("name", "owner"), r"(?i:\b\w*(?:client|http)\w*)\.(Get|Post|Put|Delete|Patch)\w*Async(?:<[^>]*>)?\(\s*" + _STRING, 1, 2, keep=("owner",))
    return facts(rows, "OutboundCall", F.concat(F.upper("g1"), F.lit(" "), "g2"), properties(owner=F.col("owner"), verb=F.upper("g1"), route=F.col("g2")), 0.6)


# ---- rules ---------------------------------------------------------------------------------


@extractor(SHARP)
def csharp_business_rules(src: Sources) -> DataFrame:
    """Messages of exceptions that checking methods of services and managers throw."""
    owners = src.types.where(_is_class() & F.col("name").rlike("(?:Service|Manager)$"))
    checks = methods(owners).where(F.col("method").rlike("^(?:Validate|Check|Ensure)"))
    rows = occurrences(checks, rf"throw\s+new\s+(?:\w+\.)*(InvalidOperationException|ValidationException|ArgumentException)\([^;]*?\"([^\"]*)\"", 2, keep=("owner", "method"))
    return facts(rows, "BusinessRule", F.col("g1"), properties(owner=F.col("owner"), method=F.col("method")), 0.5)


@extractor(SHARP)
def csharp_audits(src: Sources) -> DataFrame:
    """What a class logs to something that audits, by the entity that the first literal names; each once for a class."""
    rows = occurrences(src.types.where(_is_class()).withColumnRenamed("name", "owner"), r"(?i:\b(\w*audit\w*))\.\w*Log\w*\([^();\"]*?" + _STRING, 2, keep=("owner",)).withColumnRenamed("g1", "entity")
    return facts(first_by(rows, ["path", "owner", "entity"], ["line"]), "AuditLog", F.concat("owner", F.lit(":"), "entity"), properties(entity=F.col("entity"), source=F.col("owner")), 0.6)


@extractor(SHARP)
def csharp_functions(src: Sources) -> DataFrame:
    rows = occurrences(src.like(SHARP), r"\[Function\((?:nameof\()?\"?([^\")]+)\"?\)+\][^;{]*?\[(\w+)Trigger\b", 1, 2)
    return facts(rows, "AzureFunction", F.col("g1"), properties(trigger=F.col("g2")), 0.8)


_RULE = rf"RuleFor\(\s*\w+\s*=>\s*\w+\.(\w+)\s*\)((?:\s*\.\w+(?:<[^>]*>)?\({_NESTED}\))+)"


@extractor(SHARP)
def csharp_validators(src: Sources) -> DataFrame:
    """Validators with the constraints of each field; VALIDATES to the type in source."""
    declared = src.types
    rows = declared.where(_is_class()).withColumn("contract", the_base("AbstractValidator")).where("contract is not null")
    step = r"\.(\w+)(?:<[^>]*>)?\(\s*(?:\"([^\"]*)\"|(-?[\d.]+|true|false))?"
    said = lambda chain: F.transform(
        F.arrays_zip(*[F.regexp_extract_all(chain, F.lit(step), g).alias(n) for g, n in ((1, "name"), (2, "text"), (3, "number"))]),
        lambda c: F.when(F.concat(c["text"], c["number"]) == "", c["name"]).otherwise(F.concat(c["name"], F.lit("("), c["text"], c["number"], F.lit(")"))))
    rules = F.zip_with(F.regexp_extract_all("text", F.lit(_RULE), 1), F.regexp_extract_all("text", F.lit(_RULE), 2), lambda f, chain: F.concat(f, F.lit(": "), F.array_join(said(chain), ", ")))
    checked = rows.withColumn("target", argument(F.col("contract")))
    return union(facts(rows, "Validator", F.col("name"), properties(rules=F.array_join(rules, "; ")), 0.8), facts(in_source(checked, "target", src.known), "VALIDATES", F.col("target"), F.col("name"), 0.8))


@extractor(SHARP)
def status_workflows(src: Sources) -> DataFrame:
    """Members called status or state that a class compares with two different literals at least, whatever their case, and these."""
    rows = occurrences(src.types.where(_is_class()).withColumnRenamed("name", "owner"), r"\b(\w*(?:Status|State))\s*==\s*" + _STRING, 1, 2, keep=("owner",)).where("g2 <> ''")
    each = rows.groupBy("path", "owner", "g1", F.lower("g2").alias("u")).agg(F.min("g2").alias("v"), F.min("line").alias("line"))
    g = each.groupBy("path", "owner", "g1").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.min("line").alias("line")).where(F.size("vs") >= 2)
    return facts(g, "StatusWorkflow", F.concat("owner", F.lit("."), "g1"), properties(values=F.array_join("vs", ", ")), 0.7)


# ---- endpoints -----------------------------------------------------------------------------


@extractor(SHARP)
def csharp_endpoints(src: Sources) -> DataFrame:
    """Endpoints of controllers' attributes and of mapped handlers, with what authorizes them; EXPOSES from the controller, DISPATCHES to the requests that they send."""
    declared = src.types.where(_is_class()).withColumn("template", F.nullif(F.regexp_extract("attributes", r'\[(?:[^\]]*,\s*)?Route\("([^"]*)"', 1), F.lit(""))).withColumn("guard", F.nullif(F.regexp_extract("attributes", r"\[(?:[^\]]*,\s*)?(Authorize(?:\([^)]*\))?|AllowAnonymous)", 1), F.lit("")))
    action = rf"(?m)^[ \t]*((?:{_BRACKETS})*?\[(?:[^\]\n]*,\s*)?Http(Get|Post|Put|Delete|Patch)(?:\(\s*\"([^\"]*)\"[^)\n]*\)|\([^)\]\n]*\))?[^\]\n]*\]\s*(?:{_BRACKETS})*)(?:(?:public|internal|async|virtual|override|static)\s+)+[\w.<>?\[\], ]+?\s+(\w+)\s*\(({_NESTED})\)"
    rows = occurrences(declared.withColumnRenamed("name", "owner"), action, 1, 2, 3, 4, 5, keep=("owner", "template", "guard"), rest=True)
    route = T.strip_constraints(T.resolve_route(F.col("owner"), F.col("template"), F.nullif(F.col("g3"), F.lit("")), F.col("g4")))
    own = F.nullif(F.regexp_extract("g1", r"\[(?:[^\]]*,\s*)?(Authorize(?:\([^)]*\))?|AllowAnonymous)", 1), F.lit(""))
    anonymous = F.when(F.col("g1").contains("AllowAnonymous"), "anonymous")
    auth = F.coalesce(anonymous, own, F.when(F.col("guard") == "AllowAnonymous", "anonymous").otherwise(F.col("guard")))
    given = F.regexp_replace(F.regexp_replace("g5", r"\[[^\]]*\]\s*", ""), r"\s+", " ")
    rows = rows.withColumn("route", route).withColumn("endpoint", F.concat(F.upper("g2"), F.lit(" "), "route")).withColumn("auth", auth)
    code = src.like(SHARP)
    groups = occurrences(code, r"\b(\w+)\s*=\s*(\w+)\.MapGroup\(\s*\"([^\"]*)\"", 1, 2, 3).select("path", F.col("g1").alias("receiver"), F.col("g2").alias("outer"), F.col("g3").alias("prefix"))
    outer = groups.select("path", F.col("receiver").alias("outer"), F.col("prefix").alias("before"))
    groups = first_by(groups.join(outer, ["path", "outer"], "left").select("path", "receiver", F.concat_ws("/", "before", "prefix").alias("prefix")), ["path", "receiver"], ["prefix"])
    mapped = occurrences(code, r"\b(\w+)\s*\.Map(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]*)\"", 1, 2, 3, rest=True).withColumnRenamed("g1", "receiver").join(groups, ["path", "receiver"], "left")
    path = T.strip_constraints(F.concat(F.lit("/"), T.combine_routes(F.coalesce("prefix", F.lit("")), F.col("g3"))))
    chained = F.regexp_extract("text", r"\.(RequireAuthorization|AllowAnonymous)\(", 1)
    ends = F.regexp_extract("text", rf"^({_NESTED}\)(?:\s*\.\w+(?:<[^>]*>)?\({_NESTED}\))*+)", 1)
    minimal = mapped.withColumn("text", ends).withColumn("route", path).withColumn("endpoint", F.concat(F.upper("g2"), F.lit(" "), "route")).withColumn("auth", F.when(chained == "AllowAnonymous", "anonymous").when(chained != "", "Authorize"))
    bodies = union(rows.select("path", "endpoint", "text", "from_line"), minimal.select("path", "endpoint", "text", "from_line"))
    return union(
        facts(dispatched(bodies, "endpoint", src), "DISPATCHES", F.col("message"), F.col("endpoint"), 0.6), facts(rows, "Endpoint", F.col("endpoint"), properties(verb=F.upper("g2"), route=F.col("route"), authorization=F.col("auth"), action=F.col("g4"), parameters=F.trim(given)), 0.7), facts(rows, "EXPOSES", F.col("endpoint"), F.col("owner"), 0.7),
        facts(minimal, "Endpoint", F.col("endpoint"), properties(verb=F.upper("g2"), route=F.col("route"), authorization=F.col("auth")), 0.6))


# ---- projects ------------------------------------------------------------------------------

#: Fragments of package names, the capability's category and its name; the first that fits counts.
CAPABILITIES = (
    ("Microsoft.AspNetCore", "Web / API", "ASP.NET Core"), ("Swashbuckle", "API Documentation", "Swagger / Swashbuckle"), ("Microsoft.AspNetCore.OpenApi", "API Documentation", "OpenAPI"),
    ("MediatR", "Application", "MediatR (CQRS/mediator)"), ("Dapper", "Data Access", "Dapper"), ("EntityFrameworkCore", "Data Access", "Entity Framework Core"), ("MongoDB.Driver", "Data Access", "MongoDB Driver"),
    ("Microsoft.Data.SqlClient", "Database", "SQL Server"), ("System.Data.SqlClient", "Database", "SQL Server"), ("Npgsql", "Database", "PostgreSQL"), ("Pomelo.EntityFrameworkCore.MySql", "Database", "MySQL"),
    ("Sqlite", "Database", "SQLite"), ("Microsoft.Azure.Cosmos", "Database", "Azure Cosmos DB"), ("Azure.Storage.Blobs", "Cloud Storage", "Azure Blob Storage"), ("Azure.Storage.Queues", "Messaging", "Azure Queue Storage"),
    ("AWSSDK.S3", "Cloud Storage", "AWS S3"), ("RabbitMQ.Client", "Messaging", "RabbitMQ"), ("MassTransit", "Messaging", "MassTransit"), ("Azure.Messaging.ServiceBus", "Messaging", "Azure Service Bus"),
    ("Confluent.Kafka", "Messaging", "Apache Kafka"), ("StackExchange.Redis", "Caching", "Redis"), ("Microsoft.Extensions.Caching", "Caching", "Distributed / in-memory cache"), ("Aspire", "Cloud", ".NET Aspire"),
    ("Azure.", "Cloud", "Azure SDK"), ("AWSSDK.", "Cloud", "AWS SDK"), ("Authentication.JwtBearer", "Authentication", "JWT Bearer authentication"), ("Microsoft.AspNetCore.Identity", "Authentication", "ASP.NET Core Identity"),
    ("IdentityServer", "Authentication", "Duende/IdentityServer"), ("OpenIdConnect", "Authentication", "OpenID Connect"), ("Microsoft.Identity.Web", "Authentication", "Microsoft Entra ID (Azure AD)"),
    ("Okta.AspNetCore", "Authentication", "Okta"), ("Auth0.AspNetCore.Authentication", "Authentication", "Auth0"), ("BCrypt", "Security", "BCrypt password hashing"), ("SemanticKernel", "AI / LLM", "Semantic Kernel"),
    ("Azure.AI", "AI / LLM", "Azure AI"), ("OpenAI", "AI / LLM", "OpenAI"), ("FluentValidation", "Validation", "FluentValidation"), ("AutoMapper", "Mapping", "AutoMapper"), ("Mapster", "Mapping", "Mapster"),
    ("Serilog", "Logging", "Serilog"), ("NLog", "Logging", "NLog"), ("Audit.NET", "Auditing", "Audit.NET"), ("AspNetCore.HealthChecks", "Observability", "HealthChecks"), ("OpenTelemetry", "Observability", "OpenTelemetry"),
    ("Polly", "Resilience", "Polly"), ("Hangfire", "Background Jobs", "Hangfire"), ("Quartz", "Background Jobs", "Quartz.NET"), ("NServiceBus", "Messaging", "NServiceBus"), ("Microsoft.FeatureManagement", "Configuration", "Feature Management"),
    ("blazor", "Frontend", "Blazor"), ("xunit", "Testing", "xUnit"), ("nunit", "Testing", "NUnit"), ("Moq", "Testing", "Moq"))


def capability_rules(spark) -> DataFrame:
    """(rule, fragment, category): the rules in order, the category with the capability's name."""
    return spark.createDataFrame([(i, f, f"{c}|{n}") for i, (f, c, n) in enumerate(CAPABILITIES)], "rule int, fragment string, category string")


#: What is read of a project file, whatever the order and quotes of its attributes.
_ITEM = "struct<_Include:string,_Version:string,Version:string,_Condition:string>"
PROJECT = f"_Sdk string, PropertyGroup array<struct<TargetFramework:string,TargetFrameworks:string,OutputType:string,_Condition:string>>, ItemGroup array<struct<_Condition:string,PackageReference:array<{_ITEM}>,ProjectReference:array<{_ITEM}>>>"


def holds(condition: Column) -> Column:
    """False for a condition of literals that does not hold; one that depends on a build's properties may."""
    equal = F.regexp_extract(condition, r"^\s*'([^'$]*)'\s*==\s*'([^'$]*)'\s*$", 1) == F.regexp_extract(condition, r"^\s*'([^'$]*)'\s*==\s*'([^'$]*)'\s*$", 2)
    literal = condition.rlike(r"^\s*'[^'$]*'\s*==\s*'[^'$]*'\s*$")
    return F.when(condition.isNull(), True).when(F.lower(F.trim(condition)) == "false", False).when(literal, equal).otherwise(True)


def _line_of(text: Column, name: Column) -> Column:
    """The line on which a quoted name stands first."""
    quoted = lambda q: F.instr(text, F.concat(F.lit(q), name, F.lit(q)))
    at = F.greatest(quoted('"'), quoted("'"), F.lit(1))
    return F.regexp_count(F.substr(text, F.lit(1), at), F.lit("\n")) + 1


@extractor(r"\.csproj$")
def packages(src: Sources) -> DataFrame:
    """Projects with their kind and framework, the technologies of their packages with versions, and references between projects."""
    proj = src.like(r"\.csproj$").select("path", "text", stem(F.col("path")).alias("project"), F.from_xml("text", PROJECT, {"mode": "PERMISSIVE"}).alias("x"))
    settings = F.filter("x.PropertyGroup", lambda g: holds(g["_Condition"]))
    first = lambda name: F.get(F.filter(F.transform(settings, lambda g: F.trim(g[name])), lambda v: v.isNotNull() & (v != "")), F.lit(0))

    def items(name: str) -> DataFrame:
        groups = F.transform(F.filter("x.ItemGroup", lambda g: holds(g["_Condition"])), lambda g: F.filter(F.coalesce(g[name], F.array().cast(f"array<{_ITEM}>")), lambda i: holds(i["_Condition"]) & i["_Include"].isNotNull()))
        return proj.select("path", "project", "text", F.explode(F.flatten(groups)).alias("i")).select("path", "project", F.col("i._Include").alias("include"), F.coalesce("i._Version", F.trim("i.Version")).alias("version"), _line_of(F.col("text"), F.col("i._Include")).alias("line"))

    refs = items("PackageReference")
    tested = refs.where(F.col("include").rlike(r"(?i)xunit|nunit|MSTest|Microsoft\.NET\.Test\.Sdk")).select("path", F.lit(True).alias("tested")).distinct()
    kind = F.when(F.col("tested"), "test").when(F.col("sdk").contains("Web"), "web").when(F.lower("output") == "exe", "executable").otherwise("library")
    projects = proj.select("path", "project", F.col("x._Sdk").alias("sdk"), first("OutputType").alias("output"), F.coalesce(first("TargetFramework"), first("TargetFrameworks")).alias("frame"), F.lit(1).alias("line")).join(tested, "path", "left")
    found = capability(refs.select(F.col("include").alias("name")).distinct(), capability_rules(src.files.sparkSession)).withColumnRenamed("name", "include")
    links = items("ProjectReference").withColumn("target", F.regexp_extract("include", r"([^\\/]+)\.csproj$", 1)).where("target <> '' and target <> project")
    return union(
        facts(projects, "Project", F.col("project"), properties(kind=kind, framework=F.col("frame")), 1.0),
        facts(refs.join(found, "include"), "Technology", F.substring_index("category", "|", -1), properties(category=F.substring_index("category", "|", 1), package=F.col("include"), version=F.col("version")), 1.0),
        facts(links, "REFERENCES", F.col("target"), F.col("project"), 1.0))


@extractor(SHARP, tree=True)
def technology_usage(src: Sources) -> DataFrame:
    """Technologies that files import and what their types call."""
    each = src.like(SHARP).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*using\s+([\w.]+)\s*;"), 1)).alias("name"))
    known = capability(each, capability_rules(src.files.sparkSession))
    tied = each.join(known, "name").select("path", "category").distinct()
    calls = occurrences(src.types.withColumnRenamed("name", "owner"), r"(?:\b|\))\.([A-Z]\w*)(?:<[^>()]*>)?\(", 1, keep=("owner",)).select("path", "owner", F.col("g1").alias("method")).distinct()
    listed = calls.join(tied, "path").groupBy("category", "owner").agg(F.min("path").alias("path"), F.array_sort(F.collect_set("method")).alias("ms"))
    listed = listed.select("category", "path", "owner", F.concat("owner", F.lit(" ("), F.array_join("ms", ", "), F.lit(")")).alias("used"))
    g = listed.groupBy("category").agg(F.min("path").alias("path"), F.array_sort(F.collect_list(F.struct("owner", "path", "used"))).alias("u"))
    usage = F.array_join(F.transform("u", lambda x: x["used"]), "; ")
    return facts(g.withColumn("line", F.lit(1)), "Technology", F.substring_index("category", "|", -1), properties(category=F.substring_index("category", "|", 1), usage=usage), 0.5)


EXTRACTORS = {x.name: x for x in (
    csharp_types, csharp_contracts, csharp_entities, csharp_data_contexts, csharp_migrations, csharp_database_operations, csharp_data_access, csharp_dependencies, csharp_registrations, csharp_program,
    csharp_infrastructure, csharp_policies, csharp_configuration_usage, csharp_filters, csharp_cqrs, csharp_dispatches, csharp_messaging, csharp_outbound, csharp_business_rules, csharp_audits, csharp_functions,
    csharp_validators, status_workflows, csharp_endpoints, packages, technology_usage)}
