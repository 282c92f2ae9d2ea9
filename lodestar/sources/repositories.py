"""Repositories as tables: locations, files, artifacts and their technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = r"(^|/)(bin|obj|node_modules|\.next|dist|build)/"
NO_SOURCE = r"(\.d\.ts|\.(spec|test)\.[jt]sx?|\.config\.m?js)$"


def branch_of(location: Column) -> Column:
    """What follows the last #, null without one."""
    return F.when(location.contains("#"), F.substring_index(location, "#", -1))


def is_git_url(location: Column) -> Column:
    return location.rlike(r"(?i)^(https?://|git@)|\.git$")


def repository_name(location: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(location, "#[^#]*$", ""), "/+$", ""), r"\.git$", "")
    name = F.element_at(F.split(bare, "[/\\\\]"), -1)
    return F.when(F.trim(name) == "", "repo").otherwise(name)


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text): whole files below ``root``, build output left out; read in parallel, never on the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    short = F.regexp_replace("path", r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(short.alias("path"), F.decode("content", "UTF-8").alias("text")).where(~F.col("path").rlike(EXCLUDED))


def sources(files: DataFrame) -> DataFrame:
    """The script sources among ``files``."""
    return files.where(F.col("path").rlike(r"\.(tsx?|jsx?|component\.html)$") & ~F.col("path").rlike(NO_SOURCE))


def solution_projects(files: DataFrame) -> DataFrame:
    """(path): project paths named by any solution file, text or XML."""
    text = files.where(F.col("path").rlike(r"\.slnx?$"))
    named = text.select(F.regexp_replace("path", "[^/]*$", "").alias("dir"), F.explode(F.regexp_extract_all("text", F.lit(r'"([^"]+\.csproj)"'), 1)).alias("project"))
    return named.select(F.concat("dir", F.replace(F.col("project"), F.lit("\\"), F.lit("/"))).alias("path")).distinct()


def artifacts(files: DataFrame) -> DataFrame:
    """(path, technology, name): project roots by their marker files. A .NET project outside every solution is
    left out if there is a solution at all; a package with a Next configuration beside it is no plain React one."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    marked = files.select("path", "text", name.alias("file"), folder.alias("dir"))
    scoped = solution_projects(files)
    any_solution = files.where(F.col("path").rlike(r"\.slnx?$")).limit(1).select(F.lit(True).alias("has"))
    dotnet = marked.where(F.col("file").rlike(r"\.csproj$")).join(scoped.withColumn("in_", F.lit(True)), "path", "left").join(any_solution, F.lit(True), "left").where("has is null or in_")
    dotnet = dotnet.select("path", F.lit("dotnet").alias("technology"), F.regexp_replace("file", r"\.csproj$", "").alias("name"))
    angular = marked.where("file = 'angular.json'").select("path", F.lit("angular").alias("technology"), F.col("dir").alias("name"))
    nexts = marked.where(F.col("file").rlike(r"^next\.config\.(js|mjs|ts)$")).select("path", F.lit("nextjs").alias("technology"), F.col("dir").alias("name"))
    react = marked.where((F.col("file") == "package.json") & F.col("text").rlike('"react"')).join(nexts.select(F.col("name").alias("dir")).distinct(), "dir", "left_anti").select("path", F.lit("react").alias("technology"), F.col("dir").alias("name"))
    security = marked.where(F.col("file").rlike(r"\.csproj$|^package\.json$")).select("path", F.lit("security").alias("technology"), F.col("dir").alias("name"))
    return dotnet.unionByName(angular).unionByName(nexts).unionByName(react).unionByName(security)


def notes(files: DataFrame, most: int = 65536) -> DataFrame:
    """The first of README.md and CLAUDE.md at the root, cut to ``most`` characters with a marker."""
    names = ["README.md", "CLAUDE.md"]
    found = files.where(F.col("path").isin(names)).agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("path")).alias("rank"), "path", "text")).alias("r"))
    return found.where("r is not null").select("r.path", F.when(F.length("r.text") > most, F.concat(F.substring("r.text", 1, most), F.lit("\n…"))).otherwise(F.col("r.text")).alias("text"))


def commit_or_working_copy(commit: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(commit), F.lit("")), F.lit("workingcopy"))
