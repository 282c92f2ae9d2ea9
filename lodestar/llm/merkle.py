"""A Merkle manifest of a data set: exact ranks by radix histograms, trie nodes by rank digits.

Ranks need no global sort. Keys are cut into digits of ``DIGIT_BITS`` bits; counts of rows by prefix
are summed into counts by shorter prefixes, and going down again every prefix learns how many rows
stand before it. Only rows that share all digits but the last are ordered, at most
``2 ** DIGIT_BITS`` different keys in one partition.

A node of the trie is named by its group and its rank without the last digits in base ``fanout``.
Steps reduce all nodes that share their longest prefix but ``span`` of them at a time, so a step
is one shuffle by (group, prefix), no partition holds more than ``span`` nodes, and the number of
steps grows with the logarithm of the largest group to the base ``span``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import durable, read, scratch

DIGIT_BITS = 10
#: At most so many nodes are reduced in one group.
SPAN = 1024
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The bucket of rows without doc_id, below every doc_id's.
_NO_KEY = -(1 << (64 - DIGIT_BITS)) - 1
_NODES = "g string, pos long, size long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[_field(n_chars if name == "n_chars" else F.col(name)) for name in _FIELDS]).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the check adds one to this row's n_chars; rows without doc_id are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, told): the group's key, which orders null first, the row's digest and that of the tampered row."""
    told = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), _leaf(F.col("n_chars") + 1))
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("n_chars")).alias("leaf"), told.alias("told"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows(g, doc_id, leaf, ...)`` with ``pos``, the exact rank within g by doc_id and leaf from zero, and ``size``, the rows of g.

    Rows without doc_id come first; equal rows take consecutive ranks in any order.
    """
    rows = rows.withColumn("d0", F.coalesce(F.shiftright("doc_id", DIGIT_BITS), F.lit(_NO_KEY)))
    levels = [durable(rows.groupBy("g", "d0").agg(F.count("*").alias("n")))]
    ends = levels[0].agg(F.min("d0").alias("low"), F.max("d0").alias("high")).first()
    low, high = ends.low or 0, ends.high or 0
    while high - low >> DIGIT_BITS:
        k, low, high = len(levels), low >> DIGIT_BITS, high >> DIGIT_BITS
        levels.append(durable(levels[-1].withColumn(f"d{k}", F.shiftright(f"d{k - 1}", DIGIT_BITS)).groupBy("g", f"d{k}").agg(F.sum("n").alias("n"))))
    top = len(levels) - 1
    whole = Window.partitionBy("g")
    before = F.sum("n").over(whole.orderBy(f"d{top}").rowsBetween(Window.unboundedPreceding, -1))
    starts = levels[top].select("g", f"d{top}", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(whole).alias("size"))
    for k in range(top - 1, -1, -1):
        inside = Window.partitionBy("g", f"d{k + 1}").orderBy(f"d{k}").rowsBetween(Window.unboundedPreceding, -1)
        local = levels[k].withColumn(f"d{k + 1}", F.shiftright(f"d{k}", DIGIT_BITS)).withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        starts = local.join(starts, ["g", f"d{k + 1}"]).select("g", f"d{k}", (F.col("start") + F.col("local")).alias("start"), "size")
    order = Window.partitionBy("g", "d0").orderBy(F.col("doc_id").asc_nulls_first(), "leaf")
    placed = rows.withColumn("place", F.row_number().over(order)).hint("merge").join(starts, ["g", "d0"])
    return placed.withColumn("pos", F.col("start") + F.col("place") - 1).drop("d0", "start", "place")


def depth(nodes: int, fanout: int) -> int:
    """Levels from so many nodes to one."""
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // fanout), out + 1
    return out


def reduce(nodes: list[str], levels: int, fanout: int) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """(what is left after so many levels, for each node its siblings' digests before and after it level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    for _ in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, path in enumerate(paths):
            run, k = runs[at[i] // fanout], at[i] % fanout
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] //= fanout
        nodes = [digest("".join(run)) for run in runs]
    return nodes, paths


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


class Trie:
    """Trees of ``fanout`` over the ranks of groups, ``digits`` levels a step."""

    def __init__(self, fanout: int = 2, span: int = SPAN) -> None:
        if fanout < 2 or span < fanout:
            raise ValueError("a node has two children at least, and a step reduces one node's children at least")
        self.fanout, self.digits = fanout, 1
        while fanout ** (self.digits + 1) <= span:
            self.digits += 1
        self.span = fanout**self.digits

    def _levels(self, size: int) -> int:
        return self.digits if size > self.span else depth(size, self.fanout)

    def _grouped(self, nodes: DataFrame, *more: str) -> DataFrame:
        return nodes.groupBy("g", F.floor(F.col("pos") / self.span).alias("up"), "size").agg(F.sort_array(F.collect_list(F.struct("pos", *more))).alias("rows"))

    def step(self, nodes: DataFrame) -> DataFrame:
        """The nodes that ``span`` neighbours become; groups of one node stay as they are."""
        def run(batches):
            for batch in batches:
                g, up, size, rows = (c.to_pylist() for c in batch.columns)
                made = [reduce([r["digest"] for r in group], self._levels(n), self.fanout)[0][0] for n, group in zip(size, rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-n // self.span) for n in size], pa.int64()), pa.array(made, pa.string())], names=["g", "pos", "size", "digest"])

        return self._grouped(nodes, "digest").mapInArrow(run, _NODES)

    def steps(self, nodes: DataFrame) -> list[DataFrame]:
        """``nodes`` and all that steps make of them, up to one node a group."""
        out, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
        while most > 1:
            out.append(durable(self.step(out[-1])))
            most = -(-most // self.span)
        return out

    def paths(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """(g, pos, path): each node's siblings up to the end of the path of the node above, (g, pos, path) in ``above``."""
        def run(batches):
            for batch in batches:
                for g, up, size, rows, rest in zip(*(c.to_pylist() for c in batch.columns)):
                    own = reduce([r["digest"] for r in rows], self._levels(size), self.fanout)[1]
                    ends = [(x["before"], x["after"]) for x in rest]
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(rows), pa.string()), pa.array([r["pos"] for r in rows], pa.int64()), _path_array([p + ends for p in own])], names=["g", "pos", "path"])

        met = self._grouped(nodes, "digest").join(above.withColumnRenamed("pos", "up"), ["g", "up"]).select("g", "up", "size", "rows", "path")
        return met.mapInArrow(run, f"g string, pos long, path {_PATH}")

    def proofs(self, rows: DataFrame, above: DataFrame) -> DataFrame:
        """The result for every leaf row (g, pos, size, digest, doc_id, told), from the paths, subroot and root of the nodes above."""
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

        def run(batches):
            for batch in batches:
                for g, up, size, group, rest, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                    own = reduce([r["digest"] for r in group], self._levels(size), self.fanout)[1]
                    ends, out = [(x["before"], x["after"]) for x in rest], []
                    for r, path in zip(group, own):
                        path = path + ends
                        folded = fold(r["told"] or r["digest"], path)
                        out.append((r["doc_id"], r["digest"], subroot, root, digest("".join(b + a for b, a in path)), folded, folded == root))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string()) for n, c in zip(names, zip(*out))], names=names)

        met = self._grouped(rows, "digest", "doc_id", "told").join(above.withColumnRenamed("pos", "up"), ["g", "up"]).select("g", "up", "size", "rows", "path", "subroot", "root")
        return met.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_PATH = "array<struct<before: string, after: string>>"


def _path_array(paths: list) -> pa.Array:
    return pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))


def manifest(docs: DataFrame, fanout: int = 2, span: int = SPAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A row is a leaf of its lang's tree, whose root is a leaf of the tree over langs. Null columns
    are leaves' contents like others; a null lang is a lang, before all others; rows without doc_id
    stand before the others of their lang and are not tampered with; rows of one doc_id are ordered
    by their digest, so the order of repeated rows does not show. Other columns are not read. An
    empty table gives an empty result. Langs are taken to be few: their order is one sort of one row
    for each.
    """
    spark, trie = docs.sparkSession, Trie(fanout, span)
    folder = scratch(spark, "leaves")
    leaves(docs).write.parquet(folder)
    placed = scratch(spark, "ranked")
    ranked(spark.read.parquet(folder)).select("g", "pos", "size", F.col("leaf").alias("digest"), "doc_id", "told").write.parquet(placed)
    rows = spark.read.parquet(placed)
    below = trie.steps(rows.select("g", "pos", "size", "digest"))
    subroots = below[-1].where("pos = 0") if len(below) > 1 else rows.select("g", "pos", "size", "digest")
    everyone = Window.partitionBy(F.lit(1))
    langs = durable(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), (F.row_number().over(everyone.orderBy(F.col("g").cast("binary"))) - 1).cast("long").alias("pos"), F.count("*").over(everyone).alias("size"), "digest"))
    above = trie.steps(langs.select("g", "pos", "size", "digest"))
    root = above[-1].select(F.col("g").alias("top"), F.col("digest").alias("root"))
    path = above[-1].select("g", "pos", F.array().cast(_PATH).alias("path"))
    for nodes in reversed(above[:-1]):
        path = trie.paths(nodes, path)
    own = langs.select("pos", F.col("g").alias("top"), F.col("lang").alias("g"), F.col("digest").alias("subroot")).join(path.drop("g"), "pos").join(root, "top")
    own = durable(own.select("g", "path", "subroot", "root"))
    path = own.select("g", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(below[1:-1]):
        path = trie.paths(nodes, path)
    return trie.proofs(rows, path.join(own.select("g", "subroot", "root"), "g"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


OP11_SQL = """
with recursive
crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
told as (
  select doc_id, lang, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) as hit
  from documents, crc),
leaf as (
  select doc_id, lang,
    sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as h,
    case when hit then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as bad
  from told),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by lang) as n from leaf),
node(lang, level, pos, n, h) as (
  select lang, 0, pos, n, h from placed
  union all
  select lang, level + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(next, '')) from (select *, lead(h) over (partition by lang order by pos) as next from node where n > 1) where pos % 2 = 0),
langs as (select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n, level as depth from node where n = 1),
up(level, pos, n, h) as (
  select 0, pos, n, h from langs
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(next, '')) from (select *, lead(h) over (order by pos) as next from up where n > 1) where pos % 2 = 0),
steps as (
  select p.lang, p.doc_id, p.pos as leaf_pos, x.level as step, coalesce(case when s.pos < x.pos then '<' else '>' end || s.h, '') as sibling
  from placed p join node x on x.lang is not distinct from p.lang and x.pos = p.pos >> x.level and x.n > 1
  left join node s on s.lang is not distinct from x.lang and s.level = x.level and s.pos = xor(x.pos, 1)),
upsteps as (
  select l.lang, x.level as step, coalesce(case when s.pos < x.pos then '<' else '>' end || s.h, '') as sibling
  from langs l join up x on x.pos = l.pos >> x.level and x.n > 1 left join up s on s.level = x.level and s.pos = xor(x.pos, 1)),
own as (select lang, leaf_pos, list(sibling order by step) as path from steps group by 1, 2),
upper as (select lang, list(sibling order by step) as path from upsteps group by 1),
full_path as (
  select p.doc_id, p.h, p.bad, l.h as subroot, list_concat(coalesce(o.path, []), coalesce(u.path, [])) as path
  from placed p join langs l on l.lang is not distinct from p.lang
  left join own o on o.lang is not distinct from p.lang and o.leaf_pos = p.pos left join upper u on u.lang is not distinct from p.lang),
folded as (
  select doc_id, h as leaf, subroot, (select h from up where n = 1) as root, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) as proof_sha256,
    list_reduce(list_concat([coalesce(bad, h)], path), lambda a, s: sha256(case when s[1] = '<' then substr(s, 2) || a when s[1] = '>' then a || substr(s, 2) else a end)) as folded_root
  from full_path)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""
