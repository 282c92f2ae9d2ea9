"""Jaccard join of n-gram sets by vertical partitioning.

All n-grams have one global order, that of their scrambled hashes. Cuts of that order divide it into
fragments, and every document's set into segments, one for each fragment. Two sets of similarity p
per cent differ in at most (100 - p) / (100 + p) of their sizes' sum, so with more fragments than that
one segment at least is equal in both: (sizes' band, fragment, segment's hash) is the key at which
candidates meet, with no loss. A set whose n-grams fill too few fragments for that argument also has
keys for its empty segments, and two such sets differ in fewer fragments than there are.

Candidates are decided by counts: coarser cuts of the same order keep long sets in segments of
bounded size, what two documents share is counted apart for each segment and summed by pair.

Documents of equal sets are one class, which is what is joined. In large groups every class is compared
with one of them first, and after that only classes that no links have joined and that counts do
not rule out; the links that are left out this way join what is joined already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.components import SALTS, components
from lodestar.llm.neardup import PAIRS, _blocks, _words, possible_pairs
from lodestar.llm.shared import durable, few, mix64, read, small_batches, text_bytes

WORDS = 3
PERCENT = 90
#: Sizes of one band share their fragments; the largest is at most so many times the least.
BAND = 1.5
#: Fragments for each n-gram that may differ.
SPARE = 1.25
#: n-grams of a segment that is counted, on average, at most.
SEGMENT_BITS = 12
_U = np.uint64


def ngrams(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The different n-grams of a text's word hashes in the global order, fewer words being one n-gram."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = mix64((h + words[k : len(words) - n + 1 + k]) * _U(0x9E3779B97F4A7C15))
    return np.unique(h)


class Fragments:
    """How sets of each size are cut so that similar ones share a segment."""

    def __init__(self, percent: int = PERCENT) -> None:
        if not 50 <= percent < 100:
            raise ValueError("similarity is from 50 to 99 per cent")
        self.percent, self.bits = percent, SEGMENT_BITS
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))

    def partner(self, size: int) -> int:
        """The largest size of a set similar to one of this size."""
        return size * 100 // self.percent

    def differing(self, sizes: int) -> int:
        """How many n-grams similar sets of these sizes in all can differ in."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def fragments(self, band: int) -> int:
        most = self.differing(2 * (self.edges[band + 1] - 1))
        return max(most + 2, int(np.ceil(SPARE * most)))

    def segments(self, size: int) -> int:
        """Into how many segments sets are cut to be counted, where the larger one has this size."""
        return 1 << ((max(size, 1) - 1) >> self.bits).bit_length()

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """The keys of one set; none if only equal sets are similar to it."""
        size = len(grams)
        if not size or not self.differing(size + self.partner(size)):
            return np.zeros(0, dtype=np.int64)
        sums = np.concatenate([[_U(0)], np.cumsum(mix64(grams + _U(1)))])
        out = []
        for band in range(self.band(size), self.band(self.partner(size)) + 1):
            count = self.fragments(band)
            cuts = np.searchsorted(grams, np.array([f * (1 << 64) // count for f in range(1, count)], dtype=np.uint64))
            ends = np.concatenate([[0], cuts, [size]])
            names = mix64(np.arange(count, dtype=np.uint64) + _U(band << 40) + _U(1))
            keys = mix64(names + sums[ends[1:]] - sums[ends[:-1]])
            full = ends[1:] > ends[:-1]
            enough = full.sum() > self.differing(size + min(self.partner(size), self.edges[band + 1] - 1))
            out.append(keys[full] if enough else keys)
        return np.concatenate(out).view(np.int64)


def _segments_column(size: Column, bits: int) -> Column:
    many = F.shiftright(size - 1, bits)
    return F.when(many <= 0, F.lit(1)).otherwise(F.pow(F.lit(2), F.length(F.bin(many))).cast("int"))


def _class_of(grams: np.ndarray) -> int | None:
    """The name of a set's class; empty sets have none."""
    return int(np.int64(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63))) if len(grams) else None


def _sets(texts: list[bytes]):
    for a, b in _blocks(texts):
        yield a, b, [ngrams(w) for w, _ in _words([t.lower() for t in texts[a:b]])]


def _describe(cut: Fragments):
    def run(batches):
        for batch in batches:
            for a, b, every in _sets(text_bytes(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([_class_of(g) for g in every], pa.int64()), pa.array([len(g) for g in every], pa.int64()), pa.array([cut.keys(g).tobytes() for g in every], pa.binary())], names=["doc", "class", "size", "keys"])
    return run


def _unpack(batches):
    for batch in batches:
        own, sizes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        packed = [np.frombuffer(k, dtype=np.int64) for k in batch.column(2).to_pylist()]
        for at in range(0, len(packed), 500):
            many = [len(x) for x in packed[at : at + 500]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(packed[at : at + 500])), pa.array(np.repeat(own[at : at + 500], many)), pa.array(np.repeat(sizes[at : at + 500], many))], names=["key", "doc", "size"])


def _store(batches):
    for batch in batches:
        for _, _, every in _sets(text_bytes(batch.column(0))):
            every = [g for g in every if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(g) for g in every], pa.int64()), pa.array([g.tobytes() for g in every], pa.binary())], names=["doc", "grams"])


def _cut(cut: Fragments):
    """Segments (doc, cuts, part, grams) of each set, for every number of cuts that a pair of it can have."""
    def run(batches):
        for batch in batches:
            doc, cuts, part, grams = [], [], [], []
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(packed, dtype=np.uint64)
                for n in sorted({cut.segments(s) for s in range(len(x), cut.partner(len(x)) + 1, max(len(x) // 8, 1))} | {cut.segments(cut.partner(len(x)))}):
                    ends = np.searchsorted(x, np.array([p * ((1 << 64) // n) for p in range(1, n)], dtype=np.uint64))
                    for p, piece in enumerate(np.split(x, ends)):
                        if len(piece):
                            doc.append(own), cuts.append(n), part.append(p), grams.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(cuts, pa.int32()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())], names=["doc", "cuts", "part", "grams"])
    return run


def _count(batches):
    for batch in batches:
        a, b, sizes, one, two = (c.to_pylist() for c in batch.columns)
        shared = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(one, two)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shared, pa.int64())], names=["a", "b", "sizes", "shared"])


def _short(batches):
    """Sets of 32 bits a gram, for the bounds of ``possible_pairs``."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(np.frombuffer(x, np.uint64) >> _U(32)).astype(np.uint32).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["doc", "set"])


def similar_pairs(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs(a, b, size_a, size_b)`` that share enough, counted segment by segment and summed."""
    one = segments.select(F.col("doc").alias("a"), "cuts", "part", F.col("grams").alias("one"))
    two = segments.select(F.col("doc").alias("b"), "cuts", "part", F.col("grams").alias("two"))
    asked = pairs.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), _segments_column(F.greatest("size_a", "size_b"), SEGMENT_BITS).cast("int").alias("cuts")).distinct()
    met = asked.hint("merge").join(one, ["a", "cuts"]).hint("merge").join(two, ["b", "cuts", "part"])
    partial = met.select("a", "b", "sizes", "one", "two").mapInArrow(_count, "a long, b long, sizes long, shared long")
    summed = partial.groupBy("a", "b", "sizes").agg(F.sum("shared").alias("shared"))
    return summed.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")


def class_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) that join what all links between classes join; ``members(key, doc, size)`` are keys that classes meet at, None if nothing is similar."""
    cut, similar = Fragments(percent), percent / 100
    segments = durable(sets.mapInArrow(_cut(cut), "doc long, cuts int, part int, grams binary"))
    near = None

    def decided(pairs: DataFrame) -> DataFrame:
        found = durable(similar_pairs(pairs, segments, percent))
        return found if near is None else durable(near.union(found))

    def apart(rows: DataFrame) -> DataFrame:
        if near is None:
            return rows.withColumn("root", F.col("doc"))
        told = durable(components(near))
        rooted = durable(rows.hint("merge").join(told.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")))
        still = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
        return durable(rooted.hint("merge").join(still, "key", "left_semi"))

    crowded = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS).select("key")
    large = apart(durable(members.hint("merge").join(crowded, "key", "left_semi")))
    if not large.isEmpty():
        often = large.groupBy("doc").agg(F.count("*").alias("often"))
        centres = large.hint("merge").join(often, "doc").groupBy("key").agg(F.max(F.struct("often", F.col("doc").alias("b"), F.col("size").alias("size_b"))).alias("x")).select("key", "x.b", "x.size_b")
        may = (F.col("doc") != F.col("b")) & (100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b"))
        near = decided(large.hint("merge").join(centres, "key").where(may).select(F.col("doc").alias("a"), "b", F.col("size").alias("size_a"), "size_b"))
    left = apart(members)
    if not left.isEmpty():
        size = left.select("doc", "size").distinct()
        pairs = possible_pairs(left, sets.mapInArrow(_short, "doc long, set binary"), similar)
        pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        pairs = pairs.hint("merge").join(size.select(F.col("doc").alias("a"), F.col("size").alias("size_a")), "a").hint("merge").join(size.select(F.col("doc").alias("b"), F.col("size").alias("size_b")), "b")
        near = decided(pairs)
    return near


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Texts link whose sets of different 3-word shingles (fewer words: the whole sequence) have a
    Jaccard similarity of ``percent`` or more. Null texts and texts without words have empty sets and link
    with nothing. Rows without doc_id link with nothing either and have no component; rows of one
    doc_id are one document, which has the links of each. Other columns are not read. An empty table
    gives an empty result.
    """
    with small_batches(docs.sparkSession, 500):
        return _linked(docs, percent)


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    told = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    described = durable(told.mapInArrow(_describe(Fragments(percent)), "doc long, class long, size long, keys binary"))
    known = described.where("doc is not null").select("doc", "class", "size")
    keyed = described.where("doc is not null and length(keys) > 0").select("class", "size", "keys").mapInArrow(_unpack, "key long, doc long, size long")
    met = keyed.groupBy("key").agg(F.min("doc").alias("c1"), F.max("doc").alias("c2")).where("c1 <> c2").select("key")
    members = durable(keyed.hint("merge").join(met, "key", "left_semi").distinct())
    classes = durable(known.where("class is not null").groupBy("class").agg(F.min("doc").alias("first")))
    wanted = members.select(F.col("doc").alias("class")).distinct().join(classes, "class").select(F.col("first").alias("doc")).distinct()
    sets = durable(told.join(few(durable(wanted)), "doc", "left_semi").select("text").mapInArrow(_store, "doc long, grams binary").dropDuplicates(["doc"]))
    near = class_links(members, sets, percent)
    several = known.where("class is not null").groupBy("doc").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.collect_set("class").alias("all")).where("a <> b")
    links = several.select("a", F.explode("all").alias("b"))  # rows of one doc_id
    roots = durable(components(links if near is None else links.union(near)))
    rooted = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = durable(rooted.join(least, "root").select("class", "component_id"))
    salted = described.drop("keys").withColumn("salt", F.when(F.col("doc").isNotNull(), F.pmod(F.xxhash64("doc"), F.lit(SALTS))))
    parts = salted.where("class is not null and doc is not null").select("class", "salt").distinct().hint("merge").join(named, "class")
    out = salted.hint("merge").join(parts, ["class", "salt"], "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive
word as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingle as (
  select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] end)) as s
  from word),
size as (select doc_id, count(*) as n from shingle group by 1),
pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id
  group by 1, 2),
link as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
both_ways as (select a, b from link union all select b, a from link),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)
select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id
from documents d left join size using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by 1) c using (doc_id)
"""
