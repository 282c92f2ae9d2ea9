"""Near-duplicate removal by Golay-code fuzzy hashing with exact verification.

Texts are compared as lower-case words. Equal word sequences are collapsed first. The others get
``TABLES`` fingerprints of 23 bits over their five-word shingles, as many as the perfect Golay code has: each bit
is one of the least shingle of an order of its own, so two texts of Jaccard similarity s differ in (1 - s) / 2 of them,
whatever their words are, where the bits of a SimHash at 0.8 would differ in a sixth.
A bucket key is a codeword index of a fingerprint (``simhash.golay_keys``: fingerprints at most two bits apart share one)
with the least shingles of ``WHOLE`` more orders, which keep texts apart that share a common passage.
Two texts share a key of a table with probability 0.515 at 0.8, and none in ``TABLES`` with 0.00001, less above. Links are verified by the exact Jaccard similarity
of five-word shingles. In large buckets one member
is verified against all others first: the one that is in the most large buckets, which is where the
text that others were made from stands. After that, pairs of a bucket whose documents no links have
joined are verified, in small buckets and large ones alike; nothing leaves a bucket before. Pairs
that cannot be similar are no candidates: sizes bound the similarity, and so do counts of shingles
in parts, less those that no other document has. Partners meet by bucket and size, so an edited copy
without a possible partner meets nobody, however large its bucket. So a large group lists few of its
pairs, and two similar texts that meet in a bucket are always in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import SALTS, components
from lodestar.llm.kneser_ney import word_hashes
from lodestar.llm.shared import IS_SPACE, durable, mix64, small_batches
from lodestar.llm.simhash import golay_keys

WORDS = 5
SIMILAR = 0.8
TABLES = 16
BITS = 23
WHOLE = 2
#: Buckets of more members are compared with one of them first.
PAIRS = 16
#: Sizes of possible partners are matched in steps of this ratio.
STEP = 1.05
#: Parts that the shingles are counted in, for a bound on what two sets share.
PARTS = 64
_U = np.uint64
#: Words of texts are hashed for so many bytes at a time.
BLOCK = 1 << 20
#: Rows that a Python worker gets at once.
BATCH_ROWS = 500


def _words(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hashes and sizes of every lower-case text's words."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    inside = np.concatenate([[False], ~IS_SPACE[data]])
    edge = np.nonzero(inside[1:] != inside[:-1])[0]
    start, stop = edge[0::2], edge[1::2]
    h = word_hashes(data, start, stop - start)
    cut = np.searchsorted(start, np.cumsum(sizes))
    return list(zip(np.split(h, cut[:-1]), np.split(stop - start, cut[:-1])))


def _blocks(texts: list[bytes]):
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end


#: Odd factors that reorder scrambled hashes: of each table one for each bit, and WHOLE more.
_FACTORS = (mix64(np.arange(1, TABLES * (BITS + WHOLE) + 1, dtype=np.uint64)) | _U(1)).reshape(TABLES, BITS + WHOLE)


def fingerprints(every: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, TABLES) twice: the fingerprints of each text's shingle hashes, of which it has one at least, and the hashes of the minima that go with them."""
    x = mix64(np.concatenate(every))
    first = np.concatenate([[0], np.cumsum([len(h) for h in every])[:-1]])
    words, minima = np.zeros((2, len(every), TABLES), dtype=np.uint64)
    for table, factors in enumerate(_FACTORS):
        minima[:, table] = table
        for f in factors[BITS:]:
            minima[:, table] = mix64(minima[:, table] ^ np.minimum.reduceat(x * f, first))
        for bit, f in enumerate(factors[:BITS]):
            words[:, table] |= (mix64(np.minimum.reduceat(x * f, first)) >> _U(63)) << _U(bit)
    return words, minima


def keys_of(every: list[np.ndarray]) -> list[np.ndarray]:
    """The different bucket keys of each text's shingle hashes, of which it has one at least."""
    words, minima = fingerprints(every)
    row, index = golay_keys(words.ravel())
    keys = mix64(minima.ravel()[row] ^ index)
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(1, len(every)) * TABLES)
    return np.split(keys[order].view(np.int64), ends)


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The 32-bit hashes of all n-word shingles (fewer words: the whole sequence), as they follow."""
    if not len(words):
        return np.zeros(0, dtype=np.uint32)
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h + words[k : len(words) - n + 1 + k]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return (mix64(h) >> _U(32)).astype(np.uint32)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted different shingle hashes."""
    return np.unique(shingle_hashes(words, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _describe(batches):
    """(doc, same, keys): the 128-bit hash of the word sequence, and the packed keys."""
    for batch in batches:
        texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
        for a, b in _blocks(texts):
            every = [shingle_hashes(w) for w, _ in _words(texts[a:b])]
            some = [h for h in every if len(h)]
            rows = iter(keys_of(some) if some else ())
            keys = [next(rows).tobytes() if len(h) else b"" for h in every]
            same = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(same, type=pa.binary()), pa.array(keys, type=pa.binary())], names=["doc", "same", "keys"])


def _unpack_keys(batches):
    for batch in batches:
        docs, packed = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for at in range(0, len(packed), 2000):
            lists = [np.frombuffer(k, dtype=np.int64) for k in packed[at : at + 2000]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(docs[at : at + 2000], [len(x) for x in lists]))], names=["key", "doc"])


def _shingle_sets(batches):
    for batch in batches:
        texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
        for a, b in _blocks(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([shingles(w).tobytes() for w, _ in _words(texts[a:b])], type=pa.binary())], names=["doc", "set"])


def _unpack_sets(batches):
    for batch in batches:
        docs, packed = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for at in range(0, len(packed), 200):
            sets = [np.frombuffer(x, dtype=np.int32) for x in packed[at : at + 200]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(docs[at : at + 200], [len(x) for x in sets]))], names=["token", "doc"])


def _count_parts(batches):
    for batch in batches:
        counts = [np.bincount(np.frombuffer(x, dtype=np.uint32) & np.uint32(PARTS - 1), minlength=PARTS) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.list_(pa.int32()))], names=["doc", "parts"])


def commonest(left: DataFrame) -> DataFrame:
    """(key, most): the root of most members of each bucket."""
    return left.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("most"))


def possible_pairs(left: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b) of the members of ``left(key, doc, size, root)`` that share a bucket, are not joined and may be similar.

    Shingles that no other set has are left out of account. The rest is counted in PARTS by hash:
    two sets have no more in common than the sum of the lesser counts, while similar sets have
    similar / (1 + similar) of both sizes, which also bounds the sizes of a set's partners.
    """
    own = durable(sets.hint("merge").join(left.select("doc").distinct(), "doc", "left_semi").select("doc", "set"))
    alone = own.mapInArrow(_unpack_sets, "token int, doc long").groupBy("token").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).where("n = 1")
    alone = alone.groupBy("doc", F.col("token").bitwiseAND(F.lit(PARTS - 1)).alias("part")).agg(F.count("*").cast("int").alias("n"))
    alone = alone.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("alone"))  # PARTS entries at most
    shared = F.transform("parts", lambda n, i: F.when(F.col("alone").isNull(), n).otherwise(n - F.coalesce(F.try_element_at("alone", i), F.lit(0))).cast("short"))
    able = durable(own.mapInArrow(_count_parts, "doc long, parts array<int>").hint("merge").join(alone, "doc", "left").select("doc", shared.alias("parts")))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda x, n: x + n)
    left = durable(left.hint("merge").join(able, "doc").withColumn("able", total("parts")))
    part, room = similar / (1 + similar), 1e-6
    step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(STEP)) + room).cast("int")
    # a pair across components has a member outside its bucket's largest one
    low = F.greatest(F.ceil(similar * F.col("size") - room), F.lit(1))
    high = F.floor(F.least(F.col("size") / similar, F.col("able") / part - F.col("size")) + room)
    others = left.hint("merge").join(commonest(left), "key").where(F.col("root") != F.col("most")).withColumn("low", low).withColumn("high", high).where("high >= low")
    others = others.select(F.col("key").alias("key2"), F.col("doc").alias("b"), F.col("size").alias("size2"), F.col("root").alias("root2"), F.col("able").alias("able2"), F.col("parts").alias("parts2"), "low", "high", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))).alias("step2"))
    least = part * (F.col("size") + F.col("size2")) - room
    met = (F.col("key") == F.col("key2")) & (F.col("step") == F.col("step2")) & (F.col("root") != F.col("root2")) & F.col("size").between(F.col("low"), F.col("high"))
    met &= (F.least("able", "able2") >= least) & (total(F.zip_with("parts", "parts2", lambda x, y: F.least(x, y))) >= least)
    return left.withColumn("step", step(F.col("size"))).hint("merge").join(others, met).select(F.col("doc").alias("a"), "b")


def _verify(similar: float):
    def run(batches):
        for batch in batches:
            a, b, one, two = (c.to_pylist() for c in batch.columns)
            good = [jaccard(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)) >= similar for x, y in zip(one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, type=pa.bool_()))
    return run


def groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc, root) for every doc_id of ``docs`` that is not alone: root is the least doc_id of its group.

    Null texts count as empty, texts without words are copies of each other, rows without doc_id
    belong to no group, rows of one doc_id are one document. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _groups(docs, similar)


def _groups(docs: DataFrame, similar: float) -> DataFrame:
    told = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null")
    described = durable(told.mapInArrow(_describe, "doc long, same binary, keys binary"))
    salted = described.select("doc", "same", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy("same", "salt").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    firsts = parts.groupBy("same").agg(F.min("least").alias("first"), F.sum("n").alias("n")).where("n > 1").select("same", "first")
    told_firsts = parts.select("same", "salt").hint("merge").join(firsts, "same")
    copies = salted.hint("merge").join(told_firsts, ["same", "salt"]).where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    links = durable(copies)
    different = described.hint("merge").join(links.select(F.col("b").alias("doc")), "doc", "left_anti").select("doc", "keys")
    keyed = different.mapInArrow(_unpack_keys, "key long, doc long").repartition("key").distinct()  # one exchange for all three uses
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    kept = durable(keyed.hint("merge").join(met, "key"))
    wanted = kept.select("doc").distinct()
    sets = durable(told.hint("merge").join(wanted, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(_shingle_sets, "doc long, set binary"))
    members = durable(kept.hint("merge").join(sets.select("doc", (F.length("set") / 4).cast("long").alias("size")), "doc"))
    near = None

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("doc").alias("a"), F.col("set").alias("one")), sets.select(F.col("doc").alias("b"), F.col("set").alias("two"))
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = durable(ordered.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "one", "two").mapInArrow(_verify(similar), "a long, b long"))
        return found if near is None else durable(near.union(found))

    def apart(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component, with each member's root."""
        if near is None:
            return rows.withColumn("root", F.col("doc"))
        told_roots = durable(components(near))
        rooted = durable(rows.hint("merge").join(told_roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")))
        still = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
        return durable(rooted.hint("merge").join(still, "key", "left_semi"))

    #: sizes bound the similarity; documents that links have joined need no other link
    may = (F.col("root") != F.col("root2")) & (F.least("size", "size2") >= F.lit(similar) * F.greatest("size", "size2") - 1e-6)
    large = apart(members.where(F.col("n") > PAIRS))
    if not large.isEmpty():
        often = large.groupBy("doc").agg(F.count("*").alias("often"))
        me = F.struct(F.col("often"), F.xxhash64("doc").alias("place"), F.col("doc").alias("b"), F.col("size").alias("size2"), F.col("root").alias("root2"))
        centres = large.hint("merge").join(often, "doc").groupBy("key").agg(F.max(me).alias("x")).select("key", "x.b", "x.size2", "x.root2")
        near = verified(large.hint("merge").join(centres, "key").where(may).select(F.col("doc").alias("a"), "b"))
    left = apart(members)
    if not left.isEmpty():
        near = verified(possible_pairs(left, sets, similar))
    return components(links if near is None else links.union(near)).withColumnRenamed("node", "doc")


def deduplicate(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` less all but the least doc_id of each group of near duplicates.

    A group is a component of links: where A is similar to B and B to C, one of the three stays,
    whether or not A is similar to C.
    """
    gone = groups(docs, similar).where("doc <> root").select(F.col("doc").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
