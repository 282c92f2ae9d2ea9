"""SimHash near-duplicate search by Golay-code fuzzy hashing.

Fingerprints are cut into three segments. Two fingerprints that differ in at most two bits agree
in one whole segment (pigeonhole) and differ by at most two bits in the segment after it. That
second segment is decoded with the perfect [23,12] Golay code: a word at distance three from its
codeword also takes the five codewords at distance four, and then any two words at most two bits
apart share a codeword index. Each (whole segment, codeword index) is one bucket key; links are
verified by the true Hamming distance.

Buckets of more than ``PAIR_LIMIT`` different fingerprints (large near-copy groups) are split on
the codeword indices of the third segment, which links within a bucket must also share; what is
still large is linked through masks: each fingerprint meets all others with which it agrees
outside two given bits at the least of them. All three ways are exact and none lists the pairs
of a large group.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.shared import durable, read, text_bytes

#: (lowest bit, width) of the three segments of a 64-bit fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 2
#: Up to so many different fingerprints of a bucket are compared pair by pair.
PAIR_LIMIT = 48
#: The generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the [23,12] Golay code.
GENERATOR = 0b101011100011


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the 2^12 top halves, error pattern by syndrome, the distance-4 patterns by syndrome)."""
    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    one = [syndrome(1 << b) for b in range(23)]
    leader = np.zeros(2048, dtype=np.uint32)
    weight = np.full(2048, -1)
    weight[0] = 0
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                bits = {a, b, c}
                s, e = 0, 0
                for x in bits:
                    s ^= one[x]
                    e |= 1 << x
                if weight[s] < 0 or len(bits) < weight[s]:
                    weight[s], leader[s] = len(bits), e
    far: list[list[int]] = [[] for _ in range(2048)]
    for a in range(23):
        for b in range(a + 1, 23):
            for c in range(b + 1, 23):
                for d in range(c + 1, 23):
                    s = one[a] ^ one[b] ^ one[c] ^ one[d]
                    if weight[s] == 3:
                        far[s].append(1 << a | 1 << b | 1 << c | 1 << d)
    patterns = np.zeros((2048, 6), dtype=np.uint32)
    patterns[:] = leader[:, None]
    for s, more in enumerate(far):
        if more:
            patterns[s, 1:] = more
    table = np.array([syndrome(x << 11) for x in range(4096)], dtype=np.uint32)
    return table, patterns, weight


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every key of 23-bit ``words``: one, or six at distance three."""
    table, patterns, weight = _golay()
    words = words.astype(np.uint32)
    syndrome = table[words >> np.uint32(11)] ^ (words & np.uint32(2047))
    index = (words[:, None] ^ patterns[syndrome]) >> np.uint32(11)
    keep = np.zeros(index.shape, dtype=bool)
    keep[:, 0] = True
    keep[weight[syndrome] == 3] = True
    row, col = np.nonzero(keep)
    return row, index[row, col].astype(np.uint64)


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """The majority of the XXH64 bits of all ``words``-word shingles (more than half: 1)."""
    parts = text.lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(whole, seed)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(parts) - words + 1].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        block = hashes[k : k + 65536]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row, as a signed long; null text is empty."""
    def run(batches):
        for batch in batches:
            values = [fingerprint(t, words) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fps: np.ndarray, k: int) -> np.ndarray:
    low, width = SEGMENTS[k]
    return fps >> np.uint64(low) & np.uint64((1 << width) - 1)


def _bucket_keys(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(3):
            row, index = golay_keys(_segment(fps, (k + 1) % 3))
            key = np.uint64(k) << np.uint64(60) | _segment(fps, k)[row] << np.uint64(12) | index
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[row].view(np.int64))], names=["key", "fp"])


def _third_keys(batches):
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        fps = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(3):
            of = np.nonzero(keys >> np.uint64(60) == k)[0]
            row, index = golay_keys(_segment(fps[of], (k + 2) % 3))
            # 60 bits of the key are in use, 2 + 22 + 12 of them filled: the third index goes above the whole segment
            key = keys[of][row] | index << np.uint64(36)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[of][row].view(np.int64))], names=["key", "fp"])


def _mask_keys(batches):
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        fps = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(3):
            own = fps[keys >> np.uint64(60) == k]
            low, width = SEGMENTS[k]
            free = [b for b in range(64) if not low <= b < low + width]
            for i, a in enumerate(free):
                for b in free[i + 1 :]:
                    masked = own & ~np.uint64(1 << a | 1 << b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), a * 64 + b, dtype=np.int32)), pa.array(masked.view(np.int64)), pa.array(own.view(np.int64))], names=["at", "key", "fp"])


def _pairs_within(batches):
    for batch in batches:
        a, b = [], []
        for fps in batch.column(0).to_pylist():
            x = np.array(sorted(fps), dtype=np.int64).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= MAX_DISTANCE
            i, j = np.nonzero(np.triu(near, 1))
            a.append(x[i].view(np.int64))
            b.append(x[j].view(np.int64))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``distinct(fp)`` within two bits."""
    def split(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
        large = keyed.join(sizes.where(F.col("n") > PAIR_LIMIT), "key").select("key", "fp")
        small = keyed.join(sizes.where((F.col("n") > 1) & (F.col("n") <= PAIR_LIMIT)), "key")
        within = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_pairs_within, "a long, b long")
        return durable(within.distinct()), large

    keyed = durable(distinct.select("fp").mapInArrow(_bucket_keys, "key long, fp long"))
    links, large = split(keyed)
    if not large.isEmpty():
        thirds = durable(large.mapInArrow(_third_keys, "key long, fp long"))
        more, still = split(thirds)
        links = links.union(more)
        if not still.isEmpty():
            masked = still.distinct().mapInArrow(_mask_keys, "at int, key long, fp long")
            least = masked.groupBy("at", "key").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b <> c")
            links = links.union(masked.join(least, ["at", "key"]).select(F.col("fp").alias("a"), "b").distinct())
    return links


def near_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Rows link when their fingerprints differ in at most two bits; component_id is the least doc_id
    reachable, null where no row in reach has any. Null or empty text has fingerprint zero and links like any
    other; repeated rows share a fingerprint; texts of any length count whole, other columns are not
    looked at; an empty table gives an empty result.
    """
    fps = durable(fingerprints(docs, words))
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = components(fingerprint_links(distinct))
    labelled = distinct.join(rooted, distinct.fp == rooted.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
