"""Exact substring deduplication over all documents by sharded sparse suffix arrays.

Every byte covered by a 50-byte string that also starts in a document of smaller id is removed.
A 50-byte window's *anchor* is the leftmost of its 16-byte grams with the least hash, so equal
windows have equal anchors at equal offsets. Consecutive windows of one anchor form a *run*.

1. Documents are packed into flushes of bounded size, written once to the shared folder.
2. Each flush sends the sorted anchor hashes of its different runs to shards by hash range; a shard
   merges the sorted lists and by binary search tells each which anchors stand in two runs.
3. Only those runs' bytes go to the shards. A shard builds two suffix arrays of the anchored
   suffixes (bytes from the anchor on, and reversed bytes before it) by Larsson-Sadakane
   refinement: sorted by a word, then only groups that are still tied are refined by the next.
   Longest common prefixes of neighbours cut each array into classes of equal t-byte prefixes for
   every t, so the windows at offset o of all runs are equal exactly where the classes of o bytes
   before and 50 - o bytes from the anchor agree; the first document of each class keeps it.
4. Each flush gets a mask of windows back for each run and cuts its documents.

A passage that stands in very many documents is sent once by each flush, whatever its copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import durable, free_shuffles, mix64, read

WINDOW = 50
GRAM = 16
GRAMS = WINDOW - GRAM + 1
FLUSH_BYTES = 2 << 20
SHARD_BYTES = 12 << 20
LATEST = (1 << 63) - 1
_U = np.uint64


# ---------------------------------------------------------------- flushes


def pack(docs: DataFrame, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """(flush, ids, sizes, text): documents of (doc_id, text) packed, texts compressed."""
    def run(batches):
        base, n, squeeze = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3)
        ids, texts, held = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([
                pa.array([base + n], type=pa.int64()), pa.array([np.array([LATEST if i is None else i for i in ids], dtype="<i8").tobytes()], type=pa.binary()),
                pa.array([np.array([-1 if i is None else len(t) for i, t in zip(ids, texts)], dtype="<i8").tobytes() + np.array([len(t) for t in texts], dtype="<i8").tobytes()], type=pa.binary()),
                pa.array([squeeze.compress(b"".join(texts))], type=pa.binary())], names=["flush", "ids", "sizes", "text"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(name)
                texts.append((text or "").encode())
                held += len(texts[-1]) + 64
                if held >= flush_bytes:
                    yield row()
                    n, ids, texts, held = n + 1, [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "flush long, ids binary, sizes binary, text binary")


class Flush:
    """The documents of one flush and their runs, in the order of (anchor hash, run)."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids = np.frombuffer(ids, dtype="<i8")
        known, self.sizes = np.frombuffer(sizes, dtype="<i8").reshape(2, -1)
        self.null = known < 0
        self.data = zstandard.ZstdDecompressor().decompress(text) if len(text) else b""
        self._runs()

    def _runs(self) -> None:
        b = np.frombuffer(self.data, dtype=np.uint8)
        ends = np.cumsum(self.sizes)
        n = len(b) - WINDOW + 1
        self.bytes = b
        if n <= 0:
            self.first = self.anchor = self.windows = self.doc = np.zeros(0, dtype=np.int64)
            self.hash = self.name = np.zeros(0, dtype=np.uint64)
            self.unique_at, self.of = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            return
        w = b.astype(np.uint64)
        w = w[:-1] | w[1:] << _U(8)
        w = w[:-2] | w[2:] << _U(16)
        w = w[:-4] | w[4:] << _U(32)
        h = mix64(w[:-8] * _U(0x9E3779B97F4A7C15) ^ (w[8:] * _U(0xC2B2AE3D27D4EB4F) + (w[8:] >> _U(31))))
        del w
        low = max(1, int(len(h)).bit_length())
        least = h >> _U(low) << _U(low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = GRAMS - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (least & _U((1 << low) - 1)).astype(np.int64)
        del least
        # windows inside one document
        valid = np.zeros(len(b) + 1, dtype=np.int8)
        full = self.sizes >= WINDOW
        valid[(ends - self.sizes)[full]] = 1
        np.add.at(valid, (ends[full] - WINDOW + 1), -1)
        inside = np.cumsum(valid[:n], dtype=np.int8) > 0
        change = np.ones(n, dtype=bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        doc_begin = (ends - self.sizes)[full]
        change[doc_begin] = True
        heads = np.nonzero(change)[0]
        windows = np.diff(np.concatenate([heads, [n]]))
        keep = inside[heads]
        first, windows = heads[keep], windows[keep]
        at = anchor[first]
        size = windows + WINDOW - 1
        last = first + size - GRAM
        name = h[first] + size.astype(np.uint64)
        for k, place in enumerate((first + GRAM, first + 2 * GRAM, last, last - GRAM, last - 2 * GRAM)):
            name = mix64(name * _U(0x9E3779B97F4A7C15) + h[place])
        key = mix64(h[at] + _U(0x9E3779B97F4A7C15))  # anchors have small hashes: mixed again to spread over shards
        order = np.lexsort((name, key))
        self.first, self.anchor, self.windows, self.hash, self.name = first[order], at[order], windows[order], key[order], name[order]
        self.doc = np.searchsorted(ends, self.first, side="right")
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.hash[1:] != self.hash[:-1]) | (self.name[1:] != self.name[:-1])
        self.unique_at = np.nonzero(new)[0]
        self.of = np.cumsum(new) - 1

    def first_ids(self) -> np.ndarray:
        """The smallest doc_id of each different run."""
        return np.minimum.reduceat(self.ids[self.doc], self.unique_at) if len(self.unique_at) else np.zeros(0, dtype=np.int64)

    def shard_bounds(self, shards: int) -> np.ndarray:
        """Where each shard's different runs begin (and the last ends)."""
        shard = (self.hash[self.unique_at] >> _U(32)) * _U(shards) >> _U(32)
        return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))

    def digests(self, masks: np.ndarray) -> list[tuple]:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; masks: of each different run, by offset."""
        n = len(self.bytes)
        flag = np.zeros(n + WINDOW + 1, dtype=np.int32)
        if len(self.of):
            least = self.first_ids()[self.of]
            mask = np.where(self.ids[self.doc] > least, _U((1 << GRAMS) - 1), masks[self.of])
            hit = np.nonzero(mask)[0]
            count = self.windows[hit]
            start = np.repeat(self.first[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            offset = np.repeat(self.anchor[hit], count) - start
            gone = start[np.repeat(mask[hit], count) >> offset.astype(np.uint64) & _U(1) == 1]
            flag[gone] += 1
            flag[gone + WINDOW] -= 1
        covered = np.cumsum(flag[:n]) > 0
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        upto = np.concatenate([[0], np.cumsum(covered)])
        rises = covered.copy()
        rises[1:] &= ~covered[:-1]
        real = starts[self.sizes > 0]
        rises[real] = covered[real]
        spans = np.concatenate([[0], np.cumsum(rises)])
        kept = self.bytes[~covered].tobytes()
        kept_upto = np.arange(n + 1) - upto
        return [(None if null else int(i), int(s), int(upto[z] - upto[a]), int(spans[z] - spans[a]), hashlib.sha256(kept[kept_upto[a] : kept_upto[z]]).hexdigest())
                for i, null, s, a, z in zip(self.ids.tolist(), self.null, self.sizes, starts, ends)]


# ---------------------------------------------------------------- shards


def refine(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes sorted by their big-endian ``words`` and the bytes each shares with the one before."""
    n = len(words[0])
    order = np.argsort(words[0], kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = words[0][order[1:]] != words[0][order[:-1]]
    for w in words[1:]:
        group = np.cumsum(first)
        alone = first & np.concatenate([first[1:], [True]])
        tied = np.nonzero(~alone)[0]
        if not len(tied):
            break
        value = w[order[tied]]
        inner = np.lexsort((value, group[tied]))
        order[tied] = order[tied][inner]
        value = value[inner]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (group[tied][1:] != group[tied][:-1])
        first[tied] |= new
    lcp = np.zeros(n, dtype=np.int64)
    open_ = np.arange(1, n)
    for w in words:
        if not len(open_):
            break
        x = w[order[open_]] ^ w[order[open_ - 1]]
        same = x == 0
        lcp[open_] += np.where(same, 8, (64 - np.frexp(x.astype(np.float64))[1].astype(np.int64)).clip(0, 63) // 8)
        # rounding to a float may carry into the next power of two: then the leading byte differs one earlier
        at = np.nonzero(~same)[0]
        if len(at):
            lead = (np.frexp(x[at].astype(np.float64))[1].astype(np.int64) - 1).clip(0, 63)
            over = (x[at] >> lead.astype(np.uint64)) == 0
            exact = (63 - (lead - over)) // 8
            lcp[open_[at]] += exact - (64 - np.frexp(x[at].astype(np.float64))[1].astype(np.int64)).clip(0, 63) // 8
        open_ = open_[same]
    return order, lcp


def window_masks(text: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each run (bytes text[start : start + size], anchor's offset, first doc_id): the windows, by offset of
    the anchor in them, that also start in a document of smaller id."""
    n = len(start)
    by_doc = np.argsort(doc, kind="stable")
    start, size, anchor, doc = start[by_doc], size[by_doc], anchor[by_doc], doc[by_doc]
    last = len(text) - 1

    def words(count: int, at) -> list[np.ndarray]:
        out = []
        for j in range(0, count, 8):
            w = np.zeros(n, dtype=np.uint64)
            for k in range(j, j + 8):
                place = at(k)
                inside = (place >= start) & (place < start + size) & (k < count)
                w = w << _U(8) | np.where(inside, text[np.clip(place, 0, last)], 0).astype(np.uint64)
            out.append(w)
        return out

    right, right_lcp = refine(words(WINDOW, lambda k: start + anchor + k))
    left, left_lcp = refine(words(GRAMS - 1, lambda k: start + anchor - 1 - k))
    masks = np.zeros(n, dtype=np.uint64)
    bits = max(1, int(n).bit_length())
    place_r, place_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    place_r[right], place_l[left] = np.arange(n), np.arange(n)
    for o in range(GRAMS):
        has = np.nonzero((anchor >= o) & (anchor - o + WINDOW <= size))[0]
        if len(has) < 2:
            continue
        r = np.cumsum(right_lcp < WINDOW - o)[place_r[has]].astype(np.uint64)
        l = np.cumsum(left_lcp < o)[place_l[has]].astype(np.uint64) if o else np.zeros(len(has), dtype=np.uint64)
        if 3 * bits <= 64:
            key = np.sort(l << _U(2 * bits) | r << _U(bits) | has.astype(np.uint64))
            idx = (key & _U((1 << bits) - 1)).astype(np.int64)
            key >>= _U(bits)
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
        else:
            order = np.lexsort((has, r, l))
            idx = has[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (l[order][1:] != l[order][:-1]) | (r[order][1:] != r[order][:-1])
        least = doc[idx[np.nonzero(new)[0]]][np.cumsum(new) - 1]
        masks[idx[doc[idx] > least]] |= _U(1 << o)
    out = np.zeros(n, dtype=np.uint64)
    out[by_doc] = masks
    return out


# ---------------------------------------------------------------- exchange


def _rows(kind: list[int], flush: int, shards: list[int], blobs: list[bytes]):
    return pa.RecordBatch.from_arrays([pa.array(shards, type=pa.int32()), pa.array([flush] * len(shards), type=pa.int64()), pa.array(blobs, type=pa.binary())], names=["shard", "flush", "blob"])


EXCHANGE = "shard int, flush long, blob binary"


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of (doc_id, text).

    Null and empty texts have no bytes and keep none; texts under 50 bytes are kept; rows of one
    doc_id are no copies of each other; a null doc_id counts as the largest. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    flushes = durable(pack(docs))
    total = flushes.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-3 * total // SHARD_BYTES))

    def send_anchors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = Flush(row["ids"], row["sizes"], row["text"])
                cut = f.shard_bounds(shards)
                key = f.hash[f.unique_at].astype(np.uint32)
                here = [s for s in range(shards) if cut[s + 1] > cut[s]]
                yield _rows([], row["flush"], here, [key[cut[s] : cut[s + 1]].tobytes() for s in here])

    def share(key, table):
        blobs = [np.frombuffer(x, dtype=np.uint32) for x in table.column("blob").to_pylist()]
        every = np.sort(np.concatenate(blobs))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        flags = []
        for b in blobs:
            at = np.minimum(np.searchsorted(twice, b), max(len(twice) - 1, 0))
            flags.append(np.packbits(twice[at] == b).tobytes() if len(twice) else np.zeros((len(b) + 7) // 8, dtype=np.uint8).tobytes())
        return pa.table({"shard": table.column("shard"), "flush": table.column("flush"), "blob": pa.array(flags, type=pa.binary())})

    shared = flushes.mapInArrow(send_anchors, EXCHANGE).groupBy("shard").applyInArrow(share, EXCHANGE)

    def gathered(answers: DataFrame) -> DataFrame:
        one = answers.groupBy("flush").agg(F.sort_array(F.collect_list(F.struct("shard", "blob"))).alias("answers"))
        return flushes.join(one, "flush", "left").select("flush", "ids", "sizes", "text", F.col("answers.shard").alias("at"), F.col("answers.blob").alias("blobs"))

    def send_runs(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                f = Flush(row["ids"], row["sizes"], row["text"])
                cut, least = f.shard_bounds(shards), f.first_ids()
                here, blobs = [], []
                for s, flags in zip(row["at"] or [], row["blobs"] or []):
                    n = cut[s + 1] - cut[s]
                    pick = f.unique_at[cut[s] : cut[s + 1]][np.unpackbits(np.frombuffer(flags, dtype=np.uint8))[:n] == 1]
                    if not len(pick):
                        continue
                    first, size = f.first[pick], f.windows[pick] + WINDOW - 1
                    index = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    parts = [np.array([len(pick)], dtype="<i8").tobytes(), f.windows[pick].astype(np.uint8).tobytes(), (f.anchor[pick] - first).astype(np.uint8).tobytes(), least[f.of[pick]].astype("<i8").tobytes(), f.bytes[index].tobytes()]
                    here.append(s)
                    blobs.append(squeeze.compress(b"".join(parts)))
                if here:
                    yield _rows([], row["flush"], here, blobs)

    def judge(key, table):
        unpack = zstandard.ZstdDecompressor()
        sizes, anchors, docs_, texts, counts = [], [], [], [], []
        for blob in table.column("blob").to_pylist():
            data = unpack.decompress(blob)
            n = int(np.frombuffer(data, "<i8", 1)[0])
            counts.append(n)
            sizes.append(np.frombuffer(data, np.uint8, n, 8).astype(np.int64) + WINDOW - 1)
            anchors.append(np.frombuffer(data, np.uint8, n, 8 + n).astype(np.int64))
            docs_.append(np.frombuffer(data, "<i8", n, 8 + 2 * n))
            texts.append(np.frombuffer(data, np.uint8, offset=8 + 10 * n))
        size = np.concatenate(sizes)
        masks = window_masks(np.concatenate(texts), np.cumsum(size) - size, size, np.concatenate(anchors), np.concatenate(docs_))
        squeeze, ends = zstandard.ZstdCompressor(level=1), np.cumsum(counts)
        blobs = [squeeze.compress(masks[e - n : e].tobytes()) for e, n in zip(ends, counts)]
        return pa.table({"shard": table.column("shard"), "flush": table.column("flush"), "blob": pa.array(blobs, type=pa.binary())})

    flags = durable(shared)
    free_shuffles(spark)
    runs = gathered(flags).mapInArrow(send_runs, EXCHANGE)
    masks = durable(runs.groupBy("shard").applyInArrow(judge, EXCHANGE))
    free_shuffles(spark)
    marked = flags.select("shard", "flush", F.col("blob").alias("flags")).join(masks.select("shard", "flush", F.col("blob").alias("masks")), ["shard", "flush"]).select("shard", "flush", F.struct("flags", "masks").alias("blob"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                f = Flush(row["ids"], row["sizes"], row["text"])
                bound = f.shard_bounds(shards)
                every = np.zeros(len(f.unique_at), dtype=np.uint64)
                for s, blob in zip(row["at"] or [], row["blobs"] or []):
                    n = bound[s + 1] - bound[s]
                    flag = np.unpackbits(np.frombuffer(blob["flags"], dtype=np.uint8))[:n] == 1
                    every[bound[s] : bound[s + 1]][flag] = np.frombuffer(unpack.decompress(blob["masks"]), dtype=np.uint64)
                columns = list(zip(*f.digests(every)))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return gathered(marked).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents"))
