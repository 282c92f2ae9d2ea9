"""Token ids in a compact binary file format: Huffman-coded blocks in ascending doc_id order.

Texts are encoded by a public tokenizer. Its normaliser and splitter never join or cut anything
across blanks, so a text's ids are those of its blank-separated pieces; pieces repeat, so each
worker keeps the ids of pieces it has met (a bounded memo that changes no result).

Documents are dealt to files by ranges of doc_id. The ids' global counts give one canonical
length-limited Huffman code (see ``huffman``). A file holds, after a fixed header: the code's
lengths, the documents' ids and sizes, the bit offsets of the blocks, and the coded ids of all its
documents one after another. Files are rows of a table in the shared folder, as executors can write
nowhere else, and are read back from there.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import huffman
from lodestar.llm.shared import IS_SPACE, durable, few, free_shuffles, mix64, read, scratch

MAGIC = b"LSTK0001"
_U = np.uint64
END_ID = 1
#: Documents' bytes that go to one file, about; a file ends at half as many ids in any case.
FILE_BYTES = 8 << 20
#: Slots of a worker's table of short pieces, which is emptied at two thirds; long pieces and words remembered.
SLOTS_LOG2, MEMO = 20, 50_000
#: Pieces of so many bytes stand in the table themselves.
SHORT = 15
#: Bytes of texts that are encoded together.
BLOCK = 1 << 20
#: Words that are encoded at a time.
WORDS = 2000
#: Ranges of doc_id by quantiles, and equal steps within them for each file.
RANGES, STEPS = 512, 16
#: Pieces of other characters are encoded one by one; these are in normal form once they are in lower case ...
SPECIAL = re.compile("[^!-~À-ÖØ-öø-ÿ\n]")
#: ... and fall into the tokenizer's words by its own rule for them.
PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceIds:
    """Blank-separated pieces of text and their ids.

    Pieces of up to SHORT bytes are two numbers, which a table of open addressing finds for a whole
    block of texts at once; what the table and a small dictionary of longer pieces lack is encoded
    once a block.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        suffix = self.whole.model.end_of_word_suffix
        if not suffix:
            raise ValueError("no mark at the ends of words")
        #: the ids that end a word
        self.last = np.zeros(1 << 16, dtype=bool)
        self.last[[i for t, i in self.whole.get_vocab().items() if t.endswith(suffix)]] = True
        self.model = Tokenizer(self.whole.model)  # the same merges, over words that are already apart
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = (x for x in range(256) if x not in printable)
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(spare)}
        self.long: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"\n": b""}
        self._clear()

    def _clear(self) -> None:
        n = 1 << SLOTS_LOG2
        self.key0, self.key1 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)  # no piece has size 0, which key1 holds
        self.at, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint8)
        self.pool, self.used, self.filled = np.zeros(1 << 16, dtype="<u2"), 0, 0

    def _learn_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words: what the tokenizer's model makes of their bytes."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            shown = "\n".join(some)
            if not shown.isascii():
                shown = "\n".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in some)
            ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u2")
            cut = [0, *(2 * np.nonzero(self.last[ids])[0] + 2).tolist()]
            if len(cut) != len(some) + 1:
                raise ValueError("words without an end")
            out.update(zip(some, map(ids.tobytes().__getitem__, map(slice, cut, cut[1:]))))
        return out

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different pieces."""
        out: dict[bytes, bytes] = {}
        joined = b"\n".join(pieces).decode()
        if SPECIAL.search(joined) or "<|" in joined:
            for p in pieces:
                text = p.decode()
                if SPECIAL.search(text) or "<|" in text:
                    known = self.whole.encode(text, add_special_tokens=False).ids
                    out[p] = struct.pack(f"<{len(known)}H", *known)
            pieces = [p for p in pieces if p not in out]
            joined = b"\n".join(pieces).decode()
        if not pieces:
            return out
        parts = PARTS.findall(joined.lower())
        ids = self._found(self.words, parts, self._learn_words)
        ends = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        breaks = np.nonzero(np.fromiter(map("\n".__eq__, parts), dtype=bool, count=len(parts)))[0]
        cut = [0, *ends[breaks].tolist(), int(ends[-1])]
        out.update(zip(pieces, map(b"".join(ids).__getitem__, map(slice, cut, cut[1:]))))
        return out

    @staticmethod
    def _found(memo: dict, keys: list, learn) -> list[bytes]:
        """What ``memo`` has for each key, or else ``learn`` finds for all that it lacks."""
        ids = list(map(memo.get, keys))
        lacking = [i for i, x in enumerate(ids) if x is None]
        if lacking:
            fresh = learn(list({keys[i] for i in lacking}))
            for i in lacking:
                ids[i] = fresh[keys[i]]
            if len(memo) < MEMO:
                memo.update(fresh)
        return ids

    def _slots(self, k0: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, known) of every key: where it stands, or else the empty slot at which its search ends."""
        slot = (mix64(k0 * np.uint64(0x9E3779B97F4A7C15) ^ mix64(k1)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        there = self.key1[slot]
        known = (there == k1) & (self.key0[slot] == k0)
        open_ = np.nonzero(~known & (there != 0))[0]
        while len(open_):
            slot[open_] = at = (slot[open_] + 1) & ((1 << SLOTS_LOG2) - 1)
            there = self.key1[at]
            hit = (there == k1[open_]) & (self.key0[at] == k0[open_])
            known[open_[hit]] = True
            open_ = open_[~hit & (there != 0)]
        return slot, known

    def _insert(self, k0: np.ndarray, k1: np.ndarray, ids: list[bytes]) -> None:
        """Different new keys with their ids; few enough to leave empty slots."""
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 1
        fresh = np.frombuffer(b"".join(ids), dtype="<u2")
        at = self.used + np.cumsum(sizes) - sizes
        if self.used + len(fresh) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(fresh)), dtype="<u2")])
        self.pool[self.used : self.used + len(fresh)] = fresh
        self.used += len(fresh)
        self.filled += len(k0)
        todo = np.arange(len(k0))
        while len(todo):
            slot, _ = self._slots(k0[todo], k1[todo])
            slot, first = np.unique(slot, return_index=True)  # one of those that want the same slot gets it
            won = todo[first]
            self.key0[slot], self.key1[slot], self.at[slot], self.count[slot] = k0[won], k1[won], at[won], sizes[won]
            todo = np.delete(todo, first)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers, null as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return [b""] * len(texts)
        data = texts.buffers()[2][offsets[0] : offsets[-1]].to_pybytes()
        offsets = offsets - offsets[0]
        if b"<|" not in data:
            data = data.lower()
        else:  # special tokens are sought before letters are lowered
            own = [data[a:b] for a, b in zip(offsets, offsets[1:])]
            data = b"".join(t if b"<|" in t else t.lower() for t in own)
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~IS_SPACE[np.frombuffer(data, dtype=np.uint8)]
        begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = inside[heads + 1]
        stops[heads[1:] - 1] = inside[heads[1:]]
        start = np.nonzero(begins)[0]
        size = np.nonzero(stops)[0] + 1 - start
        if not len(start):
            return [b""] * len(texts)
        window = np.ndarray(shape=(n + 9,), dtype="<u8", buffer=data + bytes(16), strides=(1,))
        low = (_U(1) << (_U(8) * np.arange(8, dtype=np.uint64))) - _U(1)
        mask = np.concatenate([low, [_U(0xFFFFFFFFFFFFFFFF)]])
        short = size <= SHORT
        held = np.minimum(size, SHORT)
        k0 = window[start] & mask[np.minimum(held, 8)]
        k1 = window[np.minimum(start + 8, n)] & mask[np.maximum(held - 8, 0)] | held.astype(np.uint64) << _U(56)
        if self.filled > (2 << SLOTS_LOG2) // 3 - len(start):
            self._clear()
        slot, known = self._slots(k0, k1)
        known |= ~short
        lacking = np.nonzero(~known)[0]
        room = (2 << SLOTS_LOG2) // 3 - self.filled
        extra: list[bytes] = []
        begin, count = self.at[slot], self.count[slot].astype(np.int64)
        if len(lacking):
            order = lacking[np.lexsort((k0[lacking], k1[lacking]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (k0[order][1:] != k0[order][:-1]) | (k1[order][1:] != k1[order][:-1])
            one = order[new]
            pieces = [data[a:b] for a, b in zip(start[one].tolist(), (start[one] + size[one]).tolist())]
            learnt = self._learn(pieces)
            ids = [learnt[p] for p in pieces]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 1
            of = np.cumsum(new) - 1
            if len(one) <= room:
                begin[order] = (self.used + np.cumsum(sizes) - sizes)[of]
                self._insert(k0[one], k1[one], ids)
            else:
                begin[order] = -1 - (np.cumsum(sizes) - sizes)[of]
                extra += ids
            count[order] = sizes[of]
        large = np.nonzero(~short)[0]
        if len(large):
            ids = self._found(self.long, [data[a:b] for a, b in zip(start[large].tolist(), (start[large] + size[large]).tolist())], self._learn)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 1
            ahead = sum(map(len, extra)) >> 1
            begin[large] = -1 - (ahead + np.cumsum(sizes) - sizes)
            count[large] = sizes
            extra += ids
        every = self.pool[: self.used]
        if extra:
            every = np.concatenate([every, np.frombuffer(b"".join(extra), dtype="<u2")])
            begin = np.where(begin < 0, self.used - 1 - begin, begin)
        ends = np.cumsum(count)
        at = np.repeat(begin - (ends - count), count)
        at += np.arange(len(at))
        ids = every[at].tobytes()
        cut = 2 * np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        return list(map(ids.__getitem__, map(slice, cut.tolist(), cut[1:].tolist())))


@functools.cache
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def blocks(texts: pa.StringArray, size: int = BLOCK):
    """(from, to) of runs of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, end
        at = end


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """(file, doc_id, n, ids) from (file, doc_id, text): every text's ids with the end id, packed."""
    def run(batches):
        memo, pack = piece_ids(path), zstandard.ZstdCompressor(level=1)
        end = np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            for a, b in blocks(batch.column(2)):
                ids = [x + end for x in memo.encode(batch.column(2).slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(x) // 2 for x in ids], type=pa.int64()), pa.array(list(map(pack.compress, ids)), type=pa.binary())], names=["file", "doc_id", "n", "ids"])

    return docs.select("file", "doc_id", "text").mapInArrow(run, "file long, doc_id long, n long, ids binary")


def running_before(rows: DataFrame, place: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows whose whole number ``place`` is less; places differ.

    Blocks of places are summed up first, so the one window that is not split has a row a block.
    """
    inner = rows.withColumn("block_", F.floor(F.col(place) / block))
    heads = inner.groupBy("block_").agg(F.sum(value).alias("sum_"))
    upto = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("ahead_", F.coalesce(F.sum("sum_").over(upto), F.lit(0))).drop("sum_")
    within = Window.partitionBy("block_").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return inner.join(heads, "block_").withColumn(name, F.col("ahead_") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("block_", "ahead_")


def dealt(docs: DataFrame, file_bytes: int) -> tuple[DataFrame, int]:
    """(file, doc_id, text) and how many files: file numbers rise with doc_id, each file has about as many bytes of text.

    Quantiles of doc_id, a bounded number of them, cut the ids into ranges and equal steps cut those
    further; the bytes of each step are added up, and the running sum over the steps says the file.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = docs.agg(F.sum(held)).first()[0] or 0
    files = int(total // file_bytes)
    if files <= 1:
        return docs.select(F.lit(0).cast("long").alias("file"), "doc_id", "text"), 1
    ranges = min(files, RANGES)
    at = F.col("doc_id").cast("double")
    edges = sorted(set(docs.select(at.alias("d")).approxQuantile("d", [i / ranges for i in range(ranges + 1)], 0.1 / ranges)))
    steps = -(-STEPS * files // ranges)
    low, high = F.array(*map(F.lit, edges)), F.array(*map(F.lit, edges[1:] + edges[-1:]))
    k = F.least(F.greatest(F.size(F.filter(low, lambda e: e <= at)) - 1, F.lit(0)), F.lit(len(edges) - 1))
    width = F.greatest(F.get(high, k) - F.get(low, k), F.lit(1.0))
    inside = F.least(F.greatest(F.floor((at - F.get(low, k)) / width * steps), F.lit(0)), F.lit(steps - 1))
    placed = docs.withColumn("step", F.when(at.isNull(), F.lit(-1)).otherwise(k * steps + inside).cast("long"))
    sums = placed.groupBy("step").agg(F.sum(held).alias("held"))
    numbers = durable(running_before(sums, "step", "held", "ahead").select("step", F.floor(F.col("ahead") / file_bytes).cast("long").alias("file")))
    return placed.join(few(numbers), "step").select("file", "doc_id", "text"), files + 1


def _counts(batches):
    total = np.zeros(1 << 16, dtype=np.int64)
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        every = batch.column(0).to_pylist()
        for at in range(0, len(every), 500):
            total += np.bincount(np.frombuffer(b"".join(map(unpack.decompress, every[at : at + 500])), dtype="<u2"), minlength=1 << 16)
    used = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def write_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    data, offsets = huffman.encode(ids, lengths, codes)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    table = zlib.compress(lengths.tobytes(), 6)
    head = struct.pack("<8sQQQQ", MAGIC, len(names), len(ids), len(table), len(data))
    return b"".join((head, table, known.tobytes(), names.tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(), data))


def read_file(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of a file."""
    magic, docs, n, table, size = struct.unpack_from("<8sQQQQ", blob)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize("<8sQQQQ")
    lengths = np.frombuffer(zlib.decompress(blob[at : at + table]), dtype=np.uint8)
    at += table
    known = np.frombuffer(blob, np.uint8, docs, at)
    names = np.frombuffer(blob, "<i8", docs, at + docs)
    sizes = np.frombuffer(blob, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    blocks = -(-n // huffman.BLOCK)
    offsets = np.frombuffer(blob, "<u8", blocks, at)
    at += 8 * blocks
    ids = huffman.decode(blob[at : at + size], offsets, n, *huffman.decode_table(lengths))
    return [int(x) if k else None for x, k in zip(names, known)], sizes, ids


def write_files(docs: DataFrame, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The written files, read back: (file, part, tokens, blob); files and the parts of a file ascend with doc_id.

    Null text is empty; empty texts are the end id alone; rows of one doc_id stand together, by
    their ids; null doc_ids come first. Where many bytes have neighbouring ids, a file goes on in
    further parts, so no more than one part is held at a time. An empty table gives no file.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    numbered, files = dealt(docs, file_bytes)
    tokens = durable(tokenise(numbered, path).repartition(files, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "ids"))
    free_shuffles(spark)
    counts = tokens.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most a row per vocabulary entry
    total = np.zeros(1 << 16, dtype=np.int64)
    total[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    lengths = huffman.code_lengths(total)
    codes = huffman.canonical(lengths)
    most = file_bytes // 2

    def pack(batches):
        unpack, file, part, names, sizes, ids, held = zstandard.ZstdDecompressor(), None, 0, [], [], [], 0

        def done():
            blob = write_file(names, np.array(sizes), np.frombuffer(b"".join(ids), dtype="<u2"), lengths, codes)
            return pa.RecordBatch.from_arrays([pa.array([file], type=pa.int64()), pa.array([part], type=pa.int64()), pa.array([held], type=pa.int64()), pa.array([blob], type=pa.binary())], names=["file", "part", "tokens", "blob"])

        for batch in batches:
            for f, name, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if names and (f != file or held + n > most):
                    yield done()
                    part = part + 1 if f == file else 0
                    names, sizes, ids, held = [], [], [], 0
                file = f
                names.append(name)
                sizes.append(n)
                held += n
                ids.append(unpack.decompress(packed))
        if names:
            yield done()

    schema = "file long, part long, tokens long, blob binary"
    folder = scratch(spark, "token-files")
    tokens.mapInArrow(pack, schema).write.option("compression", "none").parquet(folder)
    del tokens
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(folder)


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    parts = files.select("file", "part", "tokens")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = running_before(parts.groupBy("file").agg(F.sum("tokens").alias("all")), "file", "all", "ahead")
    firsts = parts.withColumn("before", before).join(whole.select("file", "ahead"), "file").select("file", "part", (F.col("ahead") + F.col("before")).alias("base"))

    def unpack(batches):
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, sizes, ids = read_file(blob)
                ends = np.cumsum(sizes.astype(np.int64))
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.int64()), pa.array(base + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(few(firsts), ["file", "part"]).select("base", "blob").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_files(read(spark, sf_dir, "documents")))
