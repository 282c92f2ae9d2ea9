"""Language-model scoring: an interpolated modified Kneser-Ney bigram model over all documents.

Counting and scoring are exchanges between *flushes* (documents packed to a bounded size, written
once to the shared folder) and *shards* of the model (hash ranges). A shard holds its n-grams as
sorted hash arrays with their counts, in a memory-mapped file that answers by binary search:

1. Each flush sends the hashes and training counts of its different bigrams; a bigram's shard adds
   them up and answers with the total, naming one flush the bigram's owner.
2. Each flush sends its words' counts and, from the bigrams it owns, in how many contexts each word
   follows and how many words follow each word once, twice or more often; a word's shard adds
   these up and answers.
3. Each flush has all that its probabilities need: the discounts come from counts of counts, which
   the shards report (a few numbers each), and every document is summed up.

Only different n-grams travel, once for each flush however frequent they are, so neither frequent
words nor copies load one task; shards are even because keys are hashes. Counts are whole 64-bit numbers;
keys travel as differences, and all numbers byte by byte, so that zeros cost next to nothing.

The shards write their sorted hash arrays down with their answers. ``store`` keeps them as a model in a
folder, and ``apply`` scores other documents with it: each worker maps the arrays of the shards that it is
given and looks up what the documents' flushes ask for.
"""

from __future__ import annotations

import contextlib
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import IS_SPACE, durable, free_shuffles, mix64, read
from lodestar.llm.substrings import EXCHANGE, pack

BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C1B2A9F3)
FLUSH_BYTES = 6 << 20
SHARD_BYTES = 12 << 20
LONG = 64
_U = np.uint64


# ---------------------------------------------------------------- tokens


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start : start + size], eight bytes a round; long words one by one."""
    h = mix64(size.astype(np.uint64))
    last = max(len(data) - 1, 0)
    active = np.nonzero(size <= LONG)[0]
    at = 0
    while len(active):
        s, left = start[active] + at, size[active] - at
        w = np.zeros(len(active), dtype=np.uint64)
        for k in range(8):
            w |= np.where(left > k, data[np.minimum(s + k, last)], 0).astype(np.uint64) << _U(8 * k)
        h[active] = mix64(h[active] * _U(0x9E3779B97F4A7C15) + w)
        at += 8
        active = active[size[active] > at]
    for i in np.nonzero(size > LONG)[0]:
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), 42)
    return h


def different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes in rising order of their upper bits, which of them each element is, an element of each)."""
    n = len(h)
    if not n:
        return h, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = max(1, int(n).bit_length())
    order = (np.sort(h >> _U(low) << _U(low) | np.arange(n, dtype=np.uint64)) & _U((1 << low) - 1)).astype(np.int64)
    ordered = h[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    of = np.empty(n, dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    heads = np.nonzero(new)[0]
    return ordered[heads], of, order[heads]


class Tokens:
    """The tokens of a flush, its different words and bigrams."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids = np.frombuffer(ids, dtype="<i8")
        known, size = np.frombuffer(sizes, dtype="<i8").reshape(2, -1)
        self.names = [None if k < 0 else int(i) for i, k in zip(self.ids.tolist(), known)]
        self.held_out = np.array([n is not None and zlib.crc32(str(n).encode()) % 7 == 2 for n in self.names])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text).lower(), dtype=np.uint8)
        ends = np.cumsum(size)
        inside = ~IS_SPACE[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = (ends - size)[size > 0]
        begin[heads] = inside[heads]
        stop = np.zeros(len(data) + 1, dtype=bool)
        stop[1:] = inside
        stop[:-1] &= ~inside
        stop[ends[size > 0]] = inside[ends[size > 0] - 1] if len(data) else False
        start = np.nonzero(begin)[0]
        words = word_hashes(data, start, np.nonzero(stop)[0] - start)
        # every document's words, then its end
        per_doc = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(size))
        self.n_tokens = per_doc + 1
        self.last = np.cumsum(self.n_tokens)
        token = np.empty(int(self.last[-1]) if len(size) else 0, dtype=np.uint64)
        is_end = np.zeros(len(token), dtype=bool)
        is_end[self.last - 1] = True
        token[~is_end], token[is_end] = words, END
        self.first = self.last - self.n_tokens
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.first] = BEGIN
        trained = np.repeat(~self.held_out, self.n_tokens)
        word, of, _ = different(np.concatenate([token, np.array([BEGIN])]))
        self.word, self.token_of = word, of[:-1]
        begin_at = of[-1]
        context_of = np.empty_like(self.token_of)
        context_of[1:] = self.token_of[:-1]
        context_of[self.first] = begin_at
        self.word_count = np.bincount(self.token_of[trained], minlength=len(word))
        # for the begin mark, which is no token, the count is that of its contexts
        self.word_count[begin_at] = int((~self.held_out).sum())
        self.bigram, self.bigram_of, one = different(mix64(context * _U(0xC2B2AE3D27D4EB4F) + (token ^ token >> _U(29))))
        self.bigram_count = np.bincount(self.bigram_of[trained], minlength=len(self.bigram))
        self.left, self.right = context_of[one], self.token_of[one]

    @staticmethod
    def bounds(keys: np.ndarray, shards: int) -> np.ndarray:
        return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))


KEY_BITS = 48


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> _U(32)) * _U(shards) >> _U(32)


def within(keys: np.ndarray, shards: int) -> np.ndarray:
    """Each key's place within its shard, in KEY_BITS bits: rising as the keys do, and together with the shard as telling as those bits and the shard."""
    base = (shard_of(keys, shards) * _U(1 << 32) + _U(shards - 1)) // _U(shards) << _U(32)
    return (keys - base) >> _U(max(0, 64 - KEY_BITS - (shards.bit_length() - 1)))


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte, compressed."""
    n = len(columns[0])
    planes = np.stack([c.astype("<i8") for c in columns]).view(np.uint8).reshape(len(columns), n, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, columns: int) -> np.ndarray:
    """(columns, n) numbers of ``squeeze``."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[..., 0]


def squeeze_list(places: np.ndarray, *values: np.ndarray) -> bytes:
    """A rising list of places within a shard, with values."""
    return squeeze(np.diff(places.view(np.int64), prepend=0), *values)


def unsqueeze_list(data: bytes, values: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, (values, n)) of ``squeeze_list``."""
    found = unsqueeze(data, 1 + values)
    return np.cumsum(found[0]).view(np.uint64), found[1:]


# ---------------------------------------------------------------- shards


@contextlib.contextmanager
def mapped(keys: np.ndarray, *values: np.ndarray):
    """The sorted hash array and its value arrays, memory-mapped from a file that goes with the block."""
    with tempfile.NamedTemporaryFile() as f:
        for a in (keys, *values):
            f.write(np.ascontiguousarray(a, dtype=np.int64 if a.dtype != np.uint64 else np.uint64).tobytes())
        f.flush()
        n = len(keys)
        table = np.memmap(f.name, dtype=np.int64, mode="r", shape=(1 + len(values), max(n, 1))) if n else np.zeros((1 + len(values), 0), dtype=np.int64)
        yield table[0].view(np.uint64), [table[k + 1] for k in range(len(values))]
        del table


#: Under these flush numbers a shard writes what it reports and its sorted arrays.
REPORT, ARRAYS = -1, -2


def _lists(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys of every flush's list, (width, all) values)."""
    found = [unsqueeze_list(blob, width) for blob in table.column("blob").to_pylist()]
    return [k for k, _ in found], np.concatenate([v for _, v in found], axis=1)


def _sums(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Whole sums by group."""
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, of, value)
    return out


def _answer(table: pa.Table, blobs: list[bytes], shard: int, stats: list[int], arrays: bytes) -> pa.Table:
    """The answers, what the shard reports and its sorted arrays."""
    return pa.table({
        "shard": pa.array([shard] * (len(blobs) + 2), type=pa.int32()),
        "flush": pa.array([*table.column("flush").to_pylist(), REPORT, ARRAYS], type=pa.int64()),
        "blob": pa.array([*blobs, np.array(stats, dtype="<i8").tobytes(), arrays], type=pa.binary())})


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _bigram_shard(key, table):
    keys, values = _lists(table, 1)
    every, count = np.concatenate(keys), values[0]
    known, of = np.unique(every, return_inverse=True)
    total = _sums(of, count, len(known))
    owner = np.full(len(known), len(every))
    has = np.nonzero(count)[0]
    np.minimum.at(owner, of[has], has)
    blobs, at = [], 0
    for k in keys:
        place = of[at : at + len(k)]
        blobs.append(squeeze(total[place] << 1 | (owner[place] == np.arange(at, at + len(k)))))
        at += len(k)
    return _answer(table, blobs, key[0].as_py(), _of_counts(total), squeeze_list(known, total))


def _word_shard(shards: int):
    begin = np.array([BEGIN])
    home, place = int(shard_of(begin, shards)[0]), within(begin, shards)[0]

    def run(key, table):
        keys, values = _lists(table, 5)
        known, of = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([_sums(of, v, len(known)) for v in values])
        blobs, at = [], 0
        for k in keys:
            blobs.append(squeeze(*sums[:, of[at : at + len(k)]]))
            at += len(k)
        token = known != place if key[0].as_py() == home else np.ones(len(known), dtype=bool)  # the begin mark is no token
        count, follows = sums[0][token], sums[1][token]
        return _answer(table, blobs, key[0].as_py(), [int(count.sum()), int((count > 0).sum()), int(follows.sum()), *_of_counts(follows), int((follows > 2).sum())], squeeze_list(known, *sums))
    return run


def _look_up(width: int):
    """What a worker does with a shard of a stored model and the keys that flushes ask for: map, search, answer."""
    def run(key, asked, stored):
        arrays = [unsqueeze_list(blob, width) for blob in stored.column("blob").to_pylist()]
        keys, values = arrays[0] if arrays else (np.zeros(0, dtype=np.uint64), np.zeros((width, 0), dtype=np.int64))
        blobs = []
        with mapped(keys, *values) as (sorted_keys, columns):
            for blob in asked.column("blob").to_pylist():
                k, _ = unsqueeze_list(blob, 0)
                place = np.minimum(np.searchsorted(sorted_keys, k), max(len(sorted_keys) - 1, 0))
                there = sorted_keys[place] == k if len(sorted_keys) else np.zeros(len(k), dtype=bool)
                found = [np.where(there, c[place], 0) if len(sorted_keys) else np.zeros(len(k), dtype=np.int64) for c in columns]
                blobs.append(squeeze(found[0] << 1) if width == 1 else squeeze(*found))
        return pa.table({"shard": asked.column("shard"), "flush": asked.column("flush"), "blob": pa.array(blobs, type=pa.binary())})
    return run


# ---------------------------------------------------------------- model


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from the counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [0.0] + [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([min(max(d, 0.0), k) for k, d in enumerate(raw)])


class Model:
    def __init__(self, bigram_stats: list[int], word_stats: list[int]):
        self.tokens, self.vocabulary, self.types = word_stats[:3]
        t = word_stats[3:7]
        self.d2, self.d1 = discounts(bigram_stats), discounts(t)
        rest = self.d1[1] * t[0] + self.d1[2] * t[1] + self.d1[3] * word_stats[7]
        self.spare = rest / self.types if self.types else 1.0

    def probability(self, count, follows, context, once, twice, more):
        """P(w | v) from c(vw), the contexts of w, and v's count and its numbers of followers."""
        low = np.maximum(follows - self.d1[np.minimum(follows, 3)], 0) / max(self.types, 1) + self.spare / (self.vocabulary + 1)
        seen = np.maximum(context, 1)
        high = np.maximum(count - self.d2[np.minimum(count, 3)], 0) / seen
        gamma = (self.d2[1] * once + self.d2[2] * twice + self.d2[3] * more) / seen
        return np.where(context > 0, high + gamma * low, low)


def _sent(flush: int, keys: np.ndarray, values: list[np.ndarray], shards: int):
    cut, places = Tokens.bounds(keys, shards), within(keys, shards)
    here = [s for s in range(shards) if cut[s + 1] > cut[s]]
    blobs = [squeeze_list(places[cut[s] : cut[s + 1]], *[v[cut[s] : cut[s + 1]] for v in values]) for s in here]
    return pa.RecordBatch.from_arrays([pa.array(here, type=pa.int32()), pa.array([flush] * len(here), type=pa.int64()), pa.array(blobs, type=pa.binary())], names=["shard", "flush", "blob"])


def _answers(blobs: list[bytes], width: int) -> np.ndarray:
    """(width, n): the shards' answers to a flush, in the order of its keys."""
    return np.concatenate([unsqueeze(b, width) for b in blobs], axis=1) if blobs else np.zeros((width, 0), dtype=np.int64)


def _with_answers(asked: DataFrame, *kinds: tuple[str, DataFrame]) -> DataFrame:
    for name, frame in kinds:
        one = frame.where("flush >= 0").groupBy("flush").agg(F.sort_array(F.collect_list(F.struct("shard", "blob"))).alias(name)).select("flush", F.col(f"{name}.blob").alias(name))
        asked = asked.join(one, "flush", "left")
    return asked


def _reported(frame: DataFrame, width: int) -> list[int]:
    total = np.zeros(width, dtype=np.int64)
    for row in frame.where(F.col("flush") == REPORT).select("blob").toLocalIterator():  # a few numbers a shard
        total += np.frombuffer(row[0], dtype="<i8")
    return total.tolist()


def _counted(flushes: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The shards' answers, reports and arrays for bigrams and for words."""
    def send_bigrams(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row["ids"], row["sizes"], row["text"])
                yield _sent(row["flush"], t.bigram, [t.bigram_count], shards)

    bigrams = durable(flushes.mapInArrow(send_bigrams, EXCHANGE).groupBy("shard").applyInArrow(_bigram_shard, EXCHANGE))
    free_shuffles(flushes.sparkSession)

    def send_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row["ids"], row["sizes"], row["text"])
                got = _answers(row["bigrams"], 1)[0]
                count, own = got >> 1, (got & 1) == 1
                n = len(t.word)
                tally = lambda which, who: np.bincount(who[own & which], minlength=n)
                yield _sent(row["flush"], t.word, [t.word_count, tally(count > 0, t.right), tally(count == 1, t.left), tally(count == 2, t.left), tally(count > 2, t.left)], shards)

    words = durable(_with_answers(flushes, ("bigrams", bigrams)).mapInArrow(send_words, EXCHANGE).groupBy("shard").applyInArrow(_word_shard(shards), EXCHANGE))
    free_shuffles(flushes.sparkSession)
    return bigrams, words


def _flushes(docs: DataFrame) -> tuple[DataFrame, int]:
    """The flushes of ``docs`` and how many shards their n-grams ask for."""
    flushes = durable(pack(docs, FLUSH_BYTES))
    size = flushes.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return flushes, max(4, -(-3 * size // SHARD_BYTES))


def _finished(flushes: DataFrame, bigrams: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row["ids"], row["sizes"], row["text"])
                count = _answers(row["bigrams"], 1)[0] >> 1
                total, follows, once, twice, more = _answers(row["words"], 5)
                p = model.probability(count, follows[t.right], total[t.left], once[t.left], twice[t.left], more[t.left])
                per_token = np.log10(p)[t.bigram_of]
                base = np.log10((total + 1) / (model.tokens + model.vocabulary + 1))[t.token_of]
                known = total[t.token_of] > 0
                at = t.first
                sums = [np.add.reduceat(x, at) for x in (known.astype(np.int64), base, per_token)]
                n = len(t.names)
                yield pa.RecordBatch.from_arrays([
                    pa.array(t.names, type=pa.int64()), pa.array(t.held_out), pa.array(t.n_tokens.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(n, model.tokens, dtype=np.int64)),
                    pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** (-sums[2] / t.n_tokens))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return _with_answers(flushes, ("bigrams", bigrams), ("words", words)).mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of (doc_id, text).

    Rows whose crc32(doc_id as text) mod 7 is 2 teach nothing. Null and empty texts are their end
    token alone; a row without doc_id is trained on; repeated rows count each time. Without any
    training row all words are unknown and equally likely. An empty table gives an empty result.
    """
    flushes, shards = _flushes(docs)
    bigrams, words = _counted(flushes, shards)
    return _finished(flushes, bigrams, words, Model(_reported(bigrams, 4), _reported(words, 8)))


def store(docs: DataFrame, folder: str) -> None:
    """The model of ``docs`` in ``folder``: each shard's sorted hash arrays and reports; the counts are whole."""
    flushes, shards = _flushes(docs)
    for name, frame in zip(("bigrams", "words"), _counted(flushes, shards)):
        frame.where("flush < 0").withColumn("shards", F.lit(shards)).write.option("compression", "none").parquet(f"{folder}/{name}")


def apply(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """What ``score`` gives, for other documents and with the model that ``store`` left in ``folder``."""
    stored = [spark.read.parquet(f"{folder}/{name}") for name in ("bigrams", "words")]
    shards = int(stored[0].agg(F.max("shards")).first()[0] or 4)
    flushes, _ = _flushes(docs)

    def ask(which: str):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield _sent(row["flush"], getattr(Tokens(row["ids"], row["sizes"], row["text"]), which), [], shards)
        return flushes.mapInArrow(run, EXCHANGE).groupBy("shard")

    found = [durable(ask(which).cogroup(frame.where(F.col("flush") == ARRAYS).select("shard", "flush", "blob").groupBy("shard")).applyInArrow(_look_up(width), EXCHANGE)) for which, frame, width in (("bigram", stored[0], 1), ("word", stored[1], 5))]
    return _finished(flushes, *found, Model(_reported(stored[0], 4), _reported(stored[1], 8)))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
