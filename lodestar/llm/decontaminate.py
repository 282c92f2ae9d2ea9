"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Items are compared as patterns: windows of ``WINDOW`` characters every ``STRIDE`` and up to ``WHOLE``
characters whole as well, so that every verbatim part of ``WINDOW + STRIDE - 1`` characters is found. A pattern of m characters that occurs in a text
with at most e edits shares at least m - q + 1 - q * e of its q-grams with it, all on diagonals no
further than e apart. Shared q-grams are therefore counted in diagonal bands of twice the width
e + 1 that overlap by half; bands that reach the bound are verified by an alignment that is
confined to the band.

Items of fewer than q characters have no q-gram; they are sought exactly, as whole words.

The patterns' q-grams go to the workers in blocks of at most ``BLOCK_GRAMS``, each a pass of its
own, so what is broadcast has a fixed bound however large the benchmark is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import mix64, read

Q = 10
ERROR_RATE = 0.07
WINDOW = 60
STRIDE = 15
#: Longer items need not be compared whole: of two windows side by side one has half the edits at most.
WHOLE = 150
BLOCK_GRAMS = 500_000
#: Up to so many characters of texts are searched at once.
BLOCK_CHARS = 1 << 20
#: Longer texts are searched in overlapping parts of so many characters, so many shared q-grams at a time.
PART_CHARS = 1 << 20
OCCURRENCES = 2_000_000
BITMAP_LOG2 = 22
_P = 0x9E3779B97F4A7C15 | 1


def normal(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of every q-gram, by powers of two of its length."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = lambda k: np.uint64(pow(_P, k, 1 << 64))
    h, width = c.astype(np.uint64) + np.uint64(1), 1
    out, have, at = None, 0, 0
    while True:
        if q & width:
            part = h[at : at + n]
            out = part.copy() if out is None else out * power(width) + part
            at += width
        width *= 2
        if width > q:
            break
        h = h[: -width // 2] * power(width // 2) + h[width // 2 :]
    return mix64(out)


class Patterns:
    """One block of patterns with its q-gram index, and the (item, text) of items too short for it."""

    def __init__(self, items: list[int], texts: list[str], q: int = Q, rate: float = ERROR_RATE, short: list[tuple[int, str]] = ()):
        self.items, self.texts, self.q = items, texts, q
        self.of_item: dict[int, list[str]] = {}
        for item, text in zip(items, texts):
            self.of_item.setdefault(item, []).append(text)
        #: short texts by their number of words, with their items
        self.short: dict[int, dict[str, list[int]]] = {}
        for item, text in short:
            self.short.setdefault(text.count(" ") + 1, {}).setdefault(text, []).append(item)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.sizes = sizes
        #: the edit budget, no more than leaves one q-gram to count
        self.edits = np.minimum((sizes * rate).astype(np.int64), np.maximum(sizes - q, 0) // q)
        self.bound = sizes - q + 1 - q * self.edits
        self.width = self.edits + 1
        grams = [gram_hashes(codes(t), q) for t in texts]
        every = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << BITMAP_LOG2, dtype=bool)
        self.bitmap[(self.keys >> np.uint64(64 - BITMAP_LOG2)).astype(np.int64)] = True

    def candidates(self, text: np.ndarray):
        """(pattern, first diagonal) of every band that reaches its pattern's bound, in pieces of bounded size."""
        if not len(self.keys):
            return
        overlap = int(self.sizes.max() + 2 * self.width.max()) + self.q
        for begin in range(0, max(len(text), 1), PART_CHARS):
            for pattern, diagonal in self._bands(text[begin : begin + PART_CHARS + overlap]):
                yield pattern, diagonal + begin

    def _bands(self, text: np.ndarray):
        h = gram_hashes(text, self.q)
        at = np.nonzero(self.bitmap[(h >> np.uint64(64 - BITMAP_LOG2)).astype(np.int64)])[0]
        if not len(at):
            return
        key = np.searchsorted(self.keys, h[at])
        key = np.minimum(key, len(self.keys) - 1)
        real = self.keys[key] == h[at]
        at, key = at[real], key[real]
        total = np.cumsum(self.count[key])
        span = int(len(text) + self.sizes.max() + 2)
        held, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        begin = 0
        while begin < len(at):  # so many occurrences at a time as fit
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + OCCURRENCES, side="right")))
            n = self.count[key[begin:end]]
            where = np.repeat(at[begin:end], n)
            listed = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[key[begin:end]], n)
            pattern = self.owner[listed]
            band = (where - self.place[listed] + self.sizes[pattern]) // self.width[pattern]
            new, n = np.unique(np.concatenate([pattern * span + band, pattern * span + np.maximum(band - 1, 0)]), return_counts=True)
            every, of = np.unique(np.concatenate([held, new]), return_inverse=True)
            counts = np.bincount(of, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)
            pattern, band = every // span, every % span
            # what follows is on later diagonals: bands before them are complete
            done = np.ones(len(every), dtype=bool) if end == len(at) else band < at[end] // self.width[pattern] - 1
            good = done & (counts >= self.bound[pattern])
            if good.any():
                yield pattern[good], band[good] * self.width[pattern[good]] - self.sizes[pattern[good]]
            held, counts, begin = every[~done], counts[~done], end

    def short_matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, 0, end) of the short items that stand in a normal text as whole words."""
        found = []
        if self.short:
            words, framed = text.split(" "), f" {text} "
            for n, known in self.short.items():
                here = known.keys() & (words if n == 1 else map(" ".join, zip(*(words[k:] for k in range(n)))))
                found += [(item, 0, framed.index(f" {t} ") + len(t)) for t in here for item in known[t]]
        return sorted(found)

    def verify(self, text: np.ndarray, pattern: int, diagonal: int) -> tuple[int, int] | None:
        """(edits, end in the text) of the best alignment within the band, if within the budget."""
        return banded(codes(self.texts[pattern]), text, diagonal, 2 * int(self.width[pattern]), int(self.edits[pattern]))


def banded(pattern: np.ndarray, text: np.ndarray, diagonal: int, width: int, edits: int) -> tuple[int, int] | None:
    """The least edits that turn ``pattern`` into a piece of ``text`` on diagonals diagonal - edits to diagonal + width + edits."""
    low, n = diagonal - edits, width + 2 * edits + 1
    far = len(pattern) + n + 1
    step = np.arange(n)
    start = low + step
    row = np.where((start >= 0) & (start <= len(text)), 0, far)  # free start anywhere in the band
    padded = np.concatenate([text, np.array([0xFFFFFFFF], dtype=text.dtype)])
    for i, c in enumerate(pattern):
        at = low + i + step  # column j - 1 of the cell on each diagonal
        same = (at >= 0) & (at < len(text)) & (padded[np.clip(at, 0, len(text))] == c)
        straight = np.where((at >= 0) & (at < len(text)), row + ~same, far)
        down = np.concatenate([row[1:], [far]]) + 1  # a pattern character dropped: one diagonal back
        new = np.minimum(straight, down)
        new = np.where((at + 1 >= 0) & (at + 1 <= len(text)), new, far)
        row = np.minimum.accumulate(new - step) + step  # text characters put in
        if row.min() > edits:
            return None
    best = int(row.argmin())
    return (int(row[best]), low + len(pattern) + best) if row[best] <= edits else None


def patterns(items: list[tuple[int, str]]) -> list[Patterns]:
    """The benchmark's patterns in blocks of bounded size; items without characters have none."""
    blocks, ids, texts, short, held = [], [], [], [], 0
    for item, text in items:
        t = normal(text)
        if not t:
            continue
        if len(t) < Q:
            short.append((item, t))
            pieces = []
        else:
            pieces = [t] if len(t) <= WHOLE else [t[-2 * WINDOW : -WINDOW]]
        if len(t) > WINDOW:
            pieces += [t[s : s + WINDOW] for s in [*range(0, len(t) - WINDOW, STRIDE), len(t) - WINDOW]]
        for piece in pieces:
            ids.append(item)
            texts.append(piece)
        held += sum(map(len, pieces)) or Q
        if held >= BLOCK_GRAMS:
            blocks.append(Patterns(ids, texts, short=short))
            ids, texts, short, held = [], [], [], 0
    if held:
        blocks.append(Patterns(ids, texts, short=short))
    return blocks


def matches(block: Patterns, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For every (normal) text: (item, edits, end) of the items found in it, best first."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK_CHARS):
            held += len(texts[end]) + 1
            end += 1
        every = codes("\0".join(texts[at:end]))
        sizes = np.array([len(t) + 1 for t in texts[at:end]], dtype=np.int64)
        ends = np.cumsum(sizes)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for pattern, diagonal in block.candidates(every):
            for p, d in zip(pattern.tolist(), diagonal.tolist()):
                middle = d + int(block.sizes[p]) // 2 + int(block.width[p])
                for k in {int(np.searchsorted(ends, x, side="right")) for x in (max(0, d + int(block.width[p])), max(0, middle), max(0, d + int(block.sizes[p])))}:
                    if k >= len(sizes):
                        continue
                    begin = int(ends[k] - sizes[k])
                    key = (k, block.items[p])
                    if best.get(key, (1,))[0] == 0:
                        continue
                    got = block.verify(every[begin : int(ends[k]) - 1], p, d - begin)
                    if got and (key not in best or got < best[key]):
                        best[key] = got
        for (k, item), (edits, _) in best.items():
            if edits == 0:  # the first of its exact quotes
                best[k, item] = 0, min(x + len(p) for p in block.of_item[item] if (x := texts[at + k].find(p)) >= 0)
        for k in range(at, end):
            out[k] += block.short_matches(texts[k])
        for (k, item), (edits, stop) in sorted(best.items(), key=lambda x: (x[0][0], x[1][0], x[0][1])):
            out[at + k].append((item, edits, stop))
        at = end
    return out


def benchmark_blocks(benchmark: DataFrame):
    """The pattern blocks, read from the items one at a time so only one block is held."""
    ids, held = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().toLocalIterator():
        ids.append((row[0], row[1]))
        held += len(row[1]) * (WINDOW // STRIDE + 1)
        if held >= BLOCK_GRAMS:
            yield from patterns(sorted(ids))
            ids, held = [], 0
    if ids:
        yield from patterns(sorted(ids))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, text_end): a row for every row of ``docs`` and item that it quotes.

    ``text_end`` is where the quote ends in the normalised text. Null texts and items quote
    nothing; items of fewer than Q characters count where they stand as whole words; repeated rows
    are found once a doc_id; an empty table on either side gives an empty result. Long texts are
    searched whole, in parts of bounded size.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, edits long, text_end long"
    out = spark.createDataFrame([], schema)
    for block in benchmark_blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), [normal(t) for t in batch.column(1).to_pylist()]
                rows = [(name, *m) for name, found in zip(names, matches(held.value, texts)) for m in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "edits", "text_end"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "text_end")).alias("best")).select("doc_id", "item_id", "best.edits", "best.text_end")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quote no item, all columns as they are; texts do not move between tasks."""
    for block in benchmark_blocks(benchmark):
        held, at = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")

        def run(batches, held=held, at=at):
            for batch in batches:
                found = matches(held.value, [normal(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not m for m in found], type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
