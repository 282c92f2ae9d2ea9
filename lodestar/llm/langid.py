"""Language identification with bit-sliced Bloom filters of n-grams.

Each language's byte n-grams go into its own Bloom filter; the filters are stored side by side, one
bit plane per language, so that one probe of a slot returns a bit mask of languages and the AND of
an n-gram's slots is the set of all languages that contain it. A text's n-grams are counted per
language bit, each count is corrected for that filter's false-positive rate, and the largest
decides; between equal ones the n-grams that no other language contains do.

The filters have a fixed size a language. They are fitted on at most about ``SAMPLE`` whole texts of
each labelled language (chosen by a hash of doc_id); a language contains an n-gram that was seen
``LEAST`` times there.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import durable, few, read, text_bytes

GRAM = 4
SLOTS_LOG2 = 21
PROBES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
SAMPLE = 3000
LEAST = 4
#: A text is of no learned language if its share is less than this by more than twice its sampling error, 1 / sqrt(n-grams).
REJECT = 0.5
#: Up to so many bytes of texts are counted at once.
BLOCK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def grams(data: bytes) -> np.ndarray:
    """Every byte 4-gram of ``data`` as a 32-bit number, A-Z in lower case and separators as blanks."""
    b = np.frombuffer(data.lower().translate(BLANKS), dtype=np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, dtype=np.uint32)
    return b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


BLANKS = bytes(0x20 if x < 0x20 or 0x21 <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256))


def _count_grams(batches):
    """(lang, gram, n): per task and language, the n-grams of the texts and how often."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = text_bytes(batch.column(0))
        for lang in sorted(set(langs)):
            own, held = [t for t, x in zip(texts, langs) if x == lang], 0
            parts: list[np.ndarray] = []
            for t in [*own, None]:
                if t is not None:
                    parts.append(grams(b" " + t + b" "))
                    held += len(parts[-1])
                if parts and (t is None or held > BLOCK):
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    parts, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def slots(gram: np.ndarray, slots_log2: int = SLOTS_LOG2):
    """The slots of every n-gram, a probe at a time."""
    for k in PROBES:
        h = gram * k
        h ^= h >> np.uint32(15)
        yield h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - slots_log2)


def bits_of(gram: np.ndarray, slots_log2: int = SLOTS_LOG2) -> np.ndarray:
    """One language's filter, packed eight slots a byte."""
    plane = np.zeros(1 << slots_log2, dtype=bool)
    for slot in slots(gram, slots_log2):
        plane[slot] = True
    return np.packbits(plane)


class Filters:
    """The bit planes: a mask of languages per slot, and each plane's false-positive rate.

    ``packed`` has each language's filter, ``fallback`` what is said of letters that no language knows.
    """

    def __init__(self, langs: list[str], packed: list[np.ndarray], fallback: str | None = None, slots_log2: int = SLOTS_LOG2):
        self.langs, self.slots_log2, self.fallback = langs, slots_log2, fallback
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.planes = [np.zeros(1 << slots_log2, dtype=kind) for _ in range((len(langs) + 63) // 64)]
        fill = np.zeros(len(langs))
        for i, own in enumerate(packed):
            plane = np.unpackbits(own)
            fill[i] = plane.mean()
            self.planes[i // 64] |= plane.astype(kind) << kind(i % 64)
        self.false = fill ** len(PROBES)

    def shares(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) corrected share of each text's n-grams that the language has, the same of those
        that it alone has, and the texts' numbers of n-grams."""
        sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
        # a text's last three n-grams reach into the next one: they are blanks' and cut off below
        g = grams(b"".join(b" " + t + b" " for t in texts) + b"   ")
        ends = np.cumsum(sizes)
        starts, ends = ends - sizes, np.maximum(ends - sizes, ends - GRAM + 1)
        out, own = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs)))
        blank = np.uint32(0x20202020)
        real = np.concatenate([[0], np.cumsum(g != blank)])
        n = real[ends] - real[starts]
        masks = []
        for plane in self.planes:
            mask = None
            for slot in slots(g, self.slots_log2):
                mask = plane[slot] if mask is None else mask & plane[slot]
            mask[g == blank] = 0
            masks.append(mask)
        several = np.zeros(len(g), dtype=bool)
        for k, mask in enumerate(masks):
            several |= (mask & (mask - mask.dtype.type(1))) != 0
            for other in masks[k + 1 :]:
                several |= (mask != 0) & (other != 0)
        counted = lambda flags: (lambda upto: (upto[ends] - upto[starts]) / np.maximum(n, 1))(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))
        for i in range(len(self.langs)):
            mask = masks[i // 64]
            flags = (mask >> mask.dtype.type(i % 64) & mask.dtype.type(1)).astype(bool)
            out[:, i], own[:, i] = counted(flags), counted(flags & ~several)
        return np.clip((out - self.false) / (1 - self.false), 0, 1), own, n

    def decide(self, texts: list[bytes], known: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, kept) of each text; ``known`` False gives und. The score is the share of the best in the best two."""
        lettered = np.array(known, dtype=bool)
        if not self.langs or not texts:
            return [self.fallback if k and self.fallback else UNKNOWN for k in known], np.zeros(len(texts)), lettered & bool(self.fallback)
        share, own, n = self.shares(texts)
        best = (share + 1e-6 * own).argmax(axis=1)
        top = share[np.arange(len(texts)), best]
        second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(texts))
        score = np.where(lettered, top / np.maximum(top + second, 1e-12), 0.0)
        names = [UNKNOWN if not k else self.langs[b] if t > 0 else self.fallback or self.langs[0] for k, b, t in zip(known, best, top)]
        return names, score, lettered & (top + 2 / np.sqrt(np.maximum(n, 1)) >= REJECT)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, kept) of each text, a bounded number of bytes at a time; texts of no learned language are not kept."""
        preds, scores, kept, at = [], [np.zeros(0)], [np.zeros(0, dtype=bool)], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held < BLOCK):
                held += len(texts[end] or "")
                end += 1
            part = texts[at:end]
            pred, score, keep = self.decide([(t or "").encode() for t in part], [bool(t and LETTER.search(t)) for t in part])
            preds += pred
            scores.append(score)
            kept.append(keep)
            at = end
        return preds, np.concatenate(scores), np.concatenate(kept)


def _plane(key, table):
    return pa.table({"lang": pa.array([key[0].as_py()], type=pa.string()), "plane": pa.array([bits_of(table.column("gram").to_numpy().astype(np.uint32)).tobytes()], type=pa.binary())})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from (doc_id, text, lang), of which rows with null text or lang teach nothing."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = durable(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    first = sizes.orderBy(F.desc("rows"), "lang").first()
    place = F.xxhash64(F.lit(5), F.col("doc_id")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    chosen = rows.join(few(sizes), "lang").where(place * F.col("rows") < sample).select("text", "lang")
    counts = chosen.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    planes = counts.where(F.col("n") >= LEAST).groupBy("lang").applyInArrow(_plane, "lang string, plane binary")
    # a filter of fixed size for each language
    held = sorted((r["lang"], r["plane"]) for r in planes.toLocalIterator())
    return Filters([x for x, _ in held], [np.frombuffer(p, dtype=np.uint8) for _, p in held], first["lang"] if first else None)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text); nothing else is looked at.

    Null text and text without any letter are und with score 0, as is everything if no language
    was learned; letters of which no n-gram is known are given the commonest language, with score 0.
    Whole texts count; repeated rows and equal texts get equal answers.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)  # the planes have a fixed size

    def run(batches):
        for batch in batches:
            pred, score, _ = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, type=pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for the rows that teach nothing; rows without doc_id do teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
