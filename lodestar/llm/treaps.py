"""Ranked search over inverted treaps.

The documents are cut into shards of bounded size, each an index by itself: for every term a treap
over its postings, in search order by document and in heap order by impact, as arrays of links. What
the corpus as a whole decides (documents, terms, documents of each term) is counted first, so the
impacts of all shards compare. A search walks the treaps of a query's terms together: a state is an
interval of documents with each term's root in it; the roots' impacts sum to a bound on every
document inside, and a state whose bound cannot enter the best k is dropped with all its subtrees.
Otherwise the root of the largest share names a document, which is scored, and the state is
split there. States of many queries go through numpy at once.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import durable, read, scratch, small_batches, text_bytes

#: Postings of a shard; a document's stay together.
POSTINGS = 1_000_000
#: Query terms that are sent to all at once; more queries take more passes.
BLOCK_TERMS = 200_000
#: (term, state) pairs that a walk holds at once, and queries that it starts with.
PAIRS, QUERIES = 200_000, 32
TOP = 10
#: Rounds of pointer jumping before the rest is linked one by one.
JUMPS = 64
#: Tasks' results are merged in so many parts first.
SALTS = 64
#: What stands for a missing doc_id, before all others.
NO_ID = np.iinfo(np.int64).min
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = "ids binary, terms array<binary>, first binary, doc binary, impact binary, down binary"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes over 0x7F, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def _count(batches):
    """(term, df, total): the documents of each term; without term, all documents that have terms and all their terms."""
    for batch in batches:
        df, docs, total = Counter(), 0, 0
        for text in text_bytes(batch.column(0)):
            found = terms_of(text)
            df.update(set(found))
            docs, total = docs + bool(found), total + len(found)
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([docs, *df.values()], pa.int64()), pa.array([total, *[0] * len(df)], pa.int64())], names=["term", "df", "total"])


def counts(docs: DataFrame) -> DataFrame:
    """The corpus' counts; see ``_count``."""
    with small_batches(docs.sparkSession, 200):
        return durable(docs.select("text").mapInArrow(_count, "term binary, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))


def corpus_size(counted: DataFrame) -> tuple[int, int]:
    """(N, L): documents with terms, all their terms."""
    row = counted.where("term is null").first()
    return (row.df, row.total) if row else (0, 0)


def _nearest(value: np.ndarray, group: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For each place the nearest one to the left (step -1) or right (1) in its group with a larger value, or an equal one if ``equal``; else -1."""
    n = len(value)
    at = np.arange(n) + step
    if n:
        at[0 if step < 0 else -1] = -1
    open_ = np.nonzero(at >= 0)[0]
    out_of = group[at[open_]] != group[open_]
    at[open_[out_of]] = -1
    open_ = open_[~out_of]
    for _ in range(JUMPS):
        if not len(open_):
            return at
        met = value[at[open_]]
        passed = met < value[open_] if equal else met <= value[open_]
        open_ = open_[passed]
        at[open_] = at[at[open_]]  # all in between are passed too
        open_ = open_[at[open_] >= 0]
    for g in np.unique(group[open_]):  # long runs of falling values before a large one
        some = np.nonzero(group == g)[0][::-step]
        stack: list[int] = []
        for i in some.tolist():
            while stack and (value[stack[-1]] < value[i] or (not equal and value[stack[-1]] == value[i])):
                stack.pop()
            at[i] = stack[-1] if stack else -1
            stack.append(i)
    return at


def treaps(term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """(2, n): left and right child of every posting, -1 for none; postings are ordered by term and document, equal impacts hang to the right."""
    impact = impact.astype(np.int64)
    left, right = _nearest(impact, term, -1, True), _nearest(impact, term, 1, False)
    none = np.iinfo(np.int64).max
    value = lambda at: np.where(at >= 0, impact[at], none)
    to_left = (left >= 0) & (value(left) < value(right))  # of equal ones the right hangs below the left
    parent = np.where(to_left, left, right)
    down = np.full((2, len(impact)), -1, dtype=np.int32)
    me = np.arange(len(impact))
    down[1, parent[to_left]] = me[to_left]
    down[0, parent[~to_left & (right >= 0)]] = me[~to_left & (right >= 0)]
    return down


class Postings:
    """The postings of some documents as numbers: 8 bytes each, and their terms once."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.number: dict[bytes, int] = {}
        self.term, self.tf, self.many, self.size = array("i"), array("i"), array("i"), []

    def add(self, doc: int | None, found: list[bytes]) -> None:
        bag, number = Counter(found), self.number
        self.ids.append(doc)
        self.term.extend([number.setdefault(t, len(number)) for t in bag])
        self.tf.extend(bag.values())
        self.many.append(len(bag))
        self.size.append(len(found))

    def shard(self, n: int, total: int) -> pa.RecordBatch:
        """The index of these documents, in order of doc_id."""
        order = np.array(sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0)), dtype=np.int64)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        term, doc = np.frombuffer(self.term, np.int32), np.repeat(place, np.frombuffer(self.many, np.int32))
        by = np.argsort(term.astype(np.int64) * len(order) + doc, kind="stable")
        term, doc, tf = term[by], doc[by], np.frombuffer(self.tf, np.int32)[by].astype(np.int64)
        m = np.array([25 + 75 * self.size[i] * n // total for i in order], dtype=np.int64)  # Python's integers do not overflow
        impact = (1_000_000_000 * tf // (1000 * tf + 8 * m[doc])).astype(np.int32)
        first = np.searchsorted(term, np.arange(len(self.number) + 1)).astype(np.int32)
        told = np.array([NO_ID if self.ids[i] is None else self.ids[i] for i in order], dtype=np.int64)
        columns = {"ids": told.tobytes(), "terms": list(self.number), "first": first.tobytes(), "doc": doc.tobytes(), "impact": impact.tobytes(), "down": treaps(term, impact).tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.binary()) if k == "terms" else pa.binary()) for k, x in columns.items()], names=list(columns))


def build(docs: DataFrame, folder: str, postings: int = POSTINGS) -> tuple[DataFrame, int, int]:
    """Write the index of every row of ``docs(doc_id, text)`` to ``folder``; returns (counts, N, L).

    Null texts and texts without terms are in no treap. A shard has so many postings at least,
    unless its partition ends, and one document more at most.
    """
    counted = counts(docs)
    n, total = corpus_size(counted)

    def run(batches):
        held = Postings()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                found = terms_of(text)
                if found:
                    held.add(doc, found)
                if len(held.term) >= postings:
                    yield held.shard(n, total)
                    held = Postings()
        if held.ids:
            yield held.shard(n, total)

    with small_batches(docs.sparkSession, 200):
        # a file for each shard: rows of one file are held together, by its writer and by its reader, whatever their size
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX).write.option("maxRecordsPerFile", 1).parquet(folder)
    return counted, n, total


class Best:
    """The k best (score, doc_id) of each query so far, more first, equal scores by rising doc_id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.score, self.doc = k, np.zeros((queries, k), dtype=np.int64), np.full((queries, k), np.iinfo(np.int64).max)

    def may_enter(self, query: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a document of at most this score and at least this doc_id could be among the best."""
        last = self.score[query, -1]
        return (bound > last) | ((bound == last) & (bound > 0) & (least < self.doc[query, -1]))

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        touched, of = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), of])
        s, d = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.doc[touched].ravel(), doc])
        order = np.lexsort((d, -s, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        kept = order[rank < self.k]
        self.score[touched], self.doc[touched] = s[kept].reshape(-1, self.k), d[kept].reshape(-1, self.k)


class Shard:
    """One shard's treaps, to be walked."""

    def __init__(self, ids: bytes, terms: list[bytes], first: bytes, doc: bytes, impact: bytes, down: bytes) -> None:
        self.ids, self.number = np.frombuffer(ids, np.int64), {t: i for i, t in enumerate(terms)}
        self.first, self.doc, self.impact = np.frombuffer(first, np.int32), np.frombuffer(doc, np.int32), np.frombuffer(impact, np.int32)
        self.down = np.frombuffer(down, np.int32).reshape(2, -1)

    def roots(self, terms: np.ndarray) -> np.ndarray:
        """The posting of the largest impact of each term, the first of equal ones: its treap's root."""
        return np.array([self.first[t] + int(np.argmax(self.impact[self.first[t] : self.first[t + 1]])) for t in terms], dtype=np.int64)

    def inside(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The root of each treap's part with documents from ``low`` to below ``high``, -1 for none."""
        node = node.copy()
        live = np.nonzero(node >= 0)[0]
        while len(live):
            at = self.doc[node[live]]
            small = at < low[live]
            live, small = live[small | (at >= high[live])], small[small | (at >= high[live])]
            node[live] = self.down[small.astype(np.int8), node[live]]
            live = live[node[live] >= 0]
        return node

    def search(self, queries: list[tuple[list[bytes], list[int]]], best: Best, at: int = 0) -> None:
        """Put the best documents of the queries ``at``, ``at + 1``, ... into ``best``."""
        known = [[(self.number[t], w) for t, w in zip(*q) if w > 0 and t in self.number] for q in queries]
        term = np.array([t for q in known for t, _ in q], dtype=np.int64)
        if not len(term):
            return
        named, of = np.unique(term, return_inverse=True)
        node, weight = self.roots(named)[of], np.array([w for q in known for _, w in q], dtype=np.int64)
        sizes = np.array([len(q) for q in known])
        query = at + np.nonzero(sizes)[0]
        sizes = sizes[sizes > 0]
        stack = [(query, np.zeros(len(query), np.int64), np.full(len(query), len(self.ids)), sizes, node, weight)]
        while stack:
            stack.extend(self._advance(*stack.pop(), best))

    def _advance(self, query, low, high, sizes, node, weight, best: Best) -> Iterator[tuple]:
        """Score one document of each state that may hold one of the best, and split the states there; the last yielded is to be walked first."""
        first = np.cumsum(sizes) - sizes
        share = weight * self.impact[node]
        bound = np.add.reduceat(share, first)
        alive = best.may_enter(query, bound, self.ids[low])
        if not alive.all():
            pairs = np.repeat(alive, sizes)
            query, low, high, sizes, node, weight, share, bound = query[alive], low[alive], high[alive], sizes[alive], node[pairs], weight[pairs], share[pairs], bound[alive]
            first = np.cumsum(sizes) - sizes
        if not len(query):
            return
        if len(node) > PAIRS and len(query) > 1:  # the more promising half first
            order = np.argsort(bound, kind="stable")
            for half in np.array_split(order, 2):
                half.sort()
                pick = np.zeros(len(query), dtype=bool)
                pick[half] = True
                pairs = np.repeat(pick, sizes)
                yield query[half], low[half], high[half], sizes[half], node[pairs], weight[pairs]
            return
        state = np.repeat(np.arange(len(query)), sizes)
        top = np.maximum.reduceat(share, first)
        is_top = np.nonzero(share == top[state])[0]
        split = np.empty(len(query), dtype=np.int64)
        split[state[is_top[::-1]]] = self.doc[node[is_top[::-1]]]  # of equal shares the first
        cut = split[state]
        here = self.inside(node, cut, cut + 1)
        score = np.add.reduceat(np.where(here >= 0, weight * self.impact[here], 0), first)
        best.add(query, score, self.ids[split])
        parts = []
        for start, end, a, b in ((low, split, low[state], cut), (split + 1, high, cut + 1, high[state])):
            part = self.inside(node, a, b)
            held = part >= 0
            left = np.bincount(state[held], minlength=len(query))
            some = left > 0
            parts.append((query[some], start[some], end[some], left[some], part[held], weight[held]))
        if any(len(p[0]) for p in parts):
            yield tuple(np.concatenate(x) for x in zip(*parts))


def weights(queries: DataFrame, counted: DataFrame, n: int) -> DataFrame:
    """(q, item_id, terms, weights): the distinct terms of each row of ``queries(item_id, text)`` with weight times occurrences; rows without terms are left out."""
    def run(batches):
        for batch in batches:
            for item, q, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(1))):
                bag = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(bag), pa.int64()), pa.array([item] * len(bag), pa.int64()), pa.array(list(bag), pa.binary()), pa.array(list(bag.values()), pa.int64())], names=["q", "item_id", "term", "times"])

    numbered = durable(queries.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("q", F.monotonically_increasing_id()))
    asked = numbered.mapInArrow(run, "q long, item_id long, term binary, times long")
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.coalesce(F.col("df"), F.lit(0)) + 1)))
    met = asked.join(counted.where("term is not null").select("term", "df"), "term", "left")
    return met.groupBy("q", "item_id").agg(F.sort_array(F.collect_list(F.struct((weight * F.col("times")).alias("w"), "term")), asc=False).alias("x")).select("q", "item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))


def _blocks(asked: DataFrame):
    block, held = [], 0
    for row in asked.toLocalIterator():
        if block and held + len(row.terms) > BLOCK_TERMS:
            yield block
            block, held = [], 0
        block.append((row.q, row.item_id, list(map(bytes, row.terms)), row.weights))
        held += len(row.terms)
    if block:
        yield block


def search(spark: SparkSession, folder: str, asked: DataFrame, k: int = TOP) -> DataFrame:
    """(q, item_id, rank, doc_id, score): the k best documents of an index for each row of ``weights()``.

    Every query is its own, rows of one item_id too. Queries go through the index a block at a time,
    which is what is sent to all; a task carries the best so far from one shard to the next.
    """
    index, parts = spark.read.parquet(folder), []
    for block in _blocks(asked):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            queries = [(terms, w) for _, _, terms, w in held.value]
            best = Best(len(queries), k)
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = Shard(*(c[row].as_py() for c in batch.columns))
                    for at in range(0, len(queries), QUERIES):
                        shard.search(queries[at : at + QUERIES], best, at)
                    del shard  # before the next one is read
            q, place = np.nonzero(best.score > 0)
            doc = best.doc[q, place]
            asked_, items = [held.value[i][0] for i in q], [held.value[i][1] for i in q]
            yield pa.RecordBatch.from_arrays([pa.array(asked_, pa.int64()), pa.array(items, pa.int64()), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[q, place])], names=["q", "item_id", "doc_id", "score"])

        with small_batches(spark, 1):
            parts.append(durable(index.mapInArrow(run, "q long, item_id long, doc_id long, score long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))))
    found = spark.createDataFrame([], "q long, item_id long, doc_id long, score long, salt int")
    for part in parts:
        found = found.union(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).select("q", "item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """The k documents of the highest score above zero for each row of ``queries(item_id, text)``, equal scores by rising doc_id.

    Null texts and texts without terms rank nowhere and find nothing. A missing doc_id ranks before
    others of its score (the least long stands for it). Rows of one doc_id are documents of their
    own. Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "treaps")
    counted, n, _ = build(docs, folder, postings)
    return search(spark, folder, weights(queries, counted, n), k).drop("q")


def op13_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with doc as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
item as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select item_id, term, count(*) as times from item group by 1, 2),
posting as (select doc_id, term, count(*) as tf from doc group by 1, 2),
size as (select doc_id, count(*) as n from doc group by 1),
total as (select count(*) as docs, sum(n)::bigint as terms from size),
weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from posting group by 1), total),
scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
  from asked join posting using (term) join weight using (term) join size using (doc_id), total group by 1, 2),
placed as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from placed where rank <= 10
"""
