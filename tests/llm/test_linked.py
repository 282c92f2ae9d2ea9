"""Manifests, n-gram joins and ranked search on small tables with nulls, ties, repeated rows and long texts, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.llm import merkle, ngram_join, treaps

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, class int, q string"
rng = random.Random(17)
VOCABULARY = ["".join(rng.choice("abcdeABé1") for _ in range(rng.randint(1, 4))) for _ in range(60)]


def edited(text, edits, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(23)
    base = [" ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ",", "\n"]) for _ in range(n)) for n in (3, 8, 11, 12, 40, 90, 200, 400)]
    rows = [[i, t, "en" if i % 3 else None, f"s{i % 2}", len(t)] for i, t in enumerate(base)]
    for i in range(40):  # near copies at and around the threshold
        text = edited(base[4 + i % 4], rng.randint(0, 6), i)
        rows.append([100 + 37 * i, text, rng.choice(["de", "é", "en"]), None, len(text)])
    rows += [[5000 + i, base[6].upper(), "en", "s1", None] for i in range(30)]  # copies
    rows += [[-7, None, "en", None, None], [7, "", "", "", 0], [9000, " \t\n ", "x", "s", 3], [9001, "--- !!", "x", "s", 6], [9002, "one two", "x", None, 7], [9003, "ONE  two", None, None, 7]]
    rows += [[42, "same id", "en", "s", 7], [42, base[7], "en", "s", 5], [42, base[7], "en", "s", 5], [None, base[5], "en", "s", 1], [None, base[5], None, None, None]]
    rows.append([1 << 40, "word " * 3000 + "x" * 5000, "en", "s", 9])
    return [(*r, "clash", 3, 4, "q") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """(root, the siblings of each leaf from below, joined)."""
    paths, at, nodes = [""] * len(leaves), list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i in range(len(leaves)):
            run = runs[at[i] // fanout]
            paths[i] += "".join(run[: at[i] % fanout] + run[at[i] % fanout + 1 :])
            at[i] //= fanout
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    groups = collections.defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r[0], hit and r[4] is not None))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: x[:3])
        trees[lang] = plain_tree([x[2] for x in groups[lang]], fanout)
    root, tops = plain_tree([trees[x][0] for x in langs], fanout)
    return sorted((x[3] is None, x[3] or 0, x[2], trees[lang][0], root, sha(path + tops[k]), not x[4]) for k, lang in enumerate(langs) for x, path in zip(groups[lang], trees[lang][1]))


@pytest.mark.parametrize("fanout,span,bits", [(2, 1024, 10), (2, 4, 2), (3, 9, 2)])
def test_manifest(docs, monkeypatch, fanout, span, bits):
    monkeypatch.setattr(merkle, "DIGIT_BITS", bits)
    monkeypatch.setattr(merkle, "_NO_KEY", -(1 << (64 - bits)) - 1)
    few = docs.where("doc_id is null or doc_id < 100000") if bits < 3 else docs  # few digits, many levels
    rows = [r for r in corpus() if bits > 2 or r[0] is None or r[0] < 100000]
    got = merkle.manifest(few, fanout, span).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == plain_manifest(rows, fanout)
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_small_manifests(spark, empty):
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(spark.createDataFrame([(5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:5" + "----") and one.verified and one.proof_sha256 == sha("")
    with pytest.raises(ValueError):
        merkle.Trie(1)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def plain_components(rows, percent):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return sorted((d is None, d or 0, len(s), -1 if d is None else find(d)) for d, s in sets)


@pytest.mark.parametrize("percent,pairs", [(90, 16), (90, 1), (70, 1)])
def test_linked(docs, monkeypatch, percent, pairs):
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "SEGMENT_BITS", 5)  # many segments
    got = ngram_join.linked(docs, percent).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == plain_components(corpus(), percent)


def test_linked_empty(spark, empty):
    assert ngram_join.linked(empty).count() == 0
    alone = ngram_join.linked(spark.createDataFrame([(1, None), (2, ""), (3, "a b c d")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1), (2, 0, 2), (3, 2, 3)]


def test_similar_sets_always_share_a_key():
    r = np.random.default_rng(3)
    for percent in (90, 75):
        cut = ngram_join.Fragments(percent)
        for size in [*range(1, 60), 100, 333, 1000, 5000]:
            x = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            for _ in range(4):
                grow = r.integers(0, cut.partner(len(x)) - len(x) + 1)
                most = max((k for k in range(len(x) + 1) if 100 * (len(x) - k) >= percent * (len(x) + grow)), default=0)  # the farthest that is similar
                y = np.unique(np.concatenate([r.permutation(x)[most:], r.integers(0, 1 << 63, grow, dtype=np.uint64)]))
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both) and not np.array_equal(x, y):
                    assert set(cut.keys(x)) & set(cut.keys(y)), (percent, len(x), len(y))
    squeezed = np.arange(1, 400, dtype=np.uint64)  # all in one fragment: empty segments have keys too
    assert set(ngram_join.Fragments().keys(squeezed)) & set(ngram_join.Fragments().keys(squeezed[3:]))


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", b"".join(bytes([c + 32]) if 65 <= c <= 90 else bytes([c]) for c in (text or "").encode()))


def plain_rank(rows, items, k=10):
    bags = [(r[0], collections.Counter(terms(r[1]))) for r in rows]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    total, df = sum(n for _, _, n in bags), collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, found = collections.Counter(terms(text)), []
        for d, b, n in bags:
            m = 100 - 75 + (75 * n * len(bags)) // total
            score = sum(c * math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in asked.items() if b[t])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item is not None, item or 0, i + 1, x[1], x[2], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("postings,pairs,jumps", [(10**6, 200_000, 64), (300, 40, 1)])
def test_rank(spark, docs, monkeypatch, postings, pairs, jumps):
    monkeypatch.setattr(treaps, "PAIRS", pairs)
    monkeypatch.setattr(treaps, "JUMPS", jumps)
    monkeypatch.setattr(treaps, "BLOCK_TERMS", 30)
    r = random.Random(5)
    items = [(i, " ".join(r.choice(VOCABULARY) for _ in range(r.randint(1, 30)))) for i in range(12)] + [(50, None), (51, "!!"), (52, "nowhere"), (53, "Word word x"), (None, corpus()[6][1]), (54, corpus()[7][1])]
    got = treaps.rank(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")), 10, postings).collect()
    assert sorted((x.item_id is not None, x.item_id or 0, x["rank"], x.doc_id is not None, x.doc_id or 0, x.score) for x in got) == plain_rank(corpus(), items)


def test_rank_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert treaps.rank(empty, items).count() == 0 and treaps.rank(docs, items.limit(0)).count() == 0


def test_shards_stand_in_files_of_their_own(spark, docs, tmp_path):
    treaps.build(docs.coalesce(1), str(tmp_path / "index"), 300)
    rows = [pq.read_metadata(f).num_rows for f in (tmp_path / "index").glob("*.parquet")]
    assert len(rows) > 1 and set(rows) == {1}  # no file's rows are held together, however many a task writes


def test_treaps_are_search_trees_and_heaps():
    r = np.random.default_rng(9)
    for _ in range(30):
        term = np.sort(r.integers(0, 5, 60))
        impact = r.integers(0, 8, 60)
        left, right = treaps.treaps(term, impact)
        seen = np.concatenate([left[left >= 0], right[right >= 0]])
        assert len(seen) == len(set(seen.tolist())) == 60 - len(set(term.tolist()))  # all but the roots hang once
        for i in range(60):
            assert left[i] < i and (right[i] < 0 or right[i] > i)
            assert all(c < 0 or (term[c] == term[i] and impact[c] <= impact[i]) for c in (left[i], right[i]))
