"""The operators on small tables with nulls, empty, equal and long texts, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import chat, decontaminate, html_extract, huffman, kneser_ney, langid, media, mixing, neardup, simhash, substrings, token_ids, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, copies int"
WORDS = {lang: [f"{p}{s}" for p in ps for s in ss] for lang, ps, ss in (("en", ("th", "wh", "an"), ("at", "ere", "ing", "is")), ("de", ("sch", "ge", "ver"), ("ung", "lich", "en", "keit")))}


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append([i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(3, 120))), lang, f"s{i % 4}"])
    rows.append([60, rows[3][1], "en", "s1"])  # a copy
    rows.append([61, rows[4][1].replace(" ", "  ", 1) + " tail", "en", None])  # a near copy
    rows += [[62, None, None, None], [63, "", "en", "s0"], [64, " \t\n", None, "s0"], [65, "42 !!", "en", "s2"], [66, "Ünïcode É ǅ 漢字 😀 <|endoftext|> it's", "de", "s2"]]
    rows.append([67, "long " * 3000 + "x" * 3000, "en", "s3"])
    rows.append([67, "same id", "en", "s3"])
    rows.append([None, "no id at all here", "en", "s3"])
    return [(*r, len(r[1] or ""), "clash", 7) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


def test_kneser_ney(docs, empty):
    assert kneser_ney.score(empty).count() == 0
    got = kneser_ney.score(docs).toPandas()
    rows = corpus()
    tokens = [words(r[1]) + [0] for r in rows]
    trained = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    c, b = collections.Counter(), collections.Counter()
    for t, k in zip(tokens, trained):
        if k:
            c.update(t)
            b.update(zip([1] + t[:-1], t))
    n, v = sum(c.values()), len(c)
    context, follows, after = collections.Counter(), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (x, w), k in b.items():
        context[x] += k
        follows[w] += 1
        after[x][min(k, 3) - 1] += 1
    of = lambda counts: [sum(k == j for k in counts.values()) for j in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(of(b)), kneser_ney.discounts(of(follows))
    spare = sum(d1[min(k, 3)] for k in follows.values()) / len(b)

    def p(x, w):
        low = max(follows[w] - d1[min(follows[w], 3)], 0) / len(b) + spare / (v + 1)
        return low if not context[x] else (max(b[x, w] - d2[min(b[x, w], 3)], 0) + sum(d * k for d, k in zip(d2[1:], after[x])) * low) / context[x]

    expected = sorted((len(t), sum(w in c for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 8), round(sum(math.log10(p(x, w)) for x, w in zip([1] + t[:-1], t)), 8)) for t in tokens)
    mine = sorted((r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 8)) for r in got.itertuples())
    assert np.allclose(np.array(mine), np.array(expected), atol=1e-6)
    assert set(got.train_tokens) == {n}
    assert sum(p(b"that", w) for w in c) + p(b"that", "unknown") == pytest.approx(1)


def test_kneser_ney_model_is_stored(spark, docs, tmp_path):
    folder = str(tmp_path / "model")
    kneser_ney.store(docs, folder)
    other = docs.where("doc_id % 5 = 0").union(docs.where("doc_id = 7").withColumn("text", F.lit("words that nobody wrote")))
    whole = kneser_ney.score(docs).toPandas().set_index("doc_id")
    got = kneser_ney.apply(spark, folder, other).toPandas()
    same = got[got.doc_id % 5 == 0].set_index("doc_id")
    assert len(got) == other.count() and len(same) == 14
    for c in ("score", "base_score", "n_known", "train_tokens"):
        assert np.allclose(same[c], whole.loc[same.index, c])
    assert np.isfinite(got.score).all()


def test_places_within_shards():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    for shards in (1, 4, 7, 64, 1000, 100_000):
        shard, place = kneser_ney.shard_of(keys, shards), kneser_ney.within(keys, shards)
        assert place.max() < 1 << 49 and (np.diff(shard.astype(np.int64)) >= 0).all()
        same = shard[1:] == shard[:-1]
        assert (place[1:][same] >= place[:-1][same]).all() and len(set(zip(shard.tolist(), place.tolist()))) == len(keys)


def test_large_counts_are_whole():
    import pyarrow as pa

    keys = np.array([5, 9, 1 << 47], dtype=np.uint64)
    big = np.array([3_000_000_000, 1, 1 << 60])
    found, values = kneser_ney.unsqueeze_list(kneser_ney.squeeze_list(keys, big), 1)
    assert (found == keys).all() and (values[0] == big).all()
    table = pa.table({"shard": pa.array([0, 0], type=pa.int32()), "flush": pa.array([1, 2]), "blob": pa.array([kneser_ney.squeeze_list(keys[:2], big[:2])] * 2, type=pa.binary())})
    out = kneser_ney._bigram_shard([pa.scalar(0)], table).to_pylist()
    assert [(kneser_ney.unsqueeze(r["blob"], 1)[0] >> 1).tolist() for r in out[:2]] == [[6_000_000_000, 2]] * 2


def test_leaks(spark, docs, empty):
    rng = random.Random(2)
    item = " ".join(rng.choice(WORDS["en"]) for _ in range(60))
    edited = item.replace("that", "thaat", 1)
    table = spark.createDataFrame([(1, "before " + item.upper() + " after"), (2, "x " + edited), (3, item[:200] + " cut"), (4, "clean text with nothing in it"), (5, None), (1, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (None, "x"), (9, "tiny"), (10, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()}
    assert found == {(1, 7), (2, 7), (3, 7)}
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == {4, 5}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


@pytest.mark.parametrize("size", [70, 140, 150, 151, 400])
def test_partial_quotes(size):
    rng = random.Random(size)
    item = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size)).replace("  ", " x").strip().ljust(size, "z")
    size = len(item)
    long = 74
    texts = ["#" * 30 + item[a : a + n] + "#" * 30 for n in (30, min(long, size), 90, 125, 178) if n <= size for a in range(size - n + 1)]
    blocks = decontaminate.patterns([(1, item)])
    found = [any(decontaminate.matches(b, [t])[0] for b in blocks) for t in texts]
    assert found == [len(t) - 60 >= min(long, size) for t in texts]


def test_leaks_against_brute_force(spark):
    """Every pair by full alignment of all of an item's patterns with all of a text, and whole words for short items."""
    rng = random.Random(77)
    letters = "abcdefghij "
    line = lambda n: decontaminate.normal("".join(rng.choice(letters) for _ in range(n)))
    items = [(i, line(n)) for i, n in enumerate((12, 25, 40, 59, 61, 75, 149, 160, 230))] + [(20, "ab cd"), (21, "x"), (22, "ghi")]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["z"], [t[k], "z"]])
        return "".join(t)

    texts = []
    for _, t in items[:9]:
        for n in (0, 1, 2, 4, 7):
            texts.append(line(30) + edited(t, n) + line(30))
        a = rng.randrange(max(1, len(t) - 40))
        texts.append(line(20) + t[a : a + 80] + line(20))
    texts += ["so ab  CD it is", "xab cdx", "x", "the ghi", "", "ab " * 300]

    def least(p, t):
        row = np.zeros(len(t) + 1, dtype=int)
        code = np.array([ord(c) for c in t])
        for i, c in enumerate(p):
            new = np.minimum(row[1:] + 1, row[:-1] + (code != ord(c))) if len(t) else row[1:]
            new = np.concatenate([[i + 1], new])
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        return row.min()

    expected = set()
    for d, text in enumerate(texts):
        t = decontaminate.normal(text)
        for item, w in items:
            if len(w) < 10:
                hit = f" {w} " in f" {t} "
            else:
                pieces = ([w] if len(w) <= 150 else [w[-120:-60]]) + ([w[s : s + 60] for s in [*range(0, len(w) - 60, 15), len(w) - 60]] if len(w) > 60 else [])
                hit = any(least(p, t) <= min(int(len(p) * 0.07), (len(p) - 10) // 10) for p in pieces)
            if hit:
                expected.add((d, item))
    table = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()} == expected
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == set(range(len(texts))) - {d for d, _ in expected}


def test_long_repetitive_texts(monkeypatch):
    """Occurrences are counted a few at a time and texts in parts; what is found does not depend on it."""
    blocks = decontaminate.patterns([(1, "ab " * 40), (2, "xyz " * 30)])
    texts = ["ab " * 3000 + "q" + "xyz " * 29, "ba " * 500, "q" * 500 + " " + "xyz " * 30]
    whole = [decontaminate.matches(b, texts) for b in blocks]
    monkeypatch.setattr(decontaminate, "OCCURRENCES", 1000)
    monkeypatch.setattr(decontaminate, "PART_CHARS", 700)
    assert [decontaminate.matches(b, texts) for b in blocks] == whole and whole[0][0] and whole[0][2]


def test_alignment_against_full_table():
    def full(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            new = [i + 1]
            for j, b in enumerate(t):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(25))
        q = list(p)
        for _ in range(rng.randint(0, 3)):
            q[rng.randrange(len(q))] = rng.choice("abcx")
        lead = rng.randint(0, 9)
        t = "z" * lead + "".join(q) + "zz"
        got = decontaminate.banded(decontaminate.codes(p), decontaminate.codes(t), lead - 2, 5, 4)
        assert got is not None and got[0] == full(p, t)


PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script></head><body><header class="top">Site name, welcome.</header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy, now. Cheap, really!</div>
<main><article class="post"><header><h1>A title &amp; more</h1></header><p>First <b>bold</b>paragraph,
 with words.<p>Second&nbsp;one<br>after a break &#33;</p><!-- gone --><form><input><button>Send</button></form></article></main>
<div id="comments"><p>I agree, says a reader, at length, and more of it.</p></div><aside>See also</aside><footer>&copy; someone, somewhere.</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<div><p>Only, text. Here"), (4, "u", "<div><p>Only, text. Here"), (5, "u", "<p a='" + "<" * 2000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_extract.main_texts(pages).toPandas()
    text = dict(zip(rows.page_id, rows.text))
    assert text[1] == "A title & more First boldparagraph, with words. Second one after a break !"
    assert text[2] == text[3] == "" and text[4] == "Only, text. Here" and len(rows) == 6
    assert (rows.n_chars == rows.text.str.len()).all()
    assert html_extract.main_texts(pages.where("false")).count() == 0


def test_html_paths_decide(monkeypatch):
    said = " ".join(f"Sentence {i}, with words and more of them." for i in range(20))
    links = "<ul>" + "".join(f"<li><a href=/{i}>{'Other story ' * 3}{i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<body><article><h2>Ax</h2><p>{said}</p>{links}<p>The end, of it.</p></article></body>"
    assert html_extract.extract(page) == f"Ax {said} The end, of it."
    bare = f"<body><div id=top>{links}</div><div id=a><p>{said}</p><p>More, to say.</p></div><div>Imprint</div></body>"
    assert html_extract.extract(bare) == f"{said} More, to say."
    monkeypatch.setattr(html_extract, "INSIDE_SHARE", -1)
    monkeypatch.setattr(html_extract, "SELECT_SHARE", -1)
    assert "Other story" in html_extract.extract(page) and "Imprint" in html_extract.extract(bare)


def test_html_odd_markup():
    assert html_extract.extract("<p>One, two.</p><script src=/a/>var x=1;</script>") == "One, two."
    assert html_extract.extract("<form><p>In one form, all of it is.</p></form>") == "In one form, all of it is."
    assert html_extract.extract('<article><p class="share-price">A share, today.</p><p>He<img src=x>llo, world.</p><div class=share-buttons>Tweet</div></article>') == "A share, today. Hello, world."
    deep = "<div><p>x, y." * 20_000
    assert html_extract.extract(deep) == " ".join(["x, y."] * 20_000)
    for odd in ("<form class=ad><i>x" * 5000, "<a " * 50_000, "<p a='" + "<" * 50_000, "</b></div>" * 50_000, "<foo><li>a" * 5000):
        html_extract.extract(odd)


def test_html_keeps_selected_siblings():
    said = [" ".join(f"Part {k}, sentence {i}, with words and more of them." for i in range(n)) for k, n in enumerate((4, 30, 4))]
    page = "<body><ul><li><a href=/>Home</a></ul>" + "".join(f'<div class="{c}"><p>{t}</p></div>' for c, t in zip(("intro", "story", "end"), said)) + "</body>"
    assert html_extract.extract(page) == " ".join(said)


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div class="no-comments"', 'form action="/"', 'div class="search layout"'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_wrappers_are_not_furniture(wrapper, inner):
    said = " ".join(f"Sentence {i}, with words and more of them." for i in range(20))
    marked = '<div class="comments"><p>A comment, at some length.</p></div><form><fieldset><p>Your name, please.</p></fieldset></form>'
    page = f"<body><nav>Home</nav><{wrapper}><select><option>One</select><{inner}><p>{said}</p>{marked}</{inner}></{wrapper.split()[0]}><p class=ad>Buy, now.</p></body>"
    assert html_extract.extract(page) == said


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|x|>"), (1, 2, "bob", None), (1, 3000, "ann", "again"), (1, 3000, "ann", "again"), (2, None, None, "who"), (None, 1, "x", ""), (3, 1, "system", "alone")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.perspectives(c).toPandas().sort_values(["conv_id", "speaker", "start"])
    ann = got[(got.conv_id == 1) & (got.speaker == "ann")]
    whole = "".join(ann.segment)
    assert whole == "<|system|>\nrules<|end|>\n<|assistant|>\nhi < |x|><|end|>\n<|user bob|>\n<|end|>\n" + 2 * "<|assistant|>\nagain<|end|>\n"
    assert [whole[int(a) : int(b)] for a, b in zip(ann.train_start.dropna(), ann.train_end.dropna())] == ["hi < |x|><|end|>\n", "again<|end|>\n", "again<|end|>\n"]
    assert set(got.speaker) == {"ann", "bob", "unknown", "x"} and 3 not in set(got.conv_id)
    assert chat.perspectives(c.where("false")).count() == 0
    clash = c.select("*", *[F.lit("clash").alias(n) for n in ("speaker", "start", "header", "segment", "width", "block", "conv", "said")])
    assert sorted(map(repr, chat.perspectives(clash).collect())) == sorted(map(repr, chat.perspectives(c).collect()))
    long = spark.createDataFrame([(9, k, "ab"[k % 2], "word " * (200_000 if k == 1 else 2)) for k in range(2500)], "conv_id long, turn long, role string, text string")
    rows = chat.perspectives(long).where("speaker = 'a'").toPandas().sort_values("turn")
    assert (rows.start.values == np.cumsum([0, *rows.segment.str.len().values[:-1]])).all() and len(rows) == 2500


def test_language(docs, empty):
    got = langid.predict(docs, langid.fit(docs.where("doc_id < 40"))).toPandas().set_index("doc_id")
    for i in range(40, 60):
        assert got.lang_pred[i] == ("en" if i % 3 else "de")
    assert {got.lang_pred[i] for i in (62, 63, 64, 65)} == {"und"} and got.score.between(0, 1).all()
    assert set(langid.predict(docs, langid.fit(empty)).toPandas().lang_pred) == {"und"}
    assert langid.predict(empty, langid.fit(docs)).count() == 0


def test_language_against_exact_counts(spark):
    """Bloom filters only add false positives: the decision is that of exact sets of n-grams."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 40))), lang) for i in range(400) for lang in ("en", "de")[i % 2 :][:1]]
    train, probe = rows[:300], rows[300:]
    table = spark.createDataFrame(train, "doc_id long, text string, lang string")
    filters = langid.fit(table)
    sets, grams = {}, lambda t: [g for g in langid.grams(b" " + t.encode() + b" ").tolist() if g != 0x20202020]
    for lang in ("en", "de"):
        n = collections.Counter(g for _, t, x in train if x == lang for g in grams(t))
        sets[lang] = {g for g, k in n.items() if k >= langid.LEAST}
    for _, text, _ in probe:
        g = grams(text)
        share = {x: sum(k in s for k in g) / len(g) for x, s in sets.items()}
        exact = np.array([share["de"], share["en"]])
        assert np.allclose(filters.shares([text.encode()])[0][0], exact, atol=1e-3)
        if abs(exact[0] - exact[1]) > 1e-3:
            assert filters.predict([text])[0] == [max(share, key=share.get)]
    # letters always have a language; what no learned language has is not kept, unless it is too short to tell
    pred, score, kept = filters.predict(["Q", "ΑΒΓΔ " * 30, "12 !!", None, probe[0][1]])
    assert pred[:2] == ["de", "de"] and pred[2:4] == ["und", "und"] and kept.tolist() == [True, False, False, False, True] and ((score >= 0) & (score <= 1)).all()


def test_more_than_64_languages():
    gram = np.arange(70, dtype=np.uint32) * 1_000_003 + 77
    f = langid.Filters([f"l{i}" for i in range(70)], [langid.bits_of(gram[i : i + 1]) for i in range(70)])
    share = [int(np.argmax([int(f.planes[i // 64][next(iter(langid.slots(gram[k : k + 1])))][0] >> np.uint64(i % 64) & np.uint64(1)) for i in range(70)])) for k in (0, 63, 64, 69)]
    assert share == [0, 63, 64, 69]


def test_substrings(spark, docs, empty):
    assert substrings.removed(empty).count() == 0
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdef ") for _ in range(120))
    extra = [(100, passage), (101, "é" * 60), (102, "x" + passage[10:90] + "y" + passage), (103, "é" * 70 + passage[:49]), (104, passage[:50]), (104, passage[:50]), (105, "q" * 200)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = substrings.removed(table).toPandas()
    rows = [(substrings.LATEST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in table.collect()]
    first = {}
    for d, t in rows:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            first[w] = min(first.get(w, d), d)
    expected = []
    for d, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < d:
                gone[k : k + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum())
        expected.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(map(tuple, got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False))) == sorted(expected)


def test_refined_order():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 3, 300).astype(np.uint64) << np.uint64(k) for k in (40, 0, 63)]
    order, lcp = substrings.refine(words)
    rows = [b"".join(int(w[i]).to_bytes(8, "big") for w in words) for i in range(300)]
    assert [rows[i] for i in order] == sorted(rows)
    for k in range(1, 300):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert lcp[k] == next((i for i in range(24) if a[i] != b[i]), 24)


def test_mixing(docs, empty):
    import re

    assert mixing.mix_documents(empty).count() == 0 and mixing.mix_documents(docs).columns == [*docs.columns, "mix"]
    flat = lambda d: mixing.mix_documents(d).select("doc_id", "source", "text", "mix.*").toPandas()
    got, again = flat(docs), flat(docs.repartition(2))
    key = ["doc_id", "size", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert all(n == len(re.findall(mixing.WORDS, t or "")) for n, t in zip(got["size"], got.text))
    sizes = got.groupby(got.source.fillna("~"))["size"].sum()
    want, total = dict.fromkeys(sizes.index, 0.0), sizes.sum()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes.index))}
    free, left = set(sizes.index), float(total)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if want[s] + share * weight[s] > 3 * sizes[s]}
        give = {s: 3 * sizes[s] - want[s] for s in full} if full else {s: share * weight[s] for s in free}
        for s, x in give.items():
            want[s] += x
        left -= sum(give.values())
        free -= full
        if not full:
            break
    target = got.groupby(got.source.fillna("~")).target.first()
    assert all(target[s] == pytest.approx(want[s]) for s in want)
    taken = (got.copies * got["size"]).groupby(got.source.fillna("~")).sum()
    largest = got.groupby(got.source.fillna("~"))["size"].max()
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in want if target[s] > 0)
    assert got.copies.between(0, 3).all()


def test_documents_larger_than_what_is_wanted(spark):
    rows = [(0, "a", 2770)] + [(i, "a", 50) for i in range(1, 51)] + [(100, "b", 4000), (101, "c", 4000), (102, "d", 9000), (103, "d", 10)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mixed(table, F.col("source"), F.col("size"), [F.col("doc_id")], weights=(1, 9, 9, 9)).select("doc_id", "source", "mix.*").toPandas()
    target, taken = got.groupby("source").target.first(), (got.copies * got["size"]).groupby(got.source).sum()
    assert target["a"] < 2770 and got.copies[got.doc_id == 0].item() == 0 and abs(taken["a"] - target["a"]) <= 25


def test_pareto_inclusion_rates(spark):
    """Over many seeds a document is drawn about as often as its inclusion probability says, by brute force and by the plan."""
    rng = np.random.default_rng(5)
    size = np.concatenate([rng.integers(1, 60, 150), [400, 900]])
    rows = [(int(i), "a", int(s)) for i, s in enumerate(size)] + [(1000 + i, "b", 40) for i in range(160)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long").coalesce(1).cache()
    total, own = sum(r[2] for r in rows), int(size.sum())
    target = total * 2 / 7  # the weights of the two sources are 2 and 5
    wanted, whole = target - target // own * own, int(target // own)
    scale = 0.0
    for s in sorted(set(size), reverse=True):  # sizes above s certain
        certain, squares = size[size > s].sum(), (size[size <= s].astype(float) ** 2).sum()
        if 0 < (scale := (wanted - certain) / squares) * s < 1:
            break
    p = np.minimum(1, scale * size)
    assert (p * size).sum() == pytest.approx(wanted)
    drawn, seeds = np.zeros(len(size)), 60
    told = mixing.plan(table, weights=(2, 5), seed=0).where("source = 'a'").first()
    assert told["whole"] == whole and told["scale"] == pytest.approx(scale) and told["wanted"] == pytest.approx(wanted)
    ranks = [mixing.pareto_rank(mixing.inclusion(F.col("size"), F.lit(scale), F.lit(10**9)), k, F.col("doc_id")).alias(f"q{k}") for k in range(seeds)]
    frame = table.where("source = 'a'").select("doc_id", *ranks).toPandas().set_index("doc_id").sort_index()
    for k in range(seeds):
        q = np.where(p >= 1, 0, frame[f"q{k}"].values)
        order = np.argsort(q, kind="stable")
        upto = np.cumsum(size[order])
        chosen = order[upto - size[order] / 2 <= wanted]
        chosen = order[: len(chosen)]
        drawn[chosen] += 1
        assert abs(size[chosen].sum() - wanted) <= size[p < 1].max() / 2 + 1
        if k < 3:
            got = mixing.mixed(table, F.col("source"), F.col("size"), [F.col("doc_id")], weights=(2, 5), seed=k).where("source = 'a'").select("doc_id", "mix.copies").toPandas()
            assert set(got.doc_id[got.copies > whole]) == set(chosen.tolist())
    assert (drawn[p >= 1] == seeds).all()
    for low, high in ((0, 0.3), (0.3, 0.6), (0.6, 1)):
        of = (p >= low) & (p < high)
        if of.sum() > 10:
            assert abs(drawn[of].mean() / seeds - p[of].mean()) < 0.06


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    assert token_ids.read_documents(token_ids.write_files(empty)).count() == 0
    whole = Tokenizer.from_file(token_ids.tokenizer_path())
    got = token_ids.read_documents(token_ids.write_files(docs, file_bytes=4000)).toPandas().sort_values("start")
    ids = [(-1 if r[0] is None else r[0], np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")) for r in corpus()]
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.ids_crc32)) == sorted((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    assert got.doc_id.fillna(-1).is_monotonic_increasing and (got.start.values == np.cumsum(got.n_tokens) - got.n_tokens).all()


def test_huffman_round_trips():
    rng = np.random.default_rng(3)
    for n, skew in ((0, 1), (1, 1), (511, 3), (512, 1), (5000, 6), (1025, 0.01)):
        x = np.minimum(rng.exponential(1, n) ** skew * 50, 3999).astype(np.int64)
        lengths = huffman.code_lengths(np.bincount(x, minlength=4000), 13)
        data, offsets = huffman.encode(x, lengths, huffman.canonical(lengths))
        assert (huffman.decode(data, offsets, n, *huffman.decode_table(lengths)) == x).all()
        used = lengths[lengths > 0].astype(float)
        assert lengths.max(initial=0) <= 13 and (2.0**-used).sum() <= 1
    counts = np.array([1, 1, 2, 4, 8, 16, 32, 64])
    assert (counts * huffman.code_lengths(counts, 16)).sum() == 254


def test_simhash(docs, empty):
    assert simhash.near_groups(empty).count() == 0
    got = simhash.near_groups(docs.where("doc_id is not null")).toPandas()

    def fingerprint(text):
        w = words(text)
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r[0], fingerprint(r[1])) for r in corpus() if r[0] is not None]
    root = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = collections.defaultdict(list)
    for (d, _), r in zip(rows, root):
        least[r].append(d)
    expected = sorted((d, f, min(least[r])) for (d, f), r in zip(rows, root))
    assert sorted(zip(got.doc_id, got.fp.astype("int64").astype("uint64").map(int), got.component_id)) == expected


def test_simhash_without_ids(spark):
    rows = [(None, "one two three four"), (5, "one two three four"), (None, "quite another text it is"), (None, None), (7, ""), (3, "one two three four")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))).toPandas()
    assert sorted(map(str, got.component_id.fillna(-1).astype(int))) == sorted(["3", "3", "3", "-1", "7", "7"])


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= 1 << int(b)
        kx, ky = collections.defaultdict(set), collections.defaultdict(set)
        for keys, v in ((kx, x), (ky, y)):
            row, index = simhash.golay_keys(v)
            for r, k in zip(row.tolist(), index.tolist()):
                keys[r].add(k)
        assert all(kx[i] & ky[i] for i in range(len(x)))


def test_large_buckets_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 3)
    rng = np.random.default_rng(5)
    base, rows = 0x0123456789ABCDEF, set()
    for _ in range(60):
        x = base
        for b in rng.choice(12, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b) + 40
        rows.add(x)
    rows = sorted(rows)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in rows], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(df)).collect()}
    signed = [int(np.uint64(x).astype(np.int64)) for x in rows]
    for a, x in zip(signed, rows):
        for b, y in zip(signed, rows):
            if a != b and (x ^ y).bit_count() <= 2:
                assert roots[a] == roots[b]


def test_media(docs, empty):
    assert media.load(media.store(empty)).count() == 0
    got = media.load(media.store(docs)).toPandas()
    data = [media.padded((r[1] or "").encode()) for r in corpus()]
    assert sorted(got.payload_sha256) == sorted(hashlib.sha256(p).hexdigest() for p in data)
    assert sorted(got.tail_crc32) == sorted(zlib.crc32(p[-16:]) for p in data) and (got.payload_bytes % 192 == 0).all()
    assert got.groupby("payload_sha256")[["media_sha256", "feature"]].nunique().max().max() == 1
    assert (got.payload_bytes > 64 * 192).any()  # an animation
    by_sha = dict(zip(got.payload_sha256, got.feature))
    for p in data:  # the feature by brute force: rows, mean colours, and which of 64 cells are lighter than their mean
        h = len(p) // 192
        light = [[sum(p[192 * y + 3 * x : 192 * y + 3 * x + 3]) for x in range(64)] for y in range(h)]
        cells = []
        for i in range(8):
            a, b = i * h // 8, (i + 1) * h // 8
            rows = light[min(a, h - 1) : max(b, min(a, h - 1) + 1)]
            cells += [sum(sum(r[8 * j : 8 * j + 8]) for r in rows) * 1000 // max(b - a, 1) for j in range(8)]
        bits = "".join("1" if 64 * c > sum(cells) else "0" for c in cells)
        means = [sum(p[k::3]) * 100 // (64 * h) for k in range(3)]
        assert by_sha[hashlib.sha256(p).hexdigest()] == ":".join(map(str, [h, *means])) + f":{int(bits, 2):016x}"


class Bits:
    """A bit stream put together by hand, as the format's description says."""

    def __init__(self, width, height):
        self.bits = []
        self.put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]
        return self

    def code(self, *symbols):
        """A simple prefix code of one or two symbols: the first is 0, the second 1."""
        self.put(1, 1).put(len(symbols) - 1, 1).put(1, 1)
        for s in symbols:
            self.put(s, 8)
        return self

    def done(self):
        return bytes(sum(b << k for k, b in enumerate(self.bits[i : i + 8])) for i in range(0, len(self.bits), 8))


def test_webp_files_of_others():
    import base64

    #: The one-pixel lossless file that pages use to find out whether a browser reads the format.
    known = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert [x.tolist() for x in webp.decode_images(webp.unwrap(known))] == [[[0]]]
    plain = Bits(3, 1).put(0, 1).put(0, 1).put(0, 1).code(10, 200).code(5).code(7, 9).code(255).code(0)
    plain.put(0, 1).put(1, 1).put(1, 1).put(0, 1).put(0, 1).put(0, 1)
    assert [hex(x) for x in webp.decode_images([plain.done()])[0].ravel()] == ["0xff050a09", "0xff05c807", "0xff050a07"]
    green = Bits(2, 1).put(1, 1).put(2, 2).put(0, 1).put(0, 1).put(0, 1).code(10, 200).code(5).code(7).code(255).code(0).put(0, 1).put(1, 1)
    assert [hex(x) for x in webp.decode_images([green.done()])[0].ravel()] == ["0xff0f0a11", "0xffcdc8cf"]
    # a palette of two colours, the second as the difference from the first; eight indices of one bit in a pixel
    palette = Bits(5, 1).put(1, 1).put(3, 2).put(1, 8).put(0, 1).code(1, 2).code(3).code(4).code(0, 255).code(0).put(0, 1).put(1, 1).put(1, 1).put(0, 1)
    palette.put(0, 1).put(0, 1).put(0, 1).code(0b10110).code(0).code(0).code(255).code(0)
    assert [hex(x) for x in webp.decode_images([palette.done()])[0].ravel()] == ["0xff030104", "0xff060308", "0xff060308", "0xff030104", "0xff060308"]
    # prediction from the left (mode 1): every pixel adds to the one before
    left = Bits(3, 1).put(1, 1).put(0, 2).put(0, 3).put(0, 1).code(1).code(0).code(0).code(255).code(0)
    left.put(0, 1).put(0, 1).put(0, 1).code(1, 2).code(3).code(0).code(0).code(0).put(0, 1).put(1, 1).put(1, 1)
    assert [hex(x) for x in webp.decode_images([left.done()])[0].ravel()] == ["0xff030100", "0xff060300", "0xff090500"]
    # cross-colour: red gains green * 32 / 32, of signed bytes
    cross = Bits(1, 1).put(1, 1).put(1, 2).put(0, 3).put(0, 1).code(0).code(0).code(32).code(255).code(0)
    cross.put(0, 1).put(0, 1).put(0, 1).code(250).code(20).code(7).code(255).code(0)
    assert [hex(x) for x in webp.decode_images([cross.done()])[0].ravel()] == ["0xff0efa07"]


def test_webp_plans_fit_their_images():
    rng = np.random.default_rng(2)
    opaque = lambda a: a.astype(np.uint32) & np.uint32(0xFFFFFF) | np.uint32(0xFF000000)
    noise = opaque(rng.integers(0, 1 << 24, (64, 64)))
    colours = rng.choice(noise.ravel()[:30], (64, 64))
    ramp = opaque(np.cumsum(rng.integers(0, 3, (64, 64, 1)) * np.array([1, 256, 65536]), axis=1).sum(axis=2))
    grey = (rng.integers(0, 256, (64, 64)).astype(np.uint32) * np.uint32(0x010101)) | np.uint32(0xFF000000)
    images = [noise, colours, ramp, ramp.T.copy(), grey]
    best = webp.chosen_plans(images).tolist()
    assert best[0] == 0 and best[1] in (1, 2) and 4 in best[2:4] and 5 in best[2:4] and best[4] == 3
    files = webp.encode_best(images)
    assert all((a == b).all() for a, b in zip(images, webp.decode_images(files)))
    assert sum(map(len, files)) < 0.8 * sum(map(len, webp.encode_images(images)))


def test_webp_transforms_cache_and_references():
    rng = np.random.default_rng(1)
    noise = [rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32) for h, w in ((1, 1), (7, 5), (33, 64))]
    few = [rng.choice(rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32), (17, 23)) for n in (1, 2, 4, 16, 200)]
    flat = [np.full((40, 40), 0xFF102030, dtype=np.uint32), np.tile(noise[2][:3], (9, 1))]
    for cache in (0, 5):
        for steps in ((), ((2,),), *[((0, m),) for m in range(14)], ((1, 0xFF1080F0),), ((2,), (0, 11), (1, 0xFF40C020))):
            assert all((a == b).all() for a, b in zip(noise + few + flat, webp.decode_images(webp.encode_images(noise + few + flat, cache, steps))))
        for steps in (((3,),), ((3,), (0, 1))):
            assert all((a == b).all() for a, b in zip(few, webp.decode_images(webp.encode_images(few, cache, steps))))
    with pytest.raises(ValueError):
        webp.decode_images([b"\x2f" + b"\xff" * 40])


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(9)
    base = [rng.choice(WORDS["en"]) + str(rng.randrange(400)) for _ in range(300)]
    near = base.copy()
    near[50] = near[200] = "other"
    far = [w if i % 6 else "x" for i, w in enumerate(base)]
    table = spark.createDataFrame([(1, " ".join(base), "k"), (2, " ".join(near).upper(), "k"), (3, " ".join(far), "k"), (4, " ".join(base), "k"), (5, None, None), (6, "", None), (None, " ".join(base), "k")], "doc_id long, text string, doc string")
    kept = neardup.deduplicate(table).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "5", "None"]
    assert neardup.deduplicate(empty).count() == 0 and neardup.deduplicate(docs).columns == docs.columns


@pytest.mark.parametrize("pairs", [16, 2])
def test_links_in_buckets_are_whole(spark, monkeypatch, pairs):
    import pyarrow as pa

    def one_bucket(batches):
        for batch in batches:
            same = pa.array([t.encode() for t in batch.column(1).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, pa.array([b"8 bytes."] * len(same), type=pa.binary())], names=["doc", "same", "keys"])

    monkeypatch.setattr(neardup, "PAIRS", pairs)
    monkeypatch.setattr(neardup, "_describe", one_bucket)
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, x = [], fresh(200)
    for _ in range(6):  # a chain: only neighbours are similar
        texts.append(x)
        at = rng.randrange(180)
        x = x[:at] + fresh(14) + x[at + 14 :]
    centre = fresh(200)
    for i in range(14):  # a star: copies are similar to the centre only
        at = 14 * i
        texts.append(centre[:at] + fresh(14) + centre[at + 14 :])
    texts += [centre, fresh(100), fresh(100)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j], key=lambda r: order[r])
    for ids in (order, list(range(len(texts)))):
        table = spark.createDataFrame([(d, " ".join(t)) for d, t in zip(ids, texts)], "doc_id long, text string")
        got = {r.doc: r.root for r in neardup.groups(table).collect()}
        least = {r: min(d for d, x in zip(ids, root) if x == r) for r in root}
        assert {d: got.get(d, d) for d in ids} == {d: least[r] for d, r in zip(ids, root)}
    assert len(set(root)) == 4


def test_similar_texts_meet_in_a_bucket():
    rng = np.random.default_rng(31)
    pairs, met, similar = 0, 0, []
    for _ in range(400):  # one block of fresh words replaces one of the text
        n = int(rng.integers(20, 600))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        size = max(1, int(n * rng.uniform(0.05, 0.11)) - 4)
        at, b = int(rng.integers(0, n - size + 1)), a.copy()
        b[at : at + size] = rng.integers(0, 2**63, size)
        j = neardup.jaccard(neardup.shingles(a), neardup.shingles(b))
        if j >= 0.8:
            one, two = neardup.keys_of([neardup.shingle_hashes(a), neardup.shingle_hashes(b)])
            pairs, met = pairs + 1, met + bool(set(one.tolist()) & set(two.tolist()))
            similar.append(j)
    assert pairs >= 200 and min(similar) < 0.81 and met == pairs


def test_bucket_keys_are_codewords_of_fingerprints():
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    base = fresh(300)
    every = [neardup.shingle_hashes(w) for w in (base, np.concatenate([base[:290], fresh(10)]), fresh(300), base[:5], base[:1])]
    words, minima = neardup.fingerprints(every)
    keys = neardup.keys_of(every)
    assert words.shape == minima.shape == (5, neardup.TABLES) and int(words.max()) < 1 << 23
    assert [len(set(k.tolist())) for k in keys] == [len(k) for k in keys]
    for text in range(5):  # one or six keys a table, as the code has it
        assert len(keys[text]) == len(simhash.golay_keys(words[text])[0])
    for i in range(5):
        for j in range(i):
            close = (minima[i] == minima[j]) & (np.bitwise_count(words[i] ^ words[j]) <= simhash.MAX_DISTANCE)
            shared = set(keys[i].tolist()) & set(keys[j].tolist())
            assert not close.any() or shared
            assert (minima[i] == minima[j]).any() or not shared
    assert set(keys[0].tolist()) & set(keys[1].tolist()) and not set(keys[0].tolist()) & set(keys[2].tolist())
    assert [k.tolist() for k in neardup.keys_of(every[3:])] == [k.tolist() for k in keys[3:]]


def test_pipeline(spark, docs, empty, tmp_path):
    frame = docs
    bench = spark.createDataFrame([(1, corpus()[5][1])], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if name != "token_files":
            assert frame.columns == docs.columns
        if name == "language":
            gone = [r.doc_id for r in before.collect()]
            for r in frame.collect():
                gone.remove(r.doc_id)
            assert sorted(gone) == [62, 63, 64, 65, 66]
        if name == "near_duplicates":
            assert 60 not in {r.doc_id for r in frame.collect()}
        if name == "decontamination":
            assert 5 not in {r.doc_id for r in frame.collect()} and frame.count() < before.count()
    assert set(frame.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    out = empty
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert out.count() == 0
