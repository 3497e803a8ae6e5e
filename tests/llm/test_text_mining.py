"""Spelling variants, collocations and suffix dedup against brute force, with the cases their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemquarry.llm import pivot_phrases, spelling_variants, suffix_dedup
from stemquarry.llm.runtime import Scratch

from .test_documents import CLASHING, EDGE, lower

SF = "/root/testdata/sf0.001"
LETTERS = r"[A-Za-zÀ-ÿ]+"


@pytest.fixture(scope="module")
def odd(spark):
    """Edge rows with a lang that may be null, clashing columns and repeated rows."""
    rows = [(i, t, None if k % 4 == 0 else f"l{k % 3}") for k, (i, t) in enumerate(EDGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("clash").alias(c) for c in (*CLASHING, "phrase", "form", "at", "code", "anchor", "h", "spans")]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# ---- spelling variants ----


def edit_once(w, x):
    if abs(len(w) - len(x)) > 1 or w == x:
        return False
    if len(w) == len(x):
        return sum(a != b for a, b in zip(w, x, strict=True)) == 1
    w, x = sorted((w, x), key=len)
    return any(x[:i] + x[i + 1 :] == w for i in range(len(x)))


def brute_words(rows, least=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall(LETTERS, lower(text)):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= 2}


def brute_variants(rows, least=7):
    n = brute_words(rows, least)
    near = {w: [x for x in n if edit_once(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def variants(df, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.spelling_variants(df, **options).collect()}


def misspelt(seed=2):
    """Words of two letters' alphabets, so that most are near to many, with chains of forms."""
    r = random.Random(seed)
    rows = []
    for i in range(300):
        rows.append((i, " ".join("".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(20))))
    rows.append((1000, "spellingvariant " * 1300 + "spellingvarient " * 120 + "Spelingvarient " * 10 + "spelingvarent spelingvarent"))
    return rows


@pytest.mark.parametrize("shard_rows", [120_000, 40])
def test_variants_equal_brute_force(spark, shard_rows):
    """With few rows to a shard, groups that share a half are split again."""
    rows = misspelt()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_variants(rows)
    assert max(v[3] for v in want.values()) > 5 and any(v[0] and v[1] != v[0] for v in want.values())
    assert variants(df, shard_rows=shard_rows) == want


def test_hot_groups_are_split(spark):
    words = spark.range(3000).select(F.concat(F.lit("prefix"), F.lpad(F.conv("id", 10, 26), 5, "0")).alias("word"), F.lit(2).cast("long").alias("n"))
    routes, shards = spelling_variants.routed(Scratch(spark, "t"), words, 500)
    sizes = [r["count"] for r in routes.groupBy("c", "a", "b", "key").count().collect()]
    assert shards > 1 and max(sizes) <= 3 * 500 and routes.select("a", "b").distinct().count() > 4
    known = {r.word for r in words.collect()}
    got = Counter((r.word, r.near) for r in spelling_variants.near_words(words, shard_rows=500).collect())
    by_hole = {}
    for w in known:
        for i in range(len(w)):
            by_hole.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    want = {(w, x) for same in by_hole.values() for w in same for x in same if w != x}
    assert got == Counter(dict.fromkeys(want, 1))  # each pair once


def test_wavelet_tree_reports_a_rectangle():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 200):
        p = r.permutation(n)
        tree = spelling_variants.WaveletTree(p)
        lo, least = r.integers(0, n, 50), r.integers(0, n, 50)
        hi, below = np.minimum(n, lo + r.integers(0, n + 1, 50)), np.minimum(n, least + r.integers(0, n + 1, 50))
        q, v = tree.report(lo, hi, least, below)
        want = sorted((k, x) for k in range(50) for x in p[lo[k] : hi[k]].tolist() if least[k] <= x < below[k])
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_words_beyond_a_byte_of_letters_and_long_words(spark):
    words = [chr(0x4E00 + i) + "word" + chr(0x4E00 + i % 7) for i in range(400)] + ["x" * 5000, "x" * 4999, "x" * 2500 + "y" + "x" * 2499]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in spelling_variants.near_words(df).collect()}
    assert got == {(w, x) for w in words for x in words if abs(len(w) - len(x)) < 2 and edit_once(w, x)}


def test_variants_on_edges(odd, empty):
    want = brute_variants(EDGE, 3)
    assert variants(odd, least=3) == want and want
    assert spelling_variants.spelling_variants(empty).count() == 0


def test_crc_of_runs():
    data = np.frombuffer(b"alpha beta " + b"z" * 200, np.uint8)
    start, end = np.array([0, 6, 11]), np.array([5, 10, 211])
    before = np.array([zlib.crc32(b"12:"), zlib.crc32(b":"), zlib.crc32(b"-3:")], np.uint32)
    assert spelling_variants.run_crcs(data, start, end, before).tolist() == [zlib.crc32(b"12:alpha"), zlib.crc32(b":beta"), zlib.crc32(b"-3:" + b"z" * 200)]


# ---- collocations ----


def brute_phrases(rows, least, longest=4):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return total, {g: c for g, c in f.items() if c >= least}


def brute_collocations(rows, least, first=2000):
    total, f = brute_phrases(rows, least)
    long = [g for g in f if len(g) > 2]
    inside = {}
    for g in long:
        w = g[1:]
        for m in range(2, len(w)):
            for s in range(len(w) - m + 1):
                key = (g[0], *w[s : s + m])
                inside[key] = max(inside.get(key, 0), f[g])
    out = {}
    for g in long:
        a, w = f[g], g[1:]
        if 100 * inside.get(g, 0) >= 80 * a:
            continue
        cut = min((2_000_000 * a // (f[(g[0], *w[:k])] + f[(g[0], *w[k:])]), k) for k in range(1, len(w)))
        k = cut[1]
        out.setdefault(g[0], []).append((-cut[0], -a, " ".join(w).encode(), f[(g[0], *w[:k])], f[(g[0], *w[k:])]))
    return sorted((lang, r, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:first], 1))


def collocated(df, **options):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in pivot_phrases.collocations(df, **options).collect())


def chatter(seed=4):
    r = random.Random(seed)
    words = ["the", "of", "a", "New", "York", "city", "ça", "été", "x" * 300, "Hall"]
    rows = []
    for i in range(400):
        text = [r.choices(words, [30, 20, 15, 8, 8, 6, 3, 3, 1, 3])[0] for _ in range(40)]
        for k in range(0, 40, 9):
            text[k : k + 3] = ["new", "york", r.choice(["city", "city,", "hall\n", "hall!"])]
        rows.append((i % 50, r.choice(["en", "en", None, "de"]), r.choice([" ", "  ", "\t"]).join(text)))
    return [*rows, (5, "en", "the the the the the the the"), (None, "", "of"), (7, "en", None), (8, "und", "the of")]


@pytest.mark.parametrize("options", [{}, {"table_words": 3}, {"table_words": 0}, {"bucket_fragments": 200}, {"bucket_fragments": 150, "table_words": 5}])
def test_collocations_equal_brute_force(spark, options):
    """Also with fewer words in the table than are frequent, and with pivots that are dealt over buckets."""
    rows = chatter()
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    want = brute_collocations([r[1:] for r in rows], 30)
    assert len(want) > 50 and collocated(df, **options) == want
    assert collocated(df, first=3, **options) == [w for w in want if w[1] <= 3]


def test_each_phrase_is_counted_in_one_place(spark):
    r = np.random.default_rng(1)
    code, piece = r.integers(0, 6, 3000).astype(np.uint64), np.sort(r.integers(0, 300, 3000))
    code[r.random(3000) < 0.1] = np.uint64(2**64 - 1)
    rows = pivot_phrases.fragments(code, piece, 4)
    got = Counter()
    for columns, n in pivot_phrases.mined(rows, np.ones(rows.shape[0], np.int64), 4, 1):
        got.update(dict(zip(zip(*[c.tolist() for c in columns], strict=True), n.tolist(), strict=True)))
    want = Counter()
    for k in (2, 3, 4):
        for i in range(3000 - k + 1):
            if piece[i] == piece[i + k - 1] and (code[i : i + k] != 2**64 - 1).all():
                want[tuple(code[i : i + k].tolist())] += 1
    assert got == want


def test_scores_of_huge_counts_are_exact(spark):
    a, parts = 4 * 10**17, 9 * 10**17 + 1
    row = spark.sql(f"select cast(2000000 * cast({a}L as decimal(24,0)) div (cast({parts}L as decimal(24,0)) + cast({parts}L as decimal(24,0))) as bigint) s").first()
    assert row.s == 2_000_000 * a // (2 * parts)


def test_collocations_on_edges(odd, empty):
    rows = [(None if k % 4 == 0 else f"l{k % 3}", t) for k, (_, t) in enumerate(EDGE)]
    assert collocated(odd, least=2) == brute_collocations(rows, 2)
    assert pivot_phrases.collocations(empty).count() == 0


# ---- suffix dedup ----


def brute_dedup(rows, size=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]) if t else b""
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def deduped(df, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.substring_dedup(df, **options).collect()), key=str)


def passages(seed=6):
    """Texts with shared passages cut at any byte, near copies, periodic and constant runs, texts without triggers."""
    r = random.Random(seed)
    word = lambda n: " ".join("".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 9))) for _ in range(n))
    base = word(600)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            k = r.randint(0, len(base))
            parts.append(r.choice([base[k : k + r.randint(0, 900)], word(30), "-" * r.randint(0, 900), "ab\n" * r.randint(0, 300), base[100:620]]))
        rows.append((i, r.choice(["", " ", "\n"]).join(parts)))
    rows += [(60, base), (61, base[:700] + "!" + base[701:]), (62, base), (63, "q" * 399), (64, "q" * 400), (65, "z" * 401), (65, "z" * 401), (66, word(60)[:399])]
    return rows + [(None, base[5:600]), (None, word(200)), (67, None), (68, "")]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 4000}, {"shard_bytes": 1}, {"window": 4, "every": 7}])
def test_dedup_equals_brute_force(spark, options):
    """Also with anchors that are too large for a shard, and with other triggers."""
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_dedup(rows)
    assert sum(w[2] for w in want) > 1000 and max(w[3] for w in want) > 1
    assert deduped(df, **options) == want


@pytest.mark.parametrize("size", [20, 100])
def test_dedup_of_other_sizes(spark, size):
    rows = passages(8)
    assert deduped(spark.createDataFrame(rows, "doc_id long, text string"), size=size, window=5, every=6) == brute_dedup(rows, size)


def test_corpus_order_equals_brute_force():
    r = random.Random(5)
    for _ in range(40):
        size, window, every = r.choice([(30, 4, 5), (60, 4, 9), (40, 12, 40)])
        letters = r.choice([b"ab", b"abcdefgh\x00 \n", bytes(range(256))])
        base = bytes(r.choice(letters) for _ in range(600))
        texts = [b"".join(r.choice([base[k : k + r.randint(0, 200)], b"a" * r.randint(0, 150)]) for k in [r.randint(0, 600) for _ in range(4)]) for _ in range(5)]
        texts = [t for t in texts if len(t) >= size]
        n = np.array([len(t) - size + 1 for t in texts], np.int64)
        if not texts:
            continue
        seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
        got = suffix_dedup.repeated_windows(texts, n, np.ones(len(texts), np.int64), size, window, every)
        assert got.tolist() == [seen[t[k : k + size]] > 1 for t in texts for k in range(len(t) - size + 1)]


def test_dictionary_ranks_equal_sorting():
    """Also suffixes of just as many bytes as a level knows (7, 14, 28), which begin longer ones."""
    r = random.Random(7)
    for size in (9, 30, 100):
        phrases = ["".join(r.choice("ab") for _ in range(n)).encode() for n in [*range(1, 40), 7, 14, 28, 7, 14, 28] * 3]
        data, ends = np.frombuffer(b"".join(phrases), np.uint8), np.repeat(np.cumsum([len(p) for p in phrases]), [len(p) for p in phrases])
        got = suffix_dedup.dictionary_ranks(data, ends, size)
        suffixes = [p[k:][:size] for p in phrases for k in range(len(p))]
        smaller = {x: sum(y < x for y in suffixes) for x in set(suffixes)}
        assert got.tolist() == [smaller[x] for x in suffixes]


def test_rows_of_a_shard_in_any_order():
    """A periodic text: each order of its segments gives the same windows."""
    from itertools import permutations

    r = random.Random(3)
    text = ("".join(r.choice("abcdefgh ") for _ in range(262)) * 5).encode()
    for some in permutations([(0, 5, 1), (5, 262, 3), (791, 119, 1)]):
        windows, weight = np.array([n for _, n, _ in some]), np.array([w for *_, w in some])
        assert suffix_dedup.repeated_windows([text[a : a + n + 399] for a, n, _ in some], windows, weight, 400, 12, 40).all()


def test_pieces_of_a_long_text_hold_all_its_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["abcdefghij" * 37, "short"])], names=["doc_id", "text"])
    got = [(at + k, part[k : k + 20]) for held in suffix_dedup._pieces(iter([batch]), 20) for _, _, at, part in held for k in range(len(part) - 19)]
    raw = b"abcdefghij" * 37
    assert sorted(got) == [(k, raw[k : k + 20]) for k in range(len(raw) - 19)]


def test_a_passage_in_many_texts(spark):
    """One passage in most texts, between texts of their own: its anchors are counted, not gathered."""
    r = random.Random(9)
    word = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    shared = word(80)
    rows = [(i, f"{word(20)} {shared} {word(20)}" if i % 3 else word(90)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert deduped(df, shard_bytes=20_000) == brute_dedup(rows)


def test_dedup_on_edges(odd, empty):
    assert deduped(odd) == brute_dedup(EDGE)
    assert suffix_dedup.substring_dedup(empty).count() == 0
