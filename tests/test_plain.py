"""Queries that SQL can't express, against plain versions of what they compute."""

import difflib
import re
import unicodedata
from functools import lru_cache
from html.parser import HTMLParser

import pytest

from stemquarry.functions import udfs
from stemquarry.plans import catalogue

SF = "/root/testdata/sf0.001"
PLAIN = {"norm_compare", "edit_steps", "anchored_similarity", "segmented_words", "merged_fragments"}


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: catalogue.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def turns(spark):
    return {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}


def test_every_plain_version_is_needed():
    assert {n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL} == PLAIN


def key(text):
    text = re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))
    return "".join(",.;:?!()"["，。；：？！（）".index(c)] if c in "，。；：？！（）" else c for c in text).lower()


def test_norm_compare(rows, turns):
    want = {}
    for (c, t), text in turns.items():
        if (c + 1, t) in turns:
            a, b = key(text), key(turns[c + 1, t])
            score = 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
            want[c, t] = (pytest.approx(score), "same" if score > 0.95 else "misaligned" if score < 0.3 else "different")
    assert {(r.conv_id, r.turn): (r.score, r.status) for r in rows("norm_compare")} == want


def test_edit_steps(rows, turns):
    want = {}
    for c, t in turns:
        before = max((x for d, x in turns if d == c and x < t), default=None)
        if before is not None:
            a, b = turns[c, before], turns[c, t]
            steps = [(a[i:j], b[k:m]) for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]
            want[c, t] = sum(bool(x.strip() or y.strip()) and not re.fullmatch(r"\s*\d{5}\s*", x + y) for x, y in steps)
    assert {(r.conv_id, r.turn): r.n for r in rows("edit_steps")} == want


def test_anchored_similarity(rows, turns):
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    for r in rows("anchored_similarity"):
        stem, segment = turns[r.conv_id, r.turn], turns[r.conv_id, min(t for c, t in turns if c == r.conv_id)]
        direct = ratio(stem, segment[: len(stem)])
        at = max(0, *(segment.find(stem[:k]) for k in (20, 10)))
        assert r.score == pytest.approx(direct if direct >= 0.85 else max(direct, ratio(stem, segment[at : at + len(stem)])))


def test_two_column_lines(spark, rows):
    cells = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").collect():
        x, y = e.event_id % 40, e.event_id // 40 * 10
        cells.setdefault((e.user_id, int(x >= 20)), {}).setdefault(y, []).append((x, e.event_type[0]))
    want = {}
    for (doc, column), by_y in cells.items():  # rows ten apart are never one line
        for line, y in enumerate(sorted(by_y)):
            want[doc, column, line] = "".join(c for _, c in sorted(by_y[y]))
    assert {(r.doc, r.column, r.line): r.text for r in rows("two_column_lines")} == want


def test_html_text(spark, rows):
    """Text between tags, by cutting the markup up instead of walking it."""
    import html

    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "", r.html)
        body = re.sub(r"(?i)<(?:p|div|li|br|h1|h2|h3|article|footer|nav)\b[^>]*>", "\n", body)
        want[r.page_id] = re.sub(r"\n{2,}", "\n", html.unescape(re.sub(r"<[^>]*>", "", body))).strip()
    assert {r.page_id: r.text for r in rows("html_text")} == want
    assert issubclass(HTMLParser, object)


def reference_words(spark):
    text = " ".join(r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    return [w for w in re.split("[^a-z]+", text) if w]


def test_segmented_words(spark, rows):
    """The pieces of each run have the best score that any split has."""
    count = {}
    for w in reference_words(spark):
        if len(w) >= 2:
            count[w] = count.get(w, 0) + 1

    def score(piece):
        seen = count.get(piece.lower())
        return (10 * len(piece) + min(seen, 100) / 10 if seen else 5 * len(piece) if re.search("[aeiou]", piece.lower()) else 0) - 8

    @lru_cache(None)
    def best(word):
        return max([score(word) if len(word) <= 24 else float("-inf")] + [best(word[:i]) + score(word[i:]) for i in range(max(1, len(word) - 24), len(word))])

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in rows("segmented_words"):
        glued = re.sub("([a-z]) ([a-z])", r"\1\2", texts[r.item_id])
        assert r.text.replace(" ", "") == glued.replace(" ", "")
    for word in ("thetestofthe", "therein", "xyzzyabc", "nationthe"):
        pieces = udfs.segment_word(word, count)
        if len(pieces) > 1:
            assert sum(map(score, pieces)) == pytest.approx(best(word))
        assert "".join(pieces) == word


def test_merged_fragments(spark, rows):
    words = {w for w in reference_words(spark) if len(w) >= 5}
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    merges = 0
    for r in rows("merged_fragments"):
        left, out = re.sub("([a-z]{2})([a-z]{3})", r"\1 \2", texts[r.item_id]).split(" "), []
        while left:
            for k in (4, 3, 2, 1):
                part = left[:k]
                low = [p.lower() for p in part]
                letters = all(re.fullmatch("[A-Za-z]+", p) for p in part)
                known = len(part) == k and k > 1 and letters and "".join(low) in words
                short = any(len(p) <= 3 and p not in words for p in low)
                two = k == 2 and known and len(low[0]) >= 2 and 2 <= len(low[1]) <= 6 and (low[0] not in words or low[1] in udfs.BOUND_ENDINGS)
                if k == 1 or known and (short or two):
                    merges += k > 1
                    out.append("".join(part))
                    left = left[k:]
                    break
        assert r.text == " ".join(out)
    assert merges > 0


def test_fragments_of_any_length_make_a_known_word(spark):
    merge = udfs.merge_fragments({"information", "government", "inform", "forward", "ward"}, standalone=("ward",))
    df = spark.createDataFrame([("infor mation is in for mation",), ("inform ation",), ("govern ment",), ("for ward",), ("not here",)], "text string")
    got = [r.t for r in df.select(merge("text").alias("t")).collect()]
    assert got == ["information is information", "inform ation", "government", "forward", "not here"]
