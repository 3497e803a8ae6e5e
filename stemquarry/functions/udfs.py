"""The few functions that no built-in expresses, as vectorised (Arrow-batched) pandas UDFs."""

from __future__ import annotations

import html as html_lib
import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import BlockMatcher


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """TXT-01/04: compatibility composition."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def similarity(a: str | None, b: str | None, autojunk: bool = True) -> float | None:
    return None if a is None or b is None else BlockMatcher(a, b, autojunk).ratio()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """CMP-01: matching-block similarity (popular characters of a text of 200 or more start no block, as the default has it)."""
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio_exact(a: pd.Series, b: pd.Series) -> pd.Series:
    """CMP-01 without automatic junk."""
    return pd.Series([similarity(x, y, False) for x, y in zip(a, b, strict=True)], dtype="float64")


EDIT = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("op", T.StringType()), ("left", T.StringType()), ("right", T.StringType()), ("context", T.StringType()))]))


@F.pandas_udf(EDIT)
def differences(a: pd.Series, b: pd.Series) -> pd.Series:
    """CMP-02: edit steps with ten characters of context; blank-only and code-only steps are left out."""

    def one(x: str | None, y: str | None) -> list[dict]:
        out = []
        for op, i, j, k, m in BlockMatcher(x or "", y or "", False).get_opcodes():
            left, right = (x or "")[i:j], (y or "")[k:m]
            if op != "equal" and (left.strip() or right.strip()) and not re.fullmatch(r"\s*\d{5}\s*", left + right):
                out.append({"op": op, "left": left, "right": right, "context": (x or "")[max(0, i - 10) : j + 10]})
        return out

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def find_spans(pattern: str):
    """TXT-30: all matches with positions (code points, end exclusive)."""

    @F.pandas_udf(SPAN)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rx = re.compile(pattern)
        for s in parts:
            yield s.map(lambda x: [{"start": m.start(), "end": m.end(), "text": m[0]} for m in rx.finditer(x or "")])

    return run


# The score of a letter in a known word and in an unknown piece, the divisor of the
# frequency bonus and its cap, the cost of a piece, and the least mean length of pieces.
KNOWN_LETTER, UNKNOWN_LETTER, BONUS_PER, BONUS_CAP, SPLIT_COST, LEAST_MEAN = 10, 5, 10, 100, 8.0, 2.5


def segment_word(word: str, frequency: dict[str, int], split_cost: float = SPLIT_COST, longest: int = 24) -> list[str]:
    """TXT-18: best split of a letter run: word score 10 per letter plus a frequency bonus, less
    ``split_cost`` for each piece; an unknown piece with a vowel scores 5 per letter, else 0.  A
    result whose mean piece is under 2.5 letters is given back whole."""
    n, low = len(word), word.lower()
    best = [0.0] + [float("-inf")] * n
    back = [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            piece = low[start:end]
            seen = frequency.get(piece)
            score = KNOWN_LETTER * len(piece) + min(seen, BONUS_CAP) / BONUS_PER if seen else UNKNOWN_LETTER * len(piece) if re.search("[aeiou]", piece) else 0
            if best[start] + score - split_cost > best[end]:
                best[end], back[end] = best[start] + score - split_cost, start
    out, at = [], n
    while at:
        out.append(word[back[at] : at])
        at = back[at]
    out.reverse()
    return out if out and n / len(out) >= LEAST_MEAN else [word]


def segment_words(frequency: dict[str, int], least: int = 8, external: Callable[[str], list[str]] | None = None, external_least: int = 18):
    """TXT-19/20: split letter runs of at least ``least`` letters, case borders first.

    Words of ``external_least`` or more lower-case letters go to the ``external`` segmenter where the
    caller has one (TXT-20), else to the same split as the others.  The dictionary is
    captured by the function; callers check its size (sources.tables.dictionary; operators.dictionary takes one of any size).
    """

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rx = re.compile(f"[A-Za-z]{{{least},}}")
        for s in parts:
            yield s.map(lambda x: None if x is None else rx.sub(lambda m: split_run(m[0], frequency, external, external_least), x))

    return run


def run_pieces(run: str) -> list[str]:
    """Parts of a letter run between case borders."""
    return re.sub("([a-z])([A-Z])", r"\1 \2", run).split(" ")


def split_run(run: str, frequency: dict[str, int], external: Callable[[str], list[str]] | None = None, external_least: int = 18) -> str:
    """TXT-19/20 for one run: parts of six letters or more are split, the others stay."""
    cut = lambda p: external(p) if external and len(p) >= external_least and p.islower() else segment_word(p, frequency) if len(p) >= 6 else [p]
    return " ".join(" ".join(cut(p)) for p in run_pieces(run))


# Endings that are no words of their own.
BOUND_ENDINGS = ("tion", "sion", "ment", "ness", "ence", "ance", "able", "ible", "ity", "ous", "ive", "ally", "ing", "ed", "ly", "ful", "ism", "ist")


def merge_text(text: str, words: set[str], standalone: tuple[str, ...] = ()) -> str:
    """TXT-22/23: join neighbouring Latin fragments into a known word.

    Four, three or two fragments make a word of five or more letters where one of them is short (up to
    three letters) and no word itself (TXT-23).  Two fragments make a word, whatever their length,
    where the first is no word itself, or the second a bound ending, unless the second is one of
    ``standalone`` (TXT-22).
    """

    def joins(piece: list[str]) -> bool:
        low = [p.lower() for p in piece]
        if not all(re.fullmatch("[A-Za-z]+", p) for p in piece) or "".join(low) not in words:
            return False
        if sum(map(len, low)) >= 5 and any(len(p) <= 3 and p not in words for p in low):
            return True
        first, last = low[0], low[-1]
        return len(piece) == 2 and len(first) >= 2 and 2 <= len(last) <= 6 and last not in standalone and (first not in words or last in BOUND_ENDINGS)

    tokens, out, i = text.split(" "), [], 0
    while i < len(tokens):
        k = next((k for k in (4, 3, 2) if i + k <= len(tokens) and joins(tokens[i : i + k])), 1)
        out.append("".join(tokens[i : i + k]))
        i += k
    return " ".join(out)


def merge_fragments(words: set[str], standalone: tuple[str, ...] = ()):
    """TXT-22/23 with a dictionary that the function holds (operators.dictionary takes one of any size)."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else merge_text(x, words, standalone))

    return run


@F.pandas_udf(T.StringType())
def visible_text(s: pd.Series) -> pd.Series:
    """SRC-12: text of a page without markup, scripts and styles; blocks end with a line break."""

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.hidden = 0

        def handle_starttag(self, tag: str, attrs: list) -> None:
            self.hidden += tag in ("script", "style")
            if tag in ("p", "div", "li", "br", "h1", "h2", "h3", "article", "footer", "nav"):
                self.out.append("\n")

        def handle_endtag(self, tag: str) -> None:
            if tag in ("script", "style"):
                self.hidden = max(0, self.hidden - 1)

        def handle_data(self, data: str) -> None:
            if not self.hidden:
                self.out.append(data)

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        r = Reader()
        r.feed(x)
        r.close()
        return re.sub(r"\n{2,}", "\n", "".join(r.out)).strip()

    return s.map(one)


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html_lib.unescape(x))


CARDS = T.ArrayType(
    T.StructType(
        [
            T.StructField("card", T.StringType()),
            T.StructField("number", T.StringType()),
            T.StructField("answer", T.StringType()),
            T.StructField("stem", T.StringType()),
            T.StructField("options", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)


@F.pandas_udf(CARDS)
def question_cards(s: pd.Series) -> pd.Series:
    """SRC-12: cards, questions and options of rendered pages (.subject-card, .q-block, .mc-opt)."""

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.found: list[dict] = []
            self.card, self.key, self.open = None, None, []

        def handle_starttag(self, tag: str, attrs: list) -> None:
            a = dict(attrs)
            kinds = (a.get("class") or "").split()
            self.open.append((tag, self.key))
            if "subject-card" in kinds:
                self.card = a.get("id")
            elif "q-block" in kinds:
                self.found.append({"card": self.card, "number": a.get("data-qnum"), "answer": a.get("data-answer"), "stem": "", "options": {}})
                self.key = None
            elif self.found and ("mc-question" in kinds or "essay-question" in kinds):
                self.key = "stem"
            elif self.found and "mc-opt" in kinds:
                self.key = a.get("data-val")
            if tag in ("br", "img", "meta", "link", "input", "hr"):
                self.open.pop()

        def handle_endtag(self, tag: str) -> None:
            while self.open:
                name, key = self.open.pop()
                if name == tag:
                    self.key = key
                    break

        def handle_data(self, data: str) -> None:
            if self.found and self.key == "stem":
                self.found[-1]["stem"] += data.strip()
            elif self.found and self.key:
                options = self.found[-1]["options"]
                options[self.key] = options.get(self.key, "") + data.strip()

    def one(x: str | None) -> list[dict]:
        r = Reader()
        r.feed(x or "")
        r.close()
        return r.found

    return s.map(one)
