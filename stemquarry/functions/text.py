"""Text, number, hash, map and array functions as Column expressions (all JVM-side).

Every function takes a column (or its name) and returns a Column; nothing here starts a job.
Python's ``\\s`` and ``\\w`` are Unicode-aware, so patterns carry ``(?U)`` where that matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: ColumnOrName) -> Column:
    """Null, empty and all-space are the same: absent."""
    return F.coalesce(F.trim(col(c)), F.lit("")) == ""


def fold(c: ColumnOrName, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, col(c))


def fold_literal(c: ColumnOrName, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements (phrase tables are data: see sources.tables)."""
    return reduce(lambda acc, r: F.replace(acc, F.lit(r[0]), F.lit(r[1])), pairs, col(c))


# Words that text recognition splits, with their repairs, in order.
BROKEN_WORDS = [
    (r"(?U)(\w)ti on\b", "$1tion"),
    (r"(?U)(\w)si on\b", "$1sion"),
    (r"(?U)\bth at\b", "that"),
    (r"(?U)\bth is\b", "this"),
    (r"(?U)\bth e\b", "the"),
    (r"(?U)\bth ey\b", "they"),
    (r"(?U)\bth eir\b", "their"),
    (r"(?U)\bth ere\b", "there"),
    (r"(?U)\bth ese\b", "these"),
    (r"(?U)\bth ose\b", "those"),
    (r"(?U)\bth rough\b", "through"),
    (r"(?U)\bwh at\b", "what"),
    (r"(?U)\bwh en\b", "when"),
    (r"(?U)\bwh ere\b", "where"),
    (r"(?U)\bwh ich\b", "which"),
    (r"(?U)\bwh ile\b", "while"),
    (r"(?U)\bf or\b", "for"),
    (r"(?U)\bf rom\b", "from"),
    (r"(?U)\bin to\b", "into"),
    (r"(?U)\bhum an\b", "human"),
    (r"(?U)\bpers on\b", "person"),
    (r"(?U)\bpris on\b", "prison"),
    (r"(?U)\breas on\b", "reason"),
    (r"(?U)\bcomm on\b", "common"),
    (r"(?U)\bmonit or\b", "monitor"),
]


def repair_broken_words(c: ColumnOrName) -> Column:
    """TXT-02: ordered repairs of split words."""
    return fold(c, BROKEN_WORDS)


def drop_paper_codes(c: ColumnOrName) -> Column:
    """TXT-01 (second step): standalone five-digit numbers go."""
    return F.regexp_replace(col(c), r"(?U)\b\d{5}\b", "")


def collapse_spaced_cjk(c: ColumnOrName) -> Column:
    """TXT-03: no spaces between CJK characters."""
    return F.regexp_replace(col(c), r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", "")


# Full-width brackets, marks and their half-width forms.
FULL_BRACKETS, HALF_BRACKETS = "（）", "()"
FULL_MARKS, HALF_MARKS = "，。；：？！（）", ",.;:?!()"


def half_width_brackets(c: ColumnOrName) -> Column:
    """TXT-06."""
    return F.translate(col(c), FULL_BRACKETS, HALF_BRACKETS)


def full_width_brackets(c: ColumnOrName) -> Column:
    return F.translate(col(c), HALF_BRACKETS, FULL_BRACKETS)


def comparison_key(c: ColumnOrName) -> Column:
    """TXT-04 without its NFKC step (see udfs.nfkc): no blanks, folded marks, lower case."""
    return F.lower(F.translate(F.regexp_replace(col(c), r"(?U)\s+", ""), FULL_MARKS, HALF_MARKS))


def loose_key(c: ColumnOrName) -> Column:
    """TXT-05 without NFKC: runs of blanks become one space."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def replace_private_use(c: ColumnOrName, table: dict[str, str]) -> Column:
    """TXT-07: map private-use characters, then drop what is left of them."""
    return F.regexp_replace(fold_literal(c, list(table.items())), r"[\x{E000}-\x{F8FF}]", "")


def strip_invisible(c: ColumnOrName) -> Column:
    """TXT-08: control, zero-width and private-use characters go."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{200B}-\x{200F}\x{FEFF}\x{E000}-\x{F8FF}]", "")


def to_traditional(c: ColumnOrName, table: dict[str, str]) -> Column:
    """TXT-09: one-to-one character map."""
    return F.translate(col(c), "".join(table), "".join(table.values()))


def clean_blanks(c: ColumnOrName) -> Column:
    """TXT-10: runs of spaces and tabs become one, lines are trimmed."""
    return F.trim(fold(c, [(r"[ \t]+", " "), (r"(?m)^ +| +$", "")]))


def squeeze_spaces(c: ColumnOrName, least: int = 3) -> Column:
    """TXT-11: ``least`` or more spaces become one."""
    return F.regexp_replace(col(c), f" {{{least},}}", " ")


#: Blanks of ``\\s`` in patterns without (?U).
BLANKS = " \t\n\x0b\f\r"


def rstrip(c: ColumnOrName, chars: str) -> Column:
    """The text without ``chars`` at its end, in one pass (a pattern ``[...]*$`` tries every run in the text)."""
    return F.rtrim(col(c), F.lit(chars))


def _strip_dashes(t: Column) -> Column:
    """Without ``(?:\\s*-\\s*[、-]?)+\\s*$``.

    Of the blanks, dashes and enumeration marks at the end, that takes all behind the last mark that
    has no dash before it (since the mark before).  Matchers recurse for each repeat of a group, so a
    long end would overflow their stack.
    """
    core = rstrip(t, BLANKS + "-、")
    parts = F.split(F.substring(t, F.length(core) + 1, F.length(t)), "、")
    without = F.array_position(F.reverse(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: ~F.contains(p, F.lit("-")))), F.lit(True))
    kept = F.when(without > 0, F.size(parts) - without).otherwise(F.lit(0)).cast("int")
    head = F.concat(core, F.array_join(F.slice(parts, F.lit(1), kept), "、"), F.when(kept > 0, "、").otherwise(""))
    return F.when(F.contains(F.get(parts, kept), F.lit("-")), head).otherwise(t)


def strip_trailing_noise(c: ColumnOrName) -> Column:
    """TXT-12: dashes, stray marks and page numbers at the end."""
    t = _strip_dashes(col(c))
    bare = rstrip(t, BLANKS)
    t = F.when(F.right(bare, F.lit(1)).isin(*"、,;；"), rstrip(F.left(bare, F.length(bare) - 1), BLANKS)).otherwise(t)
    bare = rstrip(t, BLANKS)
    number = F.length(F.regexp_extract(F.right(bare, F.lit(5)), r"\s-?\d{1,2}-?$", 0))
    return F.when(number > 0, rstrip(F.left(bare, F.length(bare) - number), BLANKS)).otherwise(t)


def strip_page_residue(c: ColumnOrName) -> Column:
    """TXT-13: page markers and turn-over notes."""
    return fold(c, [(r"第\s*\d+\s*頁|共\s*\d+\s*頁|全[一二三四五六七八九十]+頁", ""), (r"(?s)(?:請接背面|請以背面|背面尚有試題).*$", "")])


def clean_exam_time(c: ColumnOrName) -> Column:
    """TXT-14: cut the seat number and all behind it."""
    return F.trim(F.regexp_replace(col(c), r"(?s)(?<!\s)\s*座\s*號.*$", ""))


def strip_trailing_pipe(c: ColumnOrName) -> Column:
    """TXT-15."""
    return rstrip(c, BLANKS + "|")


def split_camel(c: ColumnOrName, least_hits: int = 0) -> Column:
    """TXT-16: a space where a lower-case letter meets an upper-case one, if there are enough."""
    text = col(c)
    split = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return split if not least_hits else F.when(F.regexp_count(text, F.lit("[a-z][A-Z]")) >= least_hits, split).otherwise(text)


def space_digits(c: ColumnOrName) -> Column:
    """TXT-17: a space between digits and letters."""
    return fold(c, [(r"(?<=\d)(?=[A-Za-z]{2})", " "), (r"(?<=[A-Za-z]{2})(?=\d)", " ")])


def has_cjk(c: ColumnOrName) -> Column:
    """TXT-24."""
    return col(c).rlike("[一-鿿]")


def english_segments(c: ColumnOrName) -> Column:
    """TXT-24: runs of Latin words with one space between them.

    The spaces inside runs are marked first, so that a run is one character class: matchers recurse
    for each repeat of a group, and a long text would overflow their stack.
    """
    marked = F.regexp_replace(F.translate(col(c), "\u0001", "\n"), r"(?<=[A-Za-z'-]) (?=[A-Za-z])", "\u0001")
    return F.transform(F.regexp_extract_all(marked, F.lit("[A-Za-z][A-Za-z'\u0001-]*"), F.lit(0)), lambda x: F.translate(x, "\u0001", " "))


#: Numerals up to twenty, by rule.
_DIGITS = "一二三四五六七八九"
NUMERALS = {d: i for i, d in enumerate(_DIGITS, 1)} | {"十": 10, "二十": 20} | {f"十{d}": 10 + i for i, d in enumerate(_DIGITS, 1)}


def numeral_value(c: ColumnOrName) -> Column:
    """TXT-25: 1 to 20; anything else is null."""
    table = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    return table[col(c)]


def declared_count(notes: ColumnOrName) -> Column:
    """TXT-26: the number of choice questions that notes declare, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.array_join(col(notes), " "), r"共\s*(\d+)\s*題", 1), F.lit("")), F.lit("999999")).cast("int")


def notes_mention_essay(notes: ColumnOrName) -> Column:
    """TXT-27."""
    return F.coalesce(F.array_join(col(notes), " ").rlike("申論|作文|公文"), F.lit(False))


def notes_mention_choice(notes: ColumnOrName) -> Column:
    return F.coalesce(F.array_join(col(notes), " ").rlike("選擇|測驗|2B|試卡"), F.lit(False))


def shorten_subject(c: ColumnOrName) -> Column:
    """TXT-28: more than three listed names in brackets keep two."""
    text = col(c)
    inner = F.regexp_extract(text, "（([^）]*)）", 1)
    parts = F.split(inner, "、")
    short = F.concat(F.array_join(F.slice(parts, 1, 2), "、"), F.lit("等"))
    return F.when(F.size(parts) > 4, F.replace(text, inner, short)).otherwise(text)


def snippet(c: ColumnOrName, needle: str, margin: int = 20) -> Column:
    """PRJ-05: the first occurrence of a literal with ``margin`` characters on either side, or null."""
    at = F.position(F.lit(needle), col(c))
    start = F.greatest(F.lit(1), at - margin)
    return F.when(at > 0, F.substring(col(c), start, at - start + len(needle) + margin))


def deep_apply(df_columns: list[tuple[str, str]], f) -> dict[str, Column]:
    """PRJ-03: apply a text function to every string, string array and string map of a schema."""
    out = {}
    for name, kind in df_columns:
        if kind == "string":
            out[name] = f(F.col(name))
        elif kind == "array<string>":
            out[name] = F.transform(name, lambda x: f(x))
        elif kind == "map<string,string>":
            out[name] = F.transform_values(name, lambda k, v: f(v))
    return out


def safe_file_name(c: ColumnOrName, most: int = 80) -> Column:
    """TXT-29."""
    return F.substring(F.trim(fold(c, [(r'[<>:"/\\|?*]', "_"), (r"\s+", " ")])), 1, most)


def escape_html(c: ColumnOrName) -> Column:
    """TXT-31: markup characters as entities."""
    return fold_literal(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def essay_lines(c: ColumnOrName) -> Column:
    """TXT-32: keep paragraph and sub-item breaks, drop soft wraps."""
    keep = F.regexp_replace(col(c), r"\n\s*\n|\n(?=[（(]?[一二三四五六七八九十\d]+[）)、.])", "\u0001")
    return F.replace(F.replace(keep, F.lit("\n"), F.lit("")), F.lit("\u0001"), F.lit("\n"))


def containment_level(phrase: ColumnOrName, text: ColumnOrName) -> Column:
    """TXT-33: 1 whole phrase, 2 its core, 3 at least 60 % of its chunks, 0 none."""
    p, t = col(phrase), col(text)
    n = F.length(p)
    trim = F.greatest(F.lit(3), F.floor(n / 5)).cast("int")
    core = F.substring(p, trim + 1, n - 2 * trim)
    size = F.greatest(F.lit(1), F.least(F.lit(15), F.floor(n / 2))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(n / size).cast("int") - 1)), lambda i: F.substring(p, i * size + 1, size))
    found = F.size(F.filter(chunks, lambda c: F.contains(t, c)))
    return (
        F.when(F.contains(t, p), 1)
        .when((n - 2 * trim > 0) & F.contains(t, core), 2)
        .when(found >= 0.6 * F.size(chunks), 3)
        .otherwise(0)
    )


def sentences(c: ColumnOrName, least: int = 8) -> Column:
    """TXT-34: sentence parts of at least ``least`` characters."""
    parts = F.transform(F.split(col(c), r"[。？！；\n]|(?<=[a-z])\. (?=[A-Z])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def occurrences(text: ColumnOrName, needle: str) -> Column:
    """CLI-02: non-overlapping, case-insensitive occurrences of a literal."""
    t = F.lower(col(text))
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def share(c: ColumnOrName, pattern: str) -> Column:
    """AGG-29: share of characters that match a one-character pattern."""
    t = col(c)
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit(pattern)) / F.length(t)).otherwise(F.lit(0.0))


def hash_prefix(c: ColumnOrName, n: int = 8) -> Column:
    """MTH-01."""
    return F.substring(F.md5(col(c).cast("binary")), 1, n)


def card_id(year: ColumnOrName, subject: ColumnOrName) -> Column:
    """PRJ-04: y{year}-{ascii slug}, or a hash prefix where nothing ASCII is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(subject)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("y"), col(year).cast("string"), F.lit("-"), F.when(slug == "", hash_prefix(subject)).otherwise(slug))


def percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """MTH-02: integer percent, half up; 0 of nothing."""
    return F.when(col(whole) > 0, F.floor(100 * col(part) / col(whole) + 0.5)).otherwise(F.lit(0)).cast("long")


def gregorian(year: ColumnOrName) -> Column:
    """DAT-01."""
    return col(year) + 1911


def year_list(c: ColumnOrName) -> Column:
    """DAT-01: ``a-b``, ``a,b`` or ``a`` as an array of years."""
    t = col(c)
    ends = F.transform(F.split(t, "-"), lambda x: F.trim(x).cast("int"))
    return F.when(t.contains("-"), F.sequence(ends[0], ends[1])).otherwise(F.transform(F.split(t, ","), lambda x: F.trim(x).cast("int")))


def session_valid(started_ms: ColumnOrName, now_ms: ColumnOrName, hours: int = 1) -> Column:
    """DAT-02."""
    return (col(now_ms) - col(started_ms)) < hours * 3_600_000


def drop_empty_options(options: ColumnOrName) -> Column:
    """MAP-01: empty options go where at least three others remain."""
    kept = F.map_filter(col(options), lambda k, v: ~blank(v))
    return F.when(F.size(kept) >= 3, kept).otherwise(col(options))


def with_missing_answer(options: ColumnOrName, answer: ColumnOrName, placeholder: str = "[待補]") -> Column:
    """MAP-02: the answer's key is added with a placeholder, keys in order."""
    o, a = col(options), col(answer)
    missing = a.rlike("^[A-F]$") & ~F.map_contains_key(o, a)
    return sort_options(F.when(missing, F.map_concat(o, F.create_map(a, F.lit(placeholder)))).otherwise(o))


def sort_options(options: ColumnOrName) -> Column:
    """ORD-07."""
    return F.map_from_entries(F.array_sort(F.map_entries(col(options))))


def distinct_options(options: ColumnOrName) -> Column:
    """MAP-03."""
    return F.size(F.array_distinct(F.transform(F.map_values(col(options)), lambda v: F.trim(v))))


def answer_letters(c: ColumnOrName) -> Column:
    """ARR-01: alternatives as an array."""
    return F.regexp_extract_all(col(c), F.lit("[A-F]"), F.lit(0))


def marker_count(raw: ColumnOrName, marker: str = "_todo") -> Column:
    """JSN-01: occurrences of a literal in a serialised document."""
    t = col(raw)
    return ((F.length(t) - F.length(F.replace(t, F.lit(marker), F.lit("")))) / len(marker)).cast("long")
