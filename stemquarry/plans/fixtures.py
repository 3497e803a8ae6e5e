"""Cases made from row values: a list of texts that a number picks from, in Spark and in DuckDB alike.

The driver's tables hold no exam papers, so queries over paper rules append such texts to the whole
texts of table rows, some that a rule must find and some that it must not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The whole text of a row, in SQL and in Spark.
PLAIN_SQL = "text"


def plain() -> Column:
    return F.col("text")


#: Every text with two keys: turns of conversations, and whole documents (whose ids are behind those).
TEXT_ROWS_SQL = "(select conv_id, turn, text from conversations union all select 1000000000 + doc_id, 0, text from documents)"


def text_rows(t) -> DataFrame:
    documents = t("documents").select((F.col("doc_id") + 1_000_000_000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text").unionByName(documents)


def quoted(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: list, index: Column) -> Column:
    """The value at index modulo the list's length."""
    return F.element_at(F.array(*[F.lit(v).cast("string") if v is None else F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values: list, index: str) -> str:
    return f"list_extract([{', '.join(quoted(v) for v in values)}], cast(({index}) % {len(values)} + 1 as integer))"


def sql_list(values: list) -> str:
    return f"[{', '.join(quoted(v) for v in values)}]"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """A pattern for DuckDB: a word boundary becomes the letter, digit or underscore that isn't there.

    Good for whether a text holds the pattern; the match is a character longer at either boundary.
    """
    out, at = "", 0
    while (k := pattern.find(r"\b", at)) >= 0:
        before = pattern[:k]
        leading = not before or before.endswith(("|", "(?:", "(?i)", "("))
        out += pattern[at:k] + (r"(?:^|[^\pL\p{Nd}_])" if leading else r"(?:[^\pL\p{Nd}_]|$)")
        at = k + 2
    return ("(?i)" if ignore_case else "") + out + pattern[at:]


#: Rules that look ahead: (occurrences with what follows them, those that don't count).
AHEAD = {
    "split.ment": (r"(?i)[a-z]\s+ment(?:[^\pL\p{Nd}_]\s*[a-z]{0,4}|$)", r"(?i)^[a-z]\s+ment\s+(?:of|in|on|is|are|was|were|for|and|the|to|a)"),
    "split.able": (r"(?i)[a-z]{3,}\s+able(?:[^\pL\p{Nd}_]\s*[a-z]{0,4}|$)", r"(?i)^[a-z]{3,}\s+able\s+to"),
    "split.tor": (r"(?i)[a-z]{3,}t\s+or(?:[^\pL\p{Nd}_]\s*[a-z]?|$)", r"(?i)^[a-z]{3,}t\s+or\s+[a-z]"),
}


def sql_holds(rule: str, pattern: str, text: str = "text", ignore_case: bool = False) -> str:
    """SQL for: the text holds the rule's pattern."""
    if rule in AHEAD:
        found, but = AHEAD[rule]
        return f"len(list_filter(regexp_extract_all({text}, {quoted(found)}), lambda x: not regexp_matches(x, {quoted(but)}))) > 0"
    return f"regexp_matches({text}, {quoted(re2(pattern, ignore_case))})"


def sql_hits(source: str, keys: str, rules: list[tuple[str, str, str]], extra: str = "") -> str:
    """Rows (keys, rule, severity) of the rules (id, severity, SQL condition) that hold on rows of ``source``."""
    cells = ", ".join(f"case when {when} then {{'rule': '{rule}', 'severity': '{severity}'}} end" for rule, severity, when in rules)
    return f"select {keys}, hit.rule, hit.severity from (select {keys}{extra}, unnest(list_filter([{cells}], lambda x: x is not null)) hit from {source})"
