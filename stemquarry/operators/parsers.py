"""Page text to questions: line rows, event flags, carry-forward and segments (no per-document loop).

Lines are rows (doc, line, text) in order.  A line's kind comes from patterns; note mode, sections
and question segments are running windows over each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import repairs
from . import windows as win

# Line kinds.
CHOICE = r"^\s*(\d{1,3})\s*[.、．)\s]\s*(.+)"
ESSAY = r"^\s*([一二三四五六七八九十]+)\s*[、．.]\s*(.+)"
SECTION = r"^\s*(甲|乙)\s*[、．.]\s*(申論題|測驗題|選擇題)"
NOTE = r"^\s*[※＊*]?\s*注意\s*[：:]|不必抄題|不予計分|禁止使用電子計算器|本試題為單一選擇題|鋼筆或原子筆|2B鉛筆|應使用本國文字|可以使用電子計算器"
# Beginnings of page headers and residue, one entry for each.
HEADERS = (
    r"^\d{2,3}年(公務|特種)",
    r"^代號[:：]",
    r"^頁次[:：]",
    r"^考試(別|時間)",
    r"^等\s*別[:：]",
    r"^類\s*科",
    r"^科\s*目[:：]",
    r"^座號",
    r"^(全一張|全一頁)",
    r"^-?\d+-?$",
    r"^\d{5}$",
    r"^(請接背面|請以背面)",
    r"^(背面尚有|請翻頁)",
)
HEADER = "|".join(HEADERS)
# The line that opens a reading group, and stems that refer to a figure.
PASSAGE_HEADER = r"請依下文回答第\s*(\d+)\s*題至第\s*(\d+)\s*題"
FIGURE = r"如圖[一二三四五六七八九十①②③④⑤⑥⑦⑧⑨⑩(（\d]|附圖|下圖所示|如下圖"
HEADER_WORDS = "人員考試|考試別|退除役軍人"
METADATA = {
    "exam_type": r"(\d{2,3})\s*年\s*(特種考試|公務人員特種考試)",
    "exam_name": r"(警察人員考試|一般警察人員考試)",
    "level": r"(三等|四等)考試",
    "category": r"類\s*科[：:]\s*(.+)",
    "subject": r"科\s*目[：:]\s*(.+)",
    "exam_time": r"考試時間[：:]\s*(.+)",
    "code": r"代號[：:]\s*(\d{5})",
}


def metadata(text: str = "text", first: int = 500) -> list[Column]:
    """GEN-01: facets from the first characters of a document (null where absent)."""
    head = F.substring(text, 1, first)
    return [F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit("")).alias(k) for k, p in METADATA.items()]


def is_header(line: Column) -> Column:
    """FIL-10."""
    t = F.trim(line)
    return (t == "") | t.rlike(HEADER) | (t.rlike(HEADER_WORDS) & (F.length(t) < 80))


def is_note(line: Column) -> Column:
    return F.trim(line).rlike(NOTE)


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "text")).withColumn("text", F.trim("text"))


def classified(lines: DataFrame, key: str) -> DataFrame:
    """GEN-02, WIN-12: lines with their kind and, for content lines, section and segment numbers."""
    t = F.col("text")
    event = F.when(is_note(t), "note").when(t.rlike(SECTION), "section").when(t.rlike(ESSAY), "essay").when(t.rlike(CHOICE), "choice")
    seen = lines.where(~is_header(t)).withColumn("event", event)
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mode = F.last("event", ignorenulls=True).over(upto)
    seen = seen.withColumn("mode", mode)
    kind = F.when(F.col("mode") == "note", "note").when(F.col("event").isNull(), F.when(F.col("mode").isin("essay", "choice"), "more").otherwise("other")).otherwise(F.col("event"))
    return seen.withColumn("kind", kind).withColumns(
        {
            "section": F.last(F.when(F.col("event") == "section", F.regexp_replace("text", SECTION + ".*$", "$1、$2")), ignorenulls=True).over(upto),
            "segment": F.sum(F.when(F.col("kind").isin("essay", "choice", "section"), 1).otherwise(0)).over(upto),
        }
    )


def parse_questions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """GEN-02/05: (key, pos, number, type, stem, options, section) of every question in order."""
    parts = classified(lines_of(docs, key, text), key).where("kind in ('essay', 'choice', 'more')")
    own = F.array_sort(F.collect_list(F.struct("line", "text", "kind", "section")))
    q = parts.groupBy(key, "segment").agg(own.alias("rows")).where("rows[0].kind in ('essay', 'choice')")
    head, kind = F.col("rows")[0]["text"], F.col("rows")[0]["kind"]
    body = F.transform(F.slice("rows", 2, 100000000), lambda r: r["text"])
    essay_stem = F.array_join(F.concat(F.array(F.regexp_extract(head, ESSAY, 2)), body), "\n")
    choice_text = F.array_join(F.concat(F.array(F.regexp_extract(head, CHOICE, 2)), body), " ")
    options = F.when(kind == "choice", repairs.labelled_options(choice_text))
    cut = F.trim(F.regexp_extract(choice_text, r"(?s)^(.*)[(（]A[)）].*$", 1))
    stem = F.when(kind == "essay", essay_stem).when(options.isNotNull(), cut).otherwise(choice_text)
    return q.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("segment")) - 1).alias("pos"),
        F.when(kind == "essay", F.regexp_extract(head, ESSAY, 1)).otherwise(F.regexp_extract(head, CHOICE, 1)).alias("number"), kind.alias("type"),
        F.trim(tx.repair_broken_words(tx.drop_paper_codes(stem))).alias("stem"), options.alias("options"), F.col("rows")[0]["section"].alias("section"),
    )


def notes_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """GEN-02: note lines of each document in order."""
    n = classified(lines_of(docs, key, text), key).where("kind = 'note'")
    return n.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]).alias("notes"))


def essays_by_gap(words: DataFrame, key: str) -> DataFrame:
    """GEN-03: paragraphs of positioned lines (key, y, text) that carry a score mark, numbered."""
    p = win.paragraph_id(words, key, "y")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "text"))), lambda r: r["text"]), "")
    essays = p.groupBy(key, "paragraph").agg(joined.alias("stem")).where(F.col("stem").rlike(r"\d+\s*分"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("paragraph"))
    return essays.withColumn("number", win.numeral_of(at)).select(key, "number", "stem")


def answers_of(lines: DataFrame, key: str) -> DataFrame:
    """GEN-08/SRC-10: (key, number, answer) from pairs of a number line and an answer line."""
    w = Window.partitionBy(key).orderBy("line")
    pairs = lines.withColumn("below", F.lead("text").over(w)).where(F.col("text").rlike("^題號") & F.col("below").rlike("^答案"))
    numbers = F.regexp_extract_all("text", F.lit(r"(?:第)?(\d+)(?:題)?"), F.lit(1))
    marks = F.regexp_extract_all("below", F.lit(r"[A-Da-d#*]"), F.lit(0))
    return pairs.select(key, F.explode(F.arrays_zip(numbers.alias("n"), marks.alias("a"))).alias("z")).select(key, F.col("z.n").cast("int").alias("number"), F.upper("z.a").alias("answer")).where("number is not null and answer is not null")


def corrections_of(lines: DataFrame, key: str) -> DataFrame:
    """GEN-08: corrections such as 第3題答Ａ或Ｂ者均給分: alternatives joined, or 送分."""
    t = F.translate("text", "ＡＢＣＤ", "ABCD")
    number = F.regexp_extract(t, r"第\s*(\d+)\s*題", 1).try_cast("int")
    letters = F.array_join(F.array_distinct(F.regexp_extract_all(t, F.lit("[A-D]"), F.lit(0))), "或")
    return lines.select(key, number.alias("number"), F.when(t.rlike("一律給分|均給分") & (letters == ""), "送分").otherwise(letters).alias("answer")).where("number is not null and answer <> ''")


def category_of(subjects: Column, rules: list[tuple[str, str]]) -> Column:
    """GEN-10: the first rule whose pattern the joined subject names hold."""
    joined = F.array_join(subjects, "|||")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(joined.rlike(pattern), name).otherwise(out)
    return out


def numbered_segments(docs: DataFrame, key: str, text: str = "text", low: int = 1, high: int = 80) -> DataFrame:
    """GEN-06/11, WIN-10: text from one question number (low to high) to the next; of repeated numbers the last stays.

    A number outside the bounds (a year, a page) is part of the text before it.
    """
    lines = lines_of(docs, key, text).withColumn("number", F.regexp_extract("text", CHOICE, 1).try_cast("int"))
    segments = win.attach_lines(lines, key, "line", "text", F.coalesce(F.col("number").between(low, high), F.lit(False)))
    out = segments.withColumn("number", F.regexp_extract(F.split("text", "\n")[0], CHOICE, 1).cast("int"))
    return out.groupBy(key, "number").agg(F.max_by("text", "line").alias("text"))


def two_columns(chars: DataFrame, key: str, split: float) -> DataFrame:
    """GEN-07: characters (key, x, y, text) to lines, the left column before the right one."""
    side = chars.withColumn("_k", F.struct(F.col(key).alias("key"), (F.col("x") >= split).cast("int").alias("column")))
    ordered = side.groupBy("_k", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda r: r["text"]), "").alias("text"))
    lines = win.anchored_lines(ordered, "_k", "y", "text")
    return lines.select(F.col("_k.key").alias(key), F.col("_k.column").alias("column"), "line", "text")


def parse_documents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """GEN-04: one row per document: facets, notes, number of questions by type."""
    q = parse_questions(docs, key, text).groupBy(key).agg(F.count("*").alias("questions"), F.count_if(F.col("type") == "choice").alias("choice"), F.count_if(F.col("type") == "essay").alias("essay"))
    return docs.select(key, *metadata(text)).join(notes_of(docs, key, text), key, "left").join(q, key, "left").fillna(0, ["questions", "choice", "essay"])


def parse_batch(docs: DataFrame, key: str, answers: DataFrame, private_use: dict[str, str], text: str = "text") -> DataFrame:
    """GEN-09: first of equal documents, private-use characters mapped, parsed, demoted, answers merged."""
    from . import joins, sets

    first = sets.flag_copies(docs.select(key, text), F.col(text), key).where("not is_copy").select(key, tx.replace_private_use(text, private_use).alias(text))
    q = parse_questions(first, key, text).withColumn("number_int", F.col("number").try_cast("int"))
    few = (F.col("type") == "choice") & (F.coalesce(F.size("options"), F.lit(0)) < 2)
    q = q.withColumn("type", F.when(few, "essay").otherwise(F.col("type"))).withColumn("answer", F.lit(None).cast("string"))
    return joins.fill_from_key(q, answers.withColumnRenamed("number", "number_int"), [key, "number_int"], "answer", overwrite=True)


def questions_from_notes(files: DataFrame) -> DataFrame:
    """REP-16: questions that stand among the notes of a paper."""
    docs = files.select("file_id", F.array_join(F.filter("notes", lambda n: ~is_note(n)), "\n").alias("text"))
    return parse_questions(docs, "file_id")


def single_question(docs: DataFrame, key: str, number: int, text: str = "text") -> DataFrame:
    """GEN-05: the first choice question of one number in each document."""
    q = parse_questions(docs, key, text).where((F.col("type") == "choice") & (F.col("number").try_cast("int") == number))
    return q.groupBy(key).agg(F.min_by(F.struct("number", "stem", "options", "section"), "pos").alias("q")).select(key, "q.*")


def reading_groups(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """GEN-05: choice questions with the passage of their range: from its header to the next question.

    Of ranges that hold a number the first in the document counts.  A stem under 20 characters makes
    the question a cloze, else it is reading comprehension.
    """
    lines = lines_of(docs, key, text).where(~is_header(F.col("text")))
    starts = F.col("text").rlike(PASSAGE_HEADER) | F.col("text").rlike(CHOICE)
    parts = win.attach_lines(lines, key, "line", "text", starts, " ").where(F.split("text", "\n")[0].rlike(PASSAGE_HEADER))
    low, high = (F.regexp_extract("text", PASSAGE_HEADER, g).cast("int") for g in (1, 2))
    ranges = parts.where(low <= high).select(key, "line", F.col("text").alias("passage"), F.explode(F.sequence(low, high)).alias("number_int"))
    first = ranges.groupBy(key, "number_int").agg(F.min_by("passage", "line").alias("passage"))
    q = parse_questions(docs, key, text).where("type = 'choice'").withColumn("number_int", F.col("number").try_cast("int"))
    kind = F.when(F.col("passage").isNotNull(), F.when(F.length("stem") < 20, "cloze").otherwise("reading_comprehension"))
    return q.join(first, [key, "number_int"], "left").withColumn("subtype", kind)


def english_questions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """GEN-06: (key, number, stem, options) of an English page whose options carry no labels: the words of
    the question's last line if they are four, else what stands behind the number is all stem."""
    from . import options as op

    q = numbered_segments(docs, key, text)
    body = F.regexp_replace("text", r"^\s*\d{1,3}\s*[.、．)\s]\s*", "")
    lines = F.split(body, "\n")
    found = op.four_words(body)
    stem = F.when(found.isNotNull(), F.array_join(F.slice(lines, 1, F.size(lines) - 1), " ")).otherwise(F.array_join(lines, " "))
    return q.select(key, "number", F.trim(stem).alias("stem"), found.alias("options"))


def answer_tables(cells: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """SRC-10: (key, number, answer) of answer sheets: table columns headed 第n題; for numbers without one, pairs
    in the running text and numbers that it calls free.

    ``cells(key, page, table, row, cells)`` holds table rows (0 the header, 1 the answers),
    ``texts(key, page, text)`` page texts.  Of several table finds the last counts, of several in texts the
    first: by page, then pairs before free numbers.
    """
    free = lambda c: c.rlike("送分|一律給分")
    w = [key, "page", "table"]
    header = cells.where("row = 0").select(*w, F.col("cells").alias("h"))
    z = header.join(cells.where("row = 1").select(*w, F.col("cells").alias("a")), w).select(key, "page", "table", F.posexplode(F.arrays_zip("h", "a")).alias("at", "z"))
    number, a = F.regexp_extract(F.coalesce("z.h", F.lit("")), r"第(\d+)題", 1).try_cast("int"), F.trim(F.coalesce("z.a", F.lit("")))
    at = lambda *order: F.struct("page", *order).alias("at")
    from_tables = z.select(key, number.alias("number"), F.when(a.rlike("^[ABCD]$"), a).when(free(a), "送分").alias("answer"), F.lit(0).alias("kind"), at(F.col("table").cast("long").alias("i"), F.col("at").alias("j")))
    pairs = texts.select(key, "page", F.posexplode(F.regexp_extract_all("text", F.lit(r"第\d{1,3}題\s+[A-D]\b"), F.lit(0))).alias("j", "p"))
    from_pairs = pairs.select(key, F.regexp_extract("p", r"(\d+)", 1).cast("int").alias("number"), F.right("p", F.lit(1)).alias("answer"), F.lit(1).alias("kind"), at(F.lit(-1).cast("long").alias("i"), (-F.col("j")).alias("j"))).where("number between 1 and 100")
    marks = texts.select(key, "page", F.posexplode(F.regexp_extract_all("text", F.lit(r"第\s*(\d+)\s*題.*?(?:送分|一律給分)"), F.lit(1))).alias("j", "p"))
    from_marks = marks.select(key, F.col("p").cast("int").alias("number"), F.lit("送分").alias("answer"), F.lit(2).alias("kind"), at(F.lit(-2).cast("long").alias("i"), (-F.col("j")).alias("j")))
    found = from_tables.unionByName(from_pairs).unionByName(from_marks).where("number is not null and answer is not null")
    return found.groupBy(key, "number").agg(F.max_by("answer", F.struct((F.col("kind") == 0).alias("k"), F.when(F.col("kind") == 0, F.col("at.page")).otherwise(-F.col("at.page")).alias("p"), "at.i", "at.j")).alias("answer"))


def assigned_figures(questions: DataFrame, images: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """GEN-12: (key, pos, source, at) for each question that refers to a figure.

    With at least as many embedded images (key, image) as such questions, the n-th question takes the
    n-th image; else a page (counted from 0): an essay the page of its number, a choice question the
    first page (key, page, text) that holds its number and a figure, else the page of its place; no
    page behind the last one.
    """
    w = Window.partitionBy(key).orderBy("pos")
    refer = questions.where(F.col("stem").rlike(FIGURE)).withColumn("place", F.row_number().over(w))
    n = refer.groupBy(key).agg(F.count("*").alias("asked"))
    have = images.groupBy(key).agg(F.array_sort(F.collect_list("image")).alias("images"))
    last = pages.groupBy(key).agg((F.max("page")).alias("last"))
    hits = refer.where("type <> 'essay'").select(key, "pos", "number").join(pages.where(F.col("text").rlike("圖")), key).where(F.contains("text", F.col("number")))
    first = hits.groupBy(key, "pos").agg(F.min("page").alias("hit"))
    rows = refer.join(n, key).join(have, key, "left").join(last, key, "left").join(first, [key, "pos"], "left")
    enough = F.coalesce(F.size("images"), F.lit(0)) >= F.col("asked")
    value = F.coalesce(tx.numeral_value("number"), F.col("number").try_cast("int"), F.col("place"))
    by_page = F.when(F.col("type") == "essay", F.least(value, "last")).otherwise(F.coalesce("hit", F.least("place", "last")))
    return rows.select(key, "pos", F.when(enough, "image").otherwise("page").alias("source"), F.when(enough, F.get("images", F.col("place") - 1).cast("long")).otherwise(by_page.cast("long")).alias("at"))
