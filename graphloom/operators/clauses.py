"""Clauses and normative statements of standards, from the words of their pages.

Lines come in reading order (`at`, any sortable column) and the work is windows over a document's lines, which stream through sorted
partitions: state that a reader would carry from line to line (the clause, the note, the block, the item) is a running
count or the last marker seen.  Only an output row (a clause's text, an item's text, a heading) ever gathers its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.readers import words_to_lines
from .records import page_words

# Fixed values.
CLAUSE_HEADING = r"^(\d+(?:\.\d+)*)\s{1,3}([A-Z][^\n]{2,})$"
CONTROL_HEADING = r"^(\d+\.\d+)\s+(.+)$"
CONTROL_MAJORS = ("5", "6", "7", "8")
CONTROL_MARK = r"^Control\s*$"
GROUP_HEADING = r"^\d+\s+[A-Z][a-z]+ controls\s*$"
ITEM = r"^([a-z]\)|\d+\)|—|[-•·])\s+(.*)$"
NOTE = r"^NOTE\s*\d*\s"
RUNNING_HEADS = ("ISO/IEC 27001:2022(E)", "INTERNATIONAL STANDARD ISO/IEC 27001:2022(E)")
SKIPPED = (
    r"^(TTaabbllee|Table A\.1|©|ICS \d|Price based|Bibliography|Contents|Foreword|Reference number|COPYRIGHT|All rights reserved|"
    r"ISO copyright|CP 401|CH-\d|Phone:|Email:|Website:|Published in|\.{4,})"
)
SUBLIST_ENDINGS = (":", "include", " to", " by", " for", "how to")
BODY_COLUMN = 180.0
SCHEME = "iso-27001-2022"


def clean_line(text) -> Column:
    """A line without the licence watermark (tokens with a backtick or a comma between letters), soft hyphens, split capitals, [1] references and a page number at its end."""
    t = F.col(text) if isinstance(text, str) else text

    def unmarked(token: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(token, r"""[^a-zA-Z0-9()'"  ;:.!?/-]""", ""), "-{2,}", "")
        return F.when(token.rlike("`|[a-zA-Z],[a-zA-Z]"), F.regexp_replace(plain, "(?<=[a-zA-Z])-(?=[a-zA-Z])", "")).otherwise(token)

    line = F.array_join(F.filter(F.transform(F.split(t, r"(?U)\s+"), unmarked), lambda x: x != ""), " ")
    for pattern, by in ((r"-\s+", ""), (r"(?<=[A-Z])\s(?=[a-z]{2,})", ""), (r"\[\d+\]", ""), (r"\s+\d{1,2}$", ""), (r" {2,}", " ")):
        line = F.regexp_replace(line, pattern, by)
    return F.trim(line)


def is_skipped(line, skipped: str = SKIPPED, heads: tuple[str, ...] = RUNNING_HEADS) -> Column:
    """Whether a cleaned line belongs to no clause: empty, a page number, a running head (`heads`), a table head or an imprint (`skipped`, a pattern)."""
    c = F.col(line) if isinstance(line, str) else line
    return (c == "") | c.rlike(r"^\d{1,2}$") | c.isin(*heads) | c.rlike(skipped)


def read_lines(words: DataFrame, doc: str = "doc_id", page: str = "page", at: str = "at", tolerance: float = 3.0, columns: tuple[float, ...] = (), skipped: str = SKIPPED, heads: tuple[str, ...] = RUNNING_HEADS) -> DataFrame:
    """doc, at, line, and with `columns` (x positions where columns begin) column: the cleaned lines of pages in reading order.

    Watermark words go (page_words), words share lines (words_to_lines), skipped lines go (is_skipped).  `page` numbers are distinct over all
    documents and ascend within one.  Null words and positions are no lines.
    """
    kept = page_words(words.dropna(subset=["text", "x0", "top", "bottom"]), page, at)
    keys = [doc, page]
    if columns:
        column = F.lit(0)
        for x in columns:
            column = column + (F.col("x0") >= x).cast("int")
        kept, keys = kept.withColumn("column", column), [*keys, "column"]
    lines = words_to_lines(kept, tolerance, *keys).withColumn("line", clean_line("line"))
    place = [F.col(page).alias("page"), "y", "column"] if columns else [F.col(page).alias("page"), "y"]
    return lines.where(~is_skipped("line", skipped, heads)).select(doc, F.struct(*place).alias("at"), "line", *(["column"] if columns else []))


def clause_lines(lines: DataFrame, doc: str = "doc_id", at: str = "at", line: str = "line", scheme: str = SCHEME) -> DataFrame:
    """doc, clause (running number), id, heading, control_id, at, line: every line after a clause's heading, whatever pages it stands on; the heading's own row has a null line."""
    w = W.partitionBy(doc).orderBy(at)
    head = F.col(line).rlike(CLAUSE_HEADING)
    of = lambda n: F.when(head, F.regexp_extract(line, CLAUSE_HEADING, n))
    rows = lines.where(F.col(line).isNotNull()).select(
        doc, F.col(at).alias("at"), F.sum(head.cast("int")).over(w).alias("clause"), F.last(of(1), True).over(w).alias("id"),
        F.last(clean_line(of(2)), True).over(w).alias("heading"), F.when(~head, F.trim(line)).alias("line"),
    )
    return rows.where("clause > 0 AND (line IS NULL OR line <> '')").withColumn("control_id", F.concat(F.lit(f"{scheme}."), "id")).select(doc, "clause", "id", "heading", "control_id", "at", "line")


def annex_lines(lines: DataFrame, doc: str = "doc_id", at: str = "at", line: str = "line", column: str = "column", scheme: str = SCHEME) -> DataFrame:
    """The same for the two columns of an annex: the left one holds a control's number and its heading, which may go on below; the right one its text.

    A heading goes on over left lines that begin with a small letter or follow a hyphen, until another left line or text comes.
    """
    w = W.partitionBy(doc).orderBy(at, column)
    kept = lines.where(F.col(line).isNotNull() & ~F.col(line).rlike(CONTROL_MARK) & ~((F.col(column) == 0) & F.col(line).rlike(GROUP_HEADING)))
    head = (F.col(column) == 0) & F.col(line).rlike(CONTROL_HEADING) & F.substring_index(F.regexp_extract(line, CONTROL_HEADING, 1), ".", 1).isin(*CONTROL_MAJORS)
    rows = kept.select(doc, F.col(at).alias("at"), column, F.col(line).alias("line"), head.alias("head"), F.sum(head.cast("int")).over(w).alias("clause"))
    own = W.partitionBy(doc, "clause").orderBy("at", column)
    text = F.when(F.col("head"), F.regexp_extract("line", CONTROL_HEADING, 2)).otherwise(F.col("line"))
    first = F.substring("line", 1, 1)
    more = (F.col(column) == 0) & ((first == F.lower(first)) & (first != F.upper(first)) | F.lag("line").over(own).endswith("-"))
    rows = rows.where("clause > 0").withColumns({"text": text, "more": F.col("head") | more})
    rows = rows.withColumn("titled", F.min(F.col("more").cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0)) == 1)
    heads = rows.where("titled").groupBy(doc, "clause").agg(
        F.max(F.when(F.col("head"), F.regexp_extract("line", CONTROL_HEADING, 1))).alias("number"),
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"),
    )
    heading = clean_line(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), " "), "-+$", ""))
    heads = heads.select(doc, "clause", F.concat(F.lit("A."), "number").alias("id"), heading.alias("heading"), F.concat(F.lit(f"{scheme}.a."), "number").alias("control_id"), "at", F.lit(None).cast("string").alias("line"))
    body = rows.where(F.col(column) > 0).select(doc, "clause", "at", "line").join(heads.drop("at", "line"), [doc, "clause"])
    return heads.unionByName(body.select(*heads.columns))


def clauses(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, clause, id, heading, control_id, text of clause_lines or annex_lines: items and notes on lines of their own, other lines joined by blanks."""
    own_line = F.col("line").rlike(ITEM) | F.col("line").rlike(NOTE)
    part = F.when(F.col("line").isNotNull(), F.struct("at", F.concat(F.when(own_line, "\n").otherwise(" "), "line").alias("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["line"]), "")
    rows = lines.groupBy(doc, "clause", "id", "heading", "control_id").agg(text.alias("text"))
    return rows.withColumn("text", F.expr("substring(text, 2)"))


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def _first(text: Column, change) -> Column:
    return F.concat(change(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def fused(preamble, item) -> Column:
    """One sentence of a preamble and an item: behind a colon the item goes on in small letters, behind a full sentence or nothing it begins with a capital; "; and" and the like at its end go."""
    p, t = (F.col(x) if isinstance(x, str) else x for x in (preamble, item))
    p = _without(p, r"\s+$")
    body = _without(t, r"(?i)[;,]\s*and\s*$", r"(?i)[;,]\s*or\s*$", ";+$", ",+$", r"\s+$", ":+$", r"\s+$")
    stem = _without(F.regexp_replace(p, ":$", ""), r"\s+$")
    joined = F.when(p == "", _first(body, F.upper)).when(p.endswith(":"), F.concat(stem, F.lit(" "), _first(body, F.lower))).otherwise(F.concat(p, F.lit(" "), _first(body, F.upper)))
    return F.concat(_without(joined, r"\.+$"), F.lit("."))


def statements(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, clause, place, id, parent, label, body: the statements of clause_lines or annex_lines, in their order (place).

    A clause is blocks of a preamble and a list; prose with a capital after an item begins the next block, other prose goes on with the item, and
    notes end at the next item.  Each item and its preamble make one sentence.  An item that ends like the beginning of a list takes the
    numbers and dashes that follow as children, who continue its sentence.  Ids: .a, .1, .stmt-n for dashes; where a
    clause has several blocks each is a statement (.block-n) over its items.  A clause without items has none.
    """
    c = [doc, "clause"]
    w = W.partitionBy(*c).orderBy("at")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    item, note = F.col("line").rlike(ITEM), F.col("line").rlike(NOTE)
    mark = F.when(note, "note").when(item, "item")
    rows = lines.where(F.col("line").isNotNull()).select(*c, "control_id", "at", "line", item.alias("item"), F.last(mark, True).over(w).alias("mark"))
    rows = rows.where("mark IS NULL OR mark <> 'note'")
    first = F.substring("line", 1, 1)
    capital = ~F.col("item") & (first == F.upper(first)) & (first != F.lower(first))
    rows = rows.withColumn("turn", F.when(F.col("item"), "item").when(capital, "capital"))
    begins = F.when((F.col("turn") == "capital") & (F.last("turn", True).over(before) == "item"), 1).otherwise(0)
    rows = rows.withColumn("block", F.sum(begins).over(w)).withColumn("no", F.sum(F.col("item").cast("int")).over(W.partitionBy(*c, "block").orderBy("at")))
    label, rest = F.regexp_extract("line", ITEM, 1), F.trim(F.regexp_extract("line", ITEM, 2))
    # The lines of a preamble (item 0) or of an item, joined.
    parts = rows.groupBy(*c, "control_id", "block", "no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("item"), rest).otherwise(F.col("line")).alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.max(F.when(F.col("item"), label)).alias("label"),
    )
    b = W.partitionBy(*c, "block")
    parts = parts.withColumn("preamble", F.coalesce(F.max(F.when(F.col("no") == 0, F.col("text"))).over(b), F.lit("")))
    # Blocks without items are none; only the last can be so.
    parts = parts.withColumn("items", F.max("no").over(b)).where("items > 0").withColumn("blocks", F.max("block").over(W.partitionBy(*c)) + 1)
    kind = F.when(F.col("label").rlike(r"^[a-z]\)"), "letter").when(F.col("label").rlike(r"^\d"), "number").otherwise("dash")
    opens = _without(F.col("text"), r"\s+$")
    opens = F.exists(F.array(*[F.lit(e) for e in SUBLIST_ENDINGS]), lambda e: opens.endswith(e))
    items = parts.where("no > 0").withColumns({"kind": kind, "opens": opens})
    o = b.orderBy("no")
    items = items.withColumn("run", F.sum((F.col("kind") == "letter").cast("int")).over(o))
    run = W.partitionBy(*c, "block", "run").orderBy("no")
    items = items.withColumn("over", F.min(F.when(F.col("opens"), F.col("no"))).over(run.rowsBetween(W.unboundedPreceding, -1)))
    level = W.partitionBy(*c, "block", F.when(F.col("over").isNotNull(), F.struct("run", "over"))).orderBy("no")
    dashes = F.sum((F.col("kind") == "dash").cast("int")).over(level)
    slug = F.when(F.col("kind") == "dash", F.concat(F.lit("stmt-"), dashes.cast("string"))).otherwise(F.expr("substring(label, 1, length(label) - 1)"))
    block = F.concat("control_id", F.lit(".block-"), (F.col("block") + 1).cast("string"))
    base = F.when(F.col("blocks") > 1, block).otherwise(F.col("control_id"))
    items = items.withColumns({"slug": slug, "base": base})
    # An item's own sentence and id, handed on to those that it is over.
    sentence = F.when(F.col("over").isNull(), fused("preamble", "text"))
    items = items.withColumn("sentence", sentence).withColumns({
        "over_sentence": F.last("sentence", True).over(run), "over_id": F.concat("base", F.lit("."), F.last(F.when(F.col("over").isNull(), F.col("slug")), True).over(run)),
    })
    child = F.col("over").isNotNull()
    stem = F.concat(_without(F.col("over_sentence"), r"\.+$"), F.lit(":"))
    found = items.select(
        *c, F.struct("block", "no").alias("place"), F.concat(F.when(child, F.col("over_id")).otherwise(F.col("base")), F.lit("."), "slug").alias("id"),
        F.when(child, F.col("over_id")).when(F.col("blocks") > 1, F.col("base")).alias("parent"), "label", F.when(child, fused(stem, F.col("text"))).otherwise(F.col("sentence")).alias("body"),
    )
    title = _first(F.concat(_without(F.col("preamble"), r"\s+$", ":+$", r"\s+$"), F.lit(".")), F.upper)
    heads = items.where("no = 1 AND blocks > 1").select(
        *c, F.struct("block", F.lit(0).cast("long").alias("no")).alias("place"), block.alias("id"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("block-"), (F.col("block") + 1).cast("string")).alias("label"), title.alias("body")
    )
    return found.unionByName(heads)
