"""Table functions over ordered partitions: chunks and clauses of documents that come line by line.

Each takes a table argument with PARTITION BY and ORDER BY, so that Spark sorts a document's lines and streams them through; a function
holds the part that is open and no more.  They give the rows of markdown_chunks, sliding_chunks and clauses without a
document or its lines ever being one value.  register() names them for SQL:

    SELECT * FROM markdown_chunks(TABLE(lines) PARTITION BY doc_id ORDER BY at)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import params as P

#: What ends a line.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


class MarkdownChunks:
    """doc_id, sequence, heading, body of rows (doc_id, at, line): a document cut at its ## and ### headings; null lines are empty ones."""

    def __init__(self):
        self.doc, self.heading, self.lines, self.sequence = None, "", [], 0

    def eval(self, row: Row):
        self.doc = row["doc_id"]
        line = row["line"] or ""
        if line.startswith(("## ", "### ")):
            yield from self.chunk()
            self.heading, self.lines = line.lstrip("# ").strip(), []
        else:
            self.lines.append(line)

    def chunk(self):
        body = "\n".join(self.lines).strip()
        text = f"{self.heading}\n{body}".strip() if self.heading else body
        if len(text) >= P.CHUNK_MIN:
            yield self.doc, self.sequence, self.heading or None, text
            self.sequence += 1

    def terminate(self):
        yield from self.chunk()


class SlidingChunks:
    """doc_id, sequence, body of rows (doc_id, at, line): windows of CHUNK_SIZE characters, each CHUNK_SIZE - CHUNK_OVERLAP after the last, over the lines with a line end after each; short ones go."""

    def __init__(self):
        self.doc, self.held, self.sequence = None, "", 0

    def eval(self, row: Row):
        self.doc = row["doc_id"]
        self.held += (row["line"] or "") + "\n"
        while len(self.held) >= P.CHUNK_SIZE:
            yield from self.window()

    def window(self):
        text = self.held[: P.CHUNK_SIZE].strip()
        if len(text) >= P.CHUNK_MIN:
            yield self.doc, self.sequence, text
            self.sequence += 1
        self.held = self.held[P.CHUNK_SIZE - P.CHUNK_OVERLAP :]

    def terminate(self):
        while self.held:
            yield from self.window()


class ClauseTexts:
    """doc_id, clause, id, heading, text of cleaned lines (doc_id, at, line) of standards; lines before the first heading go."""

    def __init__(self):
        from ..operators import clauses as L

        self.head, self.own_line = re.compile(L.CLAUSE_HEADING).match, re.compile(f"{L.ITEM}|{L.NOTE}").match
        self.doc, self.clause, self.open, self.text = None, 0, None, ""

    def eval(self, row: Row):
        line = (row["line"] or "").strip()
        found = self.head(line)
        if found:
            yield from self.terminate()
            self.doc, self.clause, self.open, self.text = row["doc_id"], self.clause + 1, found.groups(), ""
        elif self.open and line:
            self.text += f"{'' if not self.text else chr(10) if self.own_line(line) else ' '}{line}"

    def terminate(self):
        if self.open:
            yield self.doc, self.clause, *self.open, self.text


SHAPES = {
    "markdown_chunks": (MarkdownChunks, "doc_id {id}, sequence int, heading string, body string"),
    "sliding_chunks": (SlidingChunks, "doc_id {id}, sequence int, body string"),
    "clause_texts": (ClauseTexts, "doc_id {id}, clause int, id string, heading string, text string"),
}


def table_function(name: str, doc_id: str = "string"):
    """A table function for documents whose ids are of the given type."""
    f, shape = SHAPES[name]
    return F.udtf(f, returnType=shape.format(id=doc_id))


def register(spark: SparkSession, doc_id: str = "string") -> None:
    for name in SHAPES:
        spark.udtf.register(name, table_function(name, doc_id))


def by_document(name: str, lines: DataFrame) -> DataFrame:
    """The function's rows for lines (doc_id, at, line), one document a partition, in the order of at."""
    rows = lines.select("doc_id", "at", "line")
    return table_function(name, dict(lines.dtypes)["doc_id"])(rows.asTable().partitionBy("doc_id").orderBy("at"))


def text_lines(docs: DataFrame, body: str = "body", key: str = "doc_id") -> DataFrame:
    """doc_id, at, line of whole texts."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(body, LINE_END)).alias("at", "line"))
