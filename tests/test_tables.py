"""Table functions give the rows of the plain operators."""

from pyspark.sql import functions as F

from graphloom.functions import tables as B
from graphloom.functions import text as T
from graphloom.operators import clauses as L
from graphloom.views import Graph

SF = "/root/testdata/sf0.001"
ODD = [
    ("a", "intro " * 20 + "\n## One\n" + "alpha " * 20 + "\r\n### Two ##\nshort\n## ##\n" + "beta " * 30 + "\n#### four\n##nothing"), ("b", ""), ("c", None), ("d", "## Only a heading that is long enough to be a chunk by itself\n\n"), (None, "text without id " * 9),
    ("e", "\n \n## A\n\x0c" + "x" * 60 + " ## B\n" + "y " * 40), ("f", "z" * 5000), ("g", ("word " * 13 + "\n") * 100),
]


def rows(df, *columns):
    return sorted(((tuple("" if r[c] is None else r[c] for c in columns)) for r in df.collect()), key=str)


def test_markdown(spark):
    docs = spark.createDataFrame(ODD, "doc_id string, body string")
    got = rows(B.by_document("markdown_chunks", B.text_lines(docs)), "doc_id", "sequence", "heading", "body")
    assert got == rows(T.markdown_chunks(docs), "doc_id", "sequence", "heading", "body")
    assert [r[1:3] for r in got if r[0] == "a"] == [(0, ""), (1, "One"), (2, "")]


def test_sliding(spark):
    docs = spark.createDataFrame(ODD, "doc_id string, body string")
    ended = docs.withColumn("body", F.concat(F.regexp_replace("body", B.LINE_END, "\n"), F.lit("\n")))
    got = rows(B.by_document("sliding_chunks", B.text_lines(docs)), "doc_id", "sequence", "body")
    assert got == rows(T.sliding_chunks(ended), "doc_id", "sequence", "body") and len(got) > 6


def test_clauses_and_sql(spark):
    lines = L.read_lines(Graph(spark, SF).standard_words)
    want = rows(L.clauses(L.clause_lines(lines)), "doc_id", "clause", "id", "text")
    assert rows(B.by_document("clause_texts", lines), "doc_id", "clause", "id", "text") == want
    B.register(spark, "long")
    lines.createOrReplaceTempView("standard_lines_of_a_test")
    sql = spark.sql("SELECT * FROM clause_texts(TABLE(standard_lines_of_a_test) PARTITION BY doc_id ORDER BY at)")
    assert rows(sql, "doc_id", "clause", "id", "text") == want
    assert B.by_document("clause_texts", lines.limit(0)).count() == 0
