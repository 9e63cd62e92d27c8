"""Clauses and statements on literal pages."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clauses as L


def words(spark, pages, left=60.0):
    """Pages of lines (text, or (left column, right column)) as words with places."""
    rows = []
    for page, lines in enumerate(pages):
        for i, line in enumerate(lines):
            for x, part in zip((left, 200.0), line if isinstance(line, tuple) else (line,)):
                rows += [("d", page, i, x + 5 * j, 20.0 * i, 20.0 * i + 10, w) for j, w in enumerate(part.split())]
        rows.append(("d", page, 0, 12.0, 0.0, 10.0, "watermark"))
    return spark.createDataFrame(rows, "doc_id string, page long, at int, x0 double, top double, bottom double, text string")


def in_order(df):
    return [(r["id"], r["parent"], r["label"], r["body"]) for r in sorted(df.collect(), key=lambda r: (r["clause"], r["place"]["block"], r["place"]["no"]))]


@pytest.mark.parametrize("raw,clean", [
    ("the or`ganiza,tion shall", "the organization shall"), ("infor- mation secu-rity", "information secu-rity"), ("T he scope [12] of it 17", "The scope of it"),
    ("a,b`-c--d é", "abcd é"), ("  two   blanks\there ", "two blanks here"), ("", ""), ("`,,`", ""), ("A B cd", "A Bcd"),
])
def test_clean_line(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(L.clean_line("t")).first()[0] == clean


@pytest.mark.parametrize("preamble,item,sentence", [
    ("The organization shall:", "Plan; and", "The organization shall plan."), ("The organization shall: ", "plan, or", "The organization shall plan."), ("It is done.", "evidence kept;", "It is done. Evidence kept."),
    ("", "plan:", "Plan."), ("", "", "."), ("The top:", "", "The top ."), ("No colon", "x...", "No colon X."), ("", "and", "And."),
])
def test_fused(spark, preamble, item, sentence):
    assert spark.createDataFrame([(preamble, item)], "p string, t string").select(L.fused("p", "t")).first()[0] == sentence


def test_clause_over_two_pages_comes_once(spark):
    pages = [
        ["ISO/IEC 27001:2022(E)", "Before the first clause", "4 Context of it", "The organization shall determine", "a) issues; and", "1"],
        ["INTERNATIONAL STANDARD ISO/IEC 27001:2022(E)", "b) the results", "that matter.", "NOTE 1 Not normative", "nor this", "4.1 Next clause 12", "Prose only."],
    ]
    lines = L.clause_lines(L.read_lines(words(spark, pages)))
    got = sorted((r["clause"], r["id"], r["heading"], r["control_id"], r["text"]) for r in L.clauses(lines).collect())
    assert got == [
        (1, "4", "Context of it", "iso-27001-2022.4", "The organization shall determine\na) issues; and\nb) the results that matter.\nNOTE 1 Not normative nor this"),
        (2, "4.1", "Next clause", "iso-27001-2022.4.1", "Prose only."),
    ]
    assert in_order(L.statements(lines)) == [
        ("iso-27001-2022.4.a", None, "a)", "The organization shall determine Issues."),
        ("iso-27001-2022.4.b", None, "b)", "The organization shall determine The results that matter."),
    ]


def statements(spark, *lines):
    rows = [("d", i, x) for i, x in enumerate(["6.1 Some clause", *lines])]
    return in_order(L.statements(L.clause_lines(spark.createDataFrame(rows, "doc_id string, at int, line string"))))


def test_nested_lists(spark):
    i = "iso-27001-2022.6.1"
    assert statements(spark, "It shall:", "a) define rules that include:", "1) one; and", "2) two;", "— dash", "b) plan how to", "— first;", "second line", "c) end", "— alone", "3) more by", "4) under three") == [
        (f"{i}.a", None, "a)", "It shall define rules that include."),
        (f"{i}.a.1", f"{i}.a", "1)", "It shall define rules that include one."),
        (f"{i}.a.2", f"{i}.a", "2)", "It shall define rules that include two."),
        (f"{i}.a.stmt-1", f"{i}.a", "—", "It shall define rules that include dash."),
        (f"{i}.b", None, "b)", "It shall plan how to."),
        (f"{i}.b.stmt-1", f"{i}.b", "—", "It shall plan how to first; second line."),
        (f"{i}.c", None, "c)", "It shall end."),
        (f"{i}.stmt-1", None, "—", "It shall alone."),
        (f"{i}.3", None, "3)", "It shall more by."),
        (f"{i}.3.4", f"{i}.3", "4)", "It shall more by under three."),
    ]


def test_several_blocks(spark):
    i = "iso-27001-2022.6.1"
    got = statements(spark, "when planning, to:", "a) assure;", "b) prevent.", "The organization shall plan:", "d) actions; and", "e) how to", "1) act;", "2) evaluate.", "NOTE 2 About plans", "Not A Block", "— bullet", "Closing prose.")
    assert got == [
        (f"{i}.block-1", None, "block-1", "When planning, to."),
        (f"{i}.block-1.a", f"{i}.block-1", "a)", "when planning, to assure."),
        (f"{i}.block-1.b", f"{i}.block-1", "b)", "when planning, to prevent."),
        (f"{i}.block-2", None, "block-2", "The organization shall plan."),
        (f"{i}.block-2.d", f"{i}.block-2", "d)", "The organization shall plan actions."),
        (f"{i}.block-2.e", f"{i}.block-2", "e)", "The organization shall plan how to."),
        (f"{i}.block-2.e.1", f"{i}.block-2.e", "1)", "The organization shall plan how to act."),
        (f"{i}.block-2.e.2", f"{i}.block-2.e", "2)", "The organization shall plan how to evaluate."),
        (f"{i}.block-2.e.stmt-1", f"{i}.block-2.e", "—", "The organization shall plan how to bullet."),
    ]


def test_no_items_no_statements(spark):
    assert statements(spark, "Prose.", "More prose.", "NOTE 1 x", "and y") == [] and statements(spark) == []
    assert statements(spark, "NOTE 1 first", "• item") == [("iso-27001-2022.6.1.stmt-1", None, "•", "Item.")]


def test_annex(spark):
    pages = [
        [("5 Organizational controls", ""), ("5.1 Policies for infor-", "Control"), ("mation security", ""), ("", "Policy shall be defined,"), ("ignored after text", "approved.")],
        [("", "It goes on:"), ("5.21 Managing security in", "Processes shall be"), ("the chain", "defined."), ("9.9 no control", ""), ("8.2 Rights", "Rights shall:"), ("", "a) be limited")],
    ]
    lines = L.annex_lines(L.read_lines(words(spark, pages), columns=(180.0,)))
    got = sorted((r["clause"], r["id"], r["heading"], r["control_id"], r["text"]) for r in L.clauses(lines).collect())
    assert got == [
        (1, "A.5.1", "Policies for information security", "iso-27001-2022.a.5.1", "Policy shall be defined, approved. It goes on:"),
        (2, "A.5.21", "Managing security in", "iso-27001-2022.a.5.21", "Processes shall be defined."),
        (3, "A.8.2", "Rights", "iso-27001-2022.a.8.2", "Rights shall:\na) be limited"),
    ]
    assert in_order(L.statements(lines)) == [("iso-27001-2022.a.8.2.a", None, "a)", "Rights shall be limited.")]


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], "doc_id string, at int, line string")
    lines = L.clause_lines(empty)
    assert L.clauses(lines).count() == 0 and L.statements(lines).count() == 0
    nulls = spark.createDataFrame([("d", 0, "1 Heading here"), ("d", 1, None), (None, 0, "2 Without document"), (None, 1, "a) item"), ("d", 2, " ")], "doc_id string, at int, line string").withColumn("item", F.lit(1))
    lines = L.clause_lines(nulls)
    assert sorted((r["heading"], r["text"]) for r in L.clauses(lines).collect()) == [("Heading here", ""), ("Without document", "a) item")]
    assert [r["body"] for r in L.statements(lines).collect()] == ["Item."]


def test_sentences_like_an_imprint_stay_in_the_queries(spark, tmp_path):
    """The standards of the queries are documents: lines that begin like an imprint are text there, as in the SQL, and are skipped by read_lines otherwise."""
    import duckdb

    from graphloom import catalog

    from .test_oracle import canonical

    words = [f"w{chr(97 + i % 26)}" for i in range(7 * 60)]
    words[24 * 7 : 24 * 7 + 3] = ["all", "rights", "reserved"]
    words[38 * 7], words[53 * 7] = "bibliography", "contents"
    spark.createDataFrame([(0, " ".join(words), "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("tx9_clauses", "tx10_statements"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).df()
        assert canonical(got) == canonical(want)
        assert name != "tx9_clauses" or any("All rights reserved" in t for t in got["text"])
    lines = spark.createDataFrame([("All rights reserved by us",), ("Table A.1 is",), ("12",), ("text",)], "line string")
    assert [r.line for r in lines.where(~L.is_skipped("line")).collect()] == ["text"]
