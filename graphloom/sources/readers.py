"""Sources: tables, catalogues, bundles, and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import attack_id, control_id, first_paragraph, parent_id
from ..schema import EDGES, NODES


def nodes(spark: SparkSession, root: str, label: str) -> DataFrame:
    return spark.read.schema(NODES[label]).parquet(f"{root}/nodes/{label}")


def edges(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.schema(EDGES[kind]).parquet(f"{root}/edges/{kind}")


def by_id(df: DataFrame, key) -> DataFrame:
    return df.where(F.col("id") == F.lit(key))


def by_prefix(df: DataFrame, prefix: str, levels: tuple[str, ...] = ()) -> DataFrame:
    df = df.where(F.col("id").startswith(prefix) & F.col("embedding").isNotNull())
    return df.where(F.col("level").isin(*levels)) if levels else df


def yaml_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(framework nodes, CONTAINS edges) of YAML catalogues; the files are read by Spark, each parsed whole on an executor."""

    def parse(batches):
        import pyarrow as pa
        import yaml

        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                doc = yaml.safe_load(text) or {}
                rows.append({"id": doc.get("framework_id"), "title": doc.get("framework_name"), "version": str(doc.get("framework_version") or ""), "body": None, "parent": None})
                for x in doc.get("frameworks") or []:
                    rows.append({"id": str(x["id"]), "title": x.get("name"), "version": str(doc.get("framework_version") or ""), "body": x.get("description"), "parent": x.get("parent_id") or doc.get("framework_id")})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in ("id", "title", "version", "body", "parent")]))

    rows = spark.read.text(path, wholetext=True).mapInArrow(parse, "id string, title string, version string, body string, parent string")
    return rows.drop("parent"), rows.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))


def yaml_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Flat YAML lists of mappings as rows of a schema; missing fields are null."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def parse(batches):
        import json

        import pyarrow as pa
        import yaml

        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                doc = yaml.safe_load(text) or []
                if isinstance(doc, dict):
                    doc = next((v for v in doc.values() if isinstance(v, list)), [])
                rows += [json.dumps({n: x.get(n) for n in names}, default=str) for x in doc]
            yield pa.RecordBatch.from_pydict({"j": pa.array(rows, pa.string())})

    return spark.read.text(path, wholetext=True).mapInArrow(parse, "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


STIX = "type STRING, id STRING, name STRING, description STRING, revoked BOOLEAN, x_mitre_deprecated BOOLEAN, x_mitre_is_subtechnique BOOLEAN, x_mitre_shortname STRING, relationship_type STRING, source_ref STRING, target_ref STRING, external_references ARRAY<STRUCT<source_name: STRING, external_id: STRING>>, kill_chain_phases ARRAY<STRUCT<kill_chain_name: STRING, phase_name: STRING>>"


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of STIX bundles that are neither revoked nor deprecated, with their ATT&CK id in external_id."""
    b = spark.read.schema(f"objects ARRAY<STRUCT<{', '.join(x.strip().replace(' ', ': ', 1) for x in _split(STIX))}>>").json(path, multiLine=True)
    o = b.select(F.explode("objects").alias("o")).select("o.*")
    o = o.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    ref = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    return o.withColumn("external_id", F.try_element_at(ref, F.lit(1))["external_id"])


def _split(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word]


def attack_frameworks(objects: DataFrame, cap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(nodes, CONTAINS edges): tactics, techniques under their tactics, sub-techniques under their techniques."""
    o = objects.where(F.col("external_id").isNotNull())
    body = first_paragraph(F.coalesce("description", F.lit("")), cap)
    tactic = o.where("type = 'x-mitre-tactic'").select(attack_id("external_id").alias("id"), F.col("name").alias("title"), body.alias("body"), F.lit("tactic").alias("level"), "x_mitre_shortname")
    sub = F.coalesce("x_mitre_is_subtechnique", F.lit(False))
    pattern = o.where("type = 'attack-pattern'").select(attack_id("external_id").alias("id"), F.col("name").alias("title"), body.alias("body"), F.when(sub, "sub-technique").otherwise("technique").alias("level"), "kill_chain_phases")
    under = pattern.where("level = 'technique'").select("id", F.explode("kill_chain_phases").alias("p")).select(F.col("id").alias("dst"), F.col("p.phase_name").alias("x_mitre_shortname"))
    edges_ = under.join(tactic.select(F.col("id").alias("src"), "x_mitre_shortname"), "x_mitre_shortname").select("src", "dst")
    edges_ = edges_.unionByName(pattern.where("level = 'sub-technique'").select(parent_id("id").alias("src"), F.col("id").alias("dst"))).distinct()
    return tactic.drop("x_mitre_shortname").unionByName(pattern.drop("kill_chain_phases")), edges_


def mitigations(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mitigation nodes, MITIGATES edges) by resolving relationships at both ends; unknown ends are dropped."""
    o = objects.where(F.col("external_id").isNotNull())
    m = o.where("type = 'course-of-action'").select("id", "external_id", "name", "description")
    t = o.where("type = 'attack-pattern'").select(F.col("id").alias("target_ref"), attack_id("external_id").alias("dst"))
    rel = objects.where("type = 'relationship' AND relationship_type = 'mitigates'").select("source_ref", "target_ref")
    e = rel.join(m.select(F.col("id").alias("source_ref"), attack_id("external_id").alias("src")), "source_ref").join(t, "target_ref").select("src", "dst").distinct()
    return m.select(attack_id("external_id").alias("id"), F.col("name").alias("title"), F.col("description").alias("body")), e


OSCAL = "catalog STRUCT<groups: ARRAY<STRUCT<id: STRING, title: STRING, controls: ARRAY<STRUCT<id: STRING, title: STRING, parts: ARRAY<STRUCT<name: STRING, prose: STRING, parts: ARRAY<STRUCT<name: STRING, prose: STRING>>>>>>>>>"


def oscal_controls(spark: SparkSession, path: str, cap: int = 2000) -> DataFrame:
    """id, title, group, body of base controls: the prose of the first statement that has any, with that of its parts, joined and cut.  Controls without an id or a title go."""
    g = spark.read.schema(OSCAL).json(path, multiLine=True).select(F.explode("catalog.groups").alias("g"))
    ctl = g.select(F.col("g.id").alias("group"), F.explode("g.controls").alias("c"))
    stmt = F.filter("c.parts", lambda p: p["name"] == "statement")
    texts = F.transform(stmt, lambda p: F.array_join(F.filter(F.concat(F.array(p["prose"]), F.coalesce(F.transform(p["parts"], lambda q: q["prose"]), F.array().cast("array<string>"))), lambda t: F.coalesce(t, F.lit("")) != ""), " "))
    ctl = ctl.where((F.coalesce("c.id", F.lit("")) != "") & (F.coalesce("c.title", F.lit("")) != ""))
    return ctl.select(control_id("c.id").alias("id"), F.col("c.title").alias("title"), "group", F.substring(F.coalesce(F.get(F.filter(texts, lambda t: t != ""), 0), F.lit("")), 1, cap).alias("body"))


def csf_elements(spark: SparkSession, path: str, root: str) -> DataFrame:
    """id, type, text, parent of exported elements; the projection gives parents, the root is the fallback."""
    schema = "response STRUCT<elements: STRUCT<elements: ARRAY<STRUCT<element_identifier: STRING, element_type: STRING, title: STRING, text: STRING>>, relationships: ARRAY<STRUCT<source_element_identifier: STRING, dest_element_identifier: STRING, relationship_identifier: STRING>>>>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    el = d.select(F.explode("response.elements.elements").alias("e")).select("e.*")
    up = d.select(F.explode("response.elements.relationships").alias("r")).where("r.relationship_identifier = 'projection'").select(F.col("r.dest_element_identifier").alias("element_identifier"), F.col("r.source_element_identifier").alias("parent")).dropDuplicates(["element_identifier"])
    kinds = {"function": 1, "category": 2, "subcategory": 3}
    order = F.coalesce(*[F.when(F.col("element_type") == k, v) for k, v in kinds.items()], F.lit(9))
    return el.join(up, "element_identifier", "left").select(F.col("element_identifier").alias("id"), F.col("element_type").alias("type"), "title", "text", F.coalesce("parent", F.lit(root)).alias("parent"), order.alias("place"))


def sheet(spark: SparkSession, path: str, fill: list[str], order: str = "row") -> DataFrame:
    """A sheet saved as CSV, with the named columns filled downwards.  The rows of one sheet are one ordered run."""
    df = spark.read.csv(path, header=True).withColumn(order, F.monotonically_increasing_id()).withColumn("_file", F.input_file_name())
    w = W.partitionBy("_file").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in fill}).drop("_file")


def words_to_lines(words: DataFrame, tolerance: float = 3.0, *keys: str) -> DataFrame:
    """Lines of words (text, x0, top, bottom): words whose middles round to one step share a line, ordered by x0."""
    y = F.round(((F.col("top") + F.col("bottom")) / 2) / tolerance) * tolerance
    g = words.groupBy(*keys, y.alias("y")).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return g.select(*keys, "y", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("body"))


def hook_events(lines: DataFrame) -> DataFrame:
    """tool, command, output of JSON event lines; works on a stream as well."""
    schema = "tool_name STRING, tool_input STRUCT<command: STRING, file_path: STRING>, tool_response STRUCT<stdout: STRING, output: STRING>"
    e = lines.select(F.from_json("value", schema).alias("e"))
    return e.select(F.col("e.tool_name").alias("tool"), F.col("e.tool_input.command").alias("command"), F.coalesce("e.tool_response.stdout", "e.tool_response.output").alias("output")).where("command is not null")
