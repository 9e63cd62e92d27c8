"""The property graph as views over the driver's tables, for Spark and, as SQL text, for DuckDB.

Both forms define the same rows: ids are table keys, properties are arithmetic on them.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
#: The moment that decay and recency queries run at.
NOW = "2024-03-01 00:00:00"


class Graph:
    """Views of one data folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp")

    @functools.cached_property
    def memory(self) -> DataFrame:
        e, d = self.table("embeddings"), self.table("documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("fact"), "lang", "source")
        m = e.join(d, "vec_id", "left")
        v = F.col("vec_id")
        importance = (1 + v % 5).cast("int")
        at = lambda h: F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + h * F.lit(3_600_000_000))
        return m.select(
            v.alias("id"), "fact", "embedding", F.col("label").alias("strand"), importance.alias("importance"), F.array("lang", "source").alias("tags"),
            F.element_at(F.array(*[F.lit(t) for t in ("fact", "decision", "insight", "todo", "event", "observation")]), (v % 6 + 1).cast("int")).alias("type"),
            F.when(v % 17 == 0, "archived").otherwise("active").alias("status"), (v % 23 == 0).alias("ephemeral"),
            F.when(v % 29 != 0, F.lit(0.4) * importance / 5).alias("strength"), (F.lit(0.3) * importance / 5).alias("min_strength"), F.lit(0.07).alias("decay_rate"),
            (v % 4).cast("int").alias("recall_count"), (v % 3).cast("int").alias("reinforcement_count"),
            at(v % 1400).alias("created_at"), at(v % 1400).alias("last_used_at"), at(v % 1400 + 5).alias("last_reinforced_at"),
            F.array(F.concat(F.lit("src/f"), (v % 13).cast("string"))).alias("files_modified"), F.array(F.concat(F.lit("src/f"), (v % 7).cast("string"))).alias("files_read"),
            (v % 7).alias("person"), (v % 4).alias("project"),
        )

    @functools.cached_property
    def related_to(self) -> DataFrame:
        """Three edges a memory, by arithmetic on ids; some have no rate or activation."""
        e = self.table("embeddings").select("vec_id")
        n = e.agg(F.count("*").alias("n"))
        k = e.crossJoin(F.broadcast(n)).select("vec_id", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
        i, k_ = F.col("vec_id"), F.col("k")
        out = k.select(
            i.alias("src"), ((i * (2 * k_ + 1) + 7 * k_) % F.col("n")).alias("dst"), F.when((i + k_) % 31 != 0, ((i * 3 + k_) % 20) / F.lit(20.0)).alias("weight"), ((i + k_) % 5).cast("int").alias("activation_count"),
            F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) - ((i + k_) % 120) * F.lit(86_400_000_000)).alias("last_activated_at"), F.when((i + k_) % 3 != 0, F.lit(0.005)).alias("decay_rate"),
        )
        return out.where("src <> dst")

    @functools.cached_property
    def about(self) -> DataFrame:
        """ABOUT edges of memories: each to a person, some also to an agent."""
        v = F.col("vec_id")
        e = self.table("embeddings")
        people = e.select(v.alias("src"), F.concat(F.lit("person-"), (v % 7).cast("string")).alias("dst"))
        return people.unionByName(e.where(v % 3 == 0).select(v.alias("src"), F.concat(F.lit("agent-"), (v % 2).cast("string")).alias("dst")))

    @functools.cached_property
    def leads_to(self) -> DataFrame:
        """Consecutive events of one user."""
        from pyspark.sql import Window as W

        w = W.partitionBy("user_id").orderBy("ts", "event_id")
        e = self.table("events").select("user_id", "event_id", "ts").withColumn("src", F.lag("event_id").over(w))
        return e.where("src is not null").select("src", F.col("event_id").alias("dst"), F.lit(0.5).alias("weight"))

    @functools.cached_property
    def contains(self) -> DataFrame:
        """region over nation over supplier and customer."""
        n, s, c = self.table("nation"), self.table("supplier"), self.table("customer")
        name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
        return (
            n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
            .unionByName(s.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))
            .unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
        )

    @functools.cached_property
    def supply(self) -> DataFrame:
        """region over nation over supplier: the part of the hierarchy that has no customers."""
        n, s = self.table("nation"), self.table("supplier")
        name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
        return n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(s.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))

    @functools.cached_property
    def control(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("framework_id"), F.col("p_size").alias("size"))

    @functools.cached_property
    def supports(self) -> DataFrame:
        """Chunks (lines) that support controls (parts)."""
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return self.table("lineitem").where("l_quantity > 45").select(key.alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("confidence"))

    @functools.cached_property
    def has_chunk(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dst"))

    @functools.cached_property
    def about_control(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "evidence").when(F.col("l_returnflag") == "R", "gap").otherwise("context")
        return self.table("lineitem").where("l_quantity < 4").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src"), F.col("l_partkey").alias("dst"), kind.alias("relationship_type"), (F.col("l_suppkey") % 5).alias("org_id"))

    @functools.cached_property
    def identifies(self) -> DataFrame:
        """Reports (suppliers) that identify threats (parts)."""
        sev = F.when(F.col("l_returnflag") == "A", "critical").when(F.col("l_returnflag") == "R", "high").otherwise("medium")
        li = self.table("lineitem").where("l_linenumber = 1").groupBy("l_suppkey", "l_partkey").agg(F.min(sev).alias("severity"))
        return li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "severity", F.when((F.col("l_suppkey") + F.col("l_partkey")) % 2 == 0, "stable").otherwise("increasing").alias("trend"))

    @functools.cached_property
    def threat_technique(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst")).unionByName(p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("src"), F.col("p_type").alias("dst")))

    @functools.cached_property
    def mitigates(self) -> DataFrame:
        p = self.table("part")
        return p.where("p_partkey % 40 = 1").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst")).distinct().unionByName(p.where("p_partkey % 90 = 1").select(F.col("p_partkey").alias("src"), F.col("p_type").alias("dst")))

    @functools.cached_property
    def task(self) -> DataFrame:
        o = self.table("orders")
        lv = lambda c, m: F.when(F.substring(c, 1, 1).isin(*m[0]), "H").when(F.substring(c, 1, 1).isin(*m[1]), "M").when(F.substring(c, 1, 1).isin(*m[2]), "L")
        status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("active")
        c = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project"))
        k = F.col("o_orderkey")
        return o.join(c, "o_custkey", "left").select(
            k.alias("id"), status.alias("status"), lv("o_orderpriority", ("1", "23", "4")).alias("value"), F.when(k % 3 == 0, "H").when(k % 3 == 1, "M").otherwise("L").alias("effort"),
            "project", F.to_date("o_orderdate").alias("due_on"), F.when(k % 13 != 0, k % 11 == 0).alias("is_template"), (k % 2 == 0).alias("committed"), (k % 6 == 0).alias("untouched"), F.col("o_totalprice").alias("price"),
        )

    @functools.cached_property
    def document(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.col("text").alias("body"), "lang", "source")

    @functools.cached_property
    def standard_lines(self) -> DataFrame:
        """Documents set as standards: their words, seven a line, under headings, list labels, notes and running heads by the line's number."""
        words = F.filter(F.transform(F.split(F.lower("text"), "[ \\n\\t]+"), lambda w: F.regexp_replace(w, "[^a-zà-ÿ]", "")), lambda w: w != "")
        d = self.table("documents").select("doc_id", F.explode(F.array(words)).alias("w")).where(F.size("w") > 0)
        rows = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("w") - 1) / 7))).alias("i"))
        t = rows.select("doc_id", "i", F.array_join(F.slice("w", (F.col("i") * 7 + 1).cast("int"), 7), " ").alias("t"))
        return t.select("doc_id", "i", F.expr(STANDARD_LINE).alias("line"))

    @functools.cached_property
    def standard_words(self) -> DataFrame:
        """The words of standard_lines on pages of 40 lines, with a licence mark left of every sixth line."""
        page = F.floor(F.col("i") / 40)
        tokens = F.concat(F.split("line", " "), F.when(F.col("i") % 6 == 0, F.array(F.lit("#copy"))).otherwise(F.array().cast("array<string>")))
        w = self.standard_lines.select("doc_id", "i", page.alias("p"), F.posexplode(tokens).alias("j", "text"))
        left = F.when(F.col("p") % 2 == 1, 40.0).otherwise(60.0)
        top = (F.col("i") % 40) * 20.0
        return w.select(
            "doc_id", (F.col("doc_id") * 1_000_000 + F.col("p")).alias("page"), F.col("i").alias("at"), "text",
            F.when(F.col("text") == "#copy", 10.0).otherwise(left + F.col("j") * 30).alias("x0"), top.alias("top"), (top + 10).alias("bottom"),
        )


_CAP = "upper(substring(t, 1, 1)) || substring(t, 2)"
#: A line of standard_lines, for Spark and DuckDB alike.
STANDARD_LINE = f"""CASE (i + doc_id) % 29
    WHEN 0 THEN cast(cast(1 + floor(i / 29) AS BIGINT) AS STRING) || '.' || cast(i % 4 AS STRING) || ' ' || {_CAP}
    WHEN 1 THEN {_CAP} WHEN 2 THEN t || ':' WHEN 3 THEN 'a) ' || t || ' include' WHEN 4 THEN '— ' || t || ';' WHEN 5 THEN t || '; and' WHEN 6 THEN '— ' || t || ' 12'
    WHEN 7 THEN 'b) ' || {_CAP} || '; or' WHEN 8 THEN 'NOTE 1 ' || t WHEN 9 THEN {_CAP} WHEN 10 THEN '1) `' || t || ':' WHEN 11 THEN '2) ' || t || ' [3]' WHEN 12 THEN '- ' || t
    WHEN 13 THEN {_CAP} || '.' WHEN 14 THEN t || ' shall:' WHEN 15 THEN 'c) ' || t || ' how to' WHEN 16 THEN 'd) ' || t WHEN 17 THEN '• ' || t || ',' WHEN 18 THEN 'Table A.1 ' || t WHEN 19 THEN '17'
    WHEN 20 THEN 'NOTE ' || t WHEN 21 THEN t WHEN 22 THEN '3) ' || t || ' to' WHEN 23 THEN '4) a,' || t WHEN 24 THEN {_CAP} WHEN 25 THEN '— ' || {_CAP} || '.' ELSE t END"""

_AT = "(TIMESTAMP '2024-01-01 00:00:00' + to_hours({h}))"
SQL = {
    "memory": f"""SELECT vec_id AS id, d.text AS fact, e.embedding::DOUBLE[] AS embedding, label AS strand, (1 + vec_id % 5)::INTEGER AS importance, [d.lang, d.source] AS tags,
        ['fact', 'decision', 'insight', 'todo', 'event', 'observation'][vec_id % 6 + 1] AS type,
        CASE WHEN vec_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status, vec_id % 23 = 0 AS ephemeral,
        CASE WHEN vec_id % 29 <> 0 THEN 0.4::DOUBLE * (1 + vec_id % 5) / 5 END AS strength, 0.3::DOUBLE * (1 + vec_id % 5) / 5 AS min_strength, 0.07::DOUBLE AS decay_rate,
        vec_id % 4 AS recall_count, vec_id % 3 AS reinforcement_count, {_AT.format(h='vec_id % 1400')} AS created_at, {_AT.format(h='vec_id % 1400')} AS last_used_at, {_AT.format(h='vec_id % 1400 + 5')} AS last_reinforced_at,
        ['src/f' || (vec_id % 13)] AS files_modified, ['src/f' || (vec_id % 7)] AS files_read, vec_id % 7 AS person, vec_id % 4 AS project
        FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "related_to": """SELECT * FROM (SELECT vec_id AS src, (vec_id * (2 * k + 1) + 7 * k) % n AS dst, CASE WHEN (vec_id + k) % 31 <> 0 THEN ((vec_id * 3 + k) % 20) / 20.0::DOUBLE END AS weight, ((vec_id + k) % 5)::INTEGER AS activation_count,
        TIMESTAMP '2024-01-01 00:00:00' - to_days(((vec_id + k) % 120)::INTEGER) AS last_activated_at, CASE WHEN (vec_id + k) % 3 <> 0 THEN 0.005::DOUBLE END AS decay_rate
        FROM embeddings, (SELECT count(*) AS n FROM embeddings), (VALUES (1), (2), (3)) ks(k)) WHERE src <> dst""",
    "leads_to": "SELECT src, dst, 0.5::DOUBLE AS weight FROM (SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_id AS dst FROM events) WHERE src IS NOT NULL",
    "contains_": """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer""",
    "about": "SELECT vec_id AS src, 'person-' || (vec_id % 7) AS dst FROM embeddings UNION ALL SELECT vec_id, 'agent-' || (vec_id % 2) FROM embeddings WHERE vec_id % 3 = 0",
    "control": "SELECT p_partkey AS id, p_name AS name, p_brand AS framework_id, p_size AS size FROM part",
    "supports": "SELECT l_orderkey * 10 + l_linenumber AS src, l_partkey AS dst, l_discount AS confidence FROM lineitem WHERE l_quantity > 45",
    "has_chunk": "SELECT l_orderkey AS src, l_orderkey * 10 + l_linenumber AS dst FROM lineitem",
    "about_control": "SELECT l_orderkey * 10 + l_linenumber AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'evidence' WHEN 'R' THEN 'gap' ELSE 'context' END AS relationship_type, l_suppkey % 5 AS org_id FROM lineitem WHERE l_quantity < 4",
    "identifies": """SELECT l_suppkey AS src, l_partkey AS dst, min(CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'R' THEN 'high' ELSE 'medium' END) AS severity,
        CASE WHEN (l_suppkey + l_partkey) % 2 = 0 THEN 'stable' ELSE 'increasing' END AS trend FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey, l_partkey""",
    "threat_technique": "SELECT p_partkey AS src, p_brand AS dst FROM part UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size % 3 = 0",
    "mitigates": "SELECT DISTINCT p_partkey AS src, p_brand AS dst FROM part WHERE p_partkey % 40 = 1 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_partkey % 90 = 1",
    "task": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'active' END AS status,
        CASE WHEN left(o_orderpriority, 1) = '1' THEN 'H' WHEN left(o_orderpriority, 1) IN ('2', '3') THEN 'M' WHEN left(o_orderpriority, 1) = '4' THEN 'L' END AS value,
        CASE o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'M' ELSE 'L' END AS effort, c_mktsegment AS project, o_orderdate::DATE AS due_on,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 11 = 0 END AS is_template, o_orderkey % 2 = 0 AS committed, o_orderkey % 6 = 0 AS untouched, o_totalprice AS price FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "standard_lines": f"""SELECT doc_id, i, {STANDARD_LINE} AS line FROM (SELECT doc_id, i, array_to_string(list_slice(w, 7 * i + 1, 7 * i + 7), ' ') AS t
        FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 6) // 7)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), '[ \\n\\t]+'), lambda x: regexp_replace(x, '[^a-zà-ÿ]', '', 'g')), lambda x: x <> '') AS w FROM documents)))""",
    "document": "SELECT doc_id, text AS body, lang, source FROM documents",
    "active_memory": "SELECT * FROM memory WHERE coalesce(status, 'active') = 'active' AND NOT coalesce(ephemeral, false)",
    "vecs": "SELECT id, embedding FROM memory",
    "pairs": "SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.embedding, b.embedding) AS similarity FROM vecs a, vecs b",
}


def duck(body: str) -> str:
    """DuckDB SQL with the definitions of the views that a query names put before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in SQL and name not in need:
                add(SQL[name])
                need.append(name)

    add(body)
    found = body.strip()
    heads = [f"{n} AS ({SQL[n]})" for n in need]
    recursive = found.upper().startswith("WITH RECURSIVE")
    if found.upper().startswith("WITH"):
        found = re.sub(r"(?i)^WITH(\s+RECURSIVE)?\s+", ", " if heads else "WITH " + ("RECURSIVE " if recursive else ""), found)
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(heads)}{found}" if heads else found
    return f"WITH {', '.join(heads)} {found}" if heads else found
