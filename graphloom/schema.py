"""Node and edge types as Spark schemas (DDL text), and the vocabularies their fields are checked against."""


_NODE = "created_at TIMESTAMP"
NODES = {
    "memory": ("id STRING, fact STRING, so_what STRING, text STRING, type STRING, tags ARRAY<STRING>, files_modified ARRAY<STRING>, files_read ARRAY<STRING>, importance INT, last_used_at TIMESTAMP, last_reinforced_at TIMESTAMP, updated_at TIMESTAMP, archived_at TIMESTAMP, embedding ARRAY<FLOAT>, strength DOUBLE, min_strength DOUBLE, decay_rate DOUBLE, recall_count INT, reinforcement_count INT, status STRING, ephemeral BOOLEAN, superseded_by STRING, " + _NODE),
    "strand": ("id STRING, name STRING, description STRING, category STRING"),
    "agent": ("id STRING"),
    "person": ("id STRING, name STRING, description STRING"),
    "project": ("id STRING, name STRING, description STRING, slug STRING, weight DOUBLE"),
    "task": ("id STRING, title STRING, description STRING, status STRING, value STRING, effort STRING, priority_score DOUBLE, urgency INT, due_at TIMESTAMP, snooze_until TIMESTAMP, updated_at TIMESTAMP, committed_at TIMESTAMP, committed_by STRING, last_checked_at TIMESTAMP, source_ref STRING, recurrence STRING, is_template BOOLEAN, " + _NODE),
    "system": ("id STRING, last_short_rest_at TIMESTAMP, last_long_rest_at TIMESTAMP, maintenance_log STRING, operation_log STRING"),
    "framework": ("id STRING, title STRING, version STRING, level STRING, body STRING, statement_type STRING, modality STRING, external_id STRING, domain STRING, layer STRING, perspective STRING, matrix STRING, cell_role STRING, t100_stereotype STRING, embedding ARRAY<FLOAT>, community_id LONG, cluster_id INT, betweenness DOUBLE, cluster_updated_at TIMESTAMP, " + _NODE),
    "control": ("id STRING, name STRING, description STRING, framework_id STRING, embedding ARRAY<FLOAT>, " + _NODE),
    "norm": ("id STRING, title STRING, body STRING, level STRING, version STRING, valid_from DATE, valid_until DATE, announced_at DATE, text_hash STRING, lang STRING, domain STRING, embedding ARRAY<FLOAT>, " + _NODE),
    "document": ("id STRING, title STRING, policy_level STRING, source_url STRING, " + _NODE),
    "chunk": ("id STRING, body STRING, sequence INT, doc_id STRING, heading STRING, section_ref STRING, status STRING, embedding ARRAY<FLOAT>, " + _NODE),
    "business_attribute": ("id STRING, name STRING, description STRING, source_ref STRING, tier STRING, status STRING, `group` STRING, t100_stereotype STRING, superseded_by STRING, embedding ARRAY<FLOAT>, " + _NODE),
    "threat_report": ("id STRING, title STRING, publisher STRING, published_at DATE, valid_from DATE, valid_until DATE, scope STRING, perspective_notes STRING, " + _NODE),
    "threat": ("id STRING, text STRING, tags ARRAY<STRING>, embedding ARRAY<FLOAT>, archived BOOLEAN, merged_into STRING, merged_at TIMESTAMP, " + _NODE),
    "asset": ("id STRING, title STRING, asset_type STRING, exposure STRING, data_classification STRING, " + _NODE),
    "precept": ("id STRING, name STRING, text STRING, framework_id STRING"),
    "jurisdiction": ("code STRING, name STRING, region STRING"),
}

_EDGE = "src STRING, dst STRING"
EDGES = {
    **{n: (_EDGE) for n in ("produced_by", "about", "merged_into", "owned_by", "for_project", "relates_to", "blocks", "depends_on", "maps_to", "has_chunk", "has_next", "cites_doc", "addresses", "requires", "fulfils", "applies_in")},
    "in_strand": (_EDGE + ", weight DOUBLE"),
    **{n: (_EDGE + ", weight DOUBLE, activation_count INT, last_activated_at TIMESTAMP, decay_rate DOUBLE") for n in ("related_to", "leads_to")},
    **{n: (_EDGE + ", created_at TIMESTAMP") for n in ("mitigates", "mapped_to_technique", "targets")},
    "contains": (_EDGE + ", rationale STRING, created_at TIMESTAMP"),
    "informs": (_EDGE + ", rationale STRING, similarity DOUBLE, source STRING, created_at TIMESTAMP"),
    "references": (_EDGE + ", version_pinned STRING"),
    "supports": (_EDGE + ", confidence DOUBLE, raw_score DOUBLE, status STRING, created_at TIMESTAMP"),
    "influence": (_EDGE + ", polarity STRING, severity STRING, rationale STRING, status STRING, created_at TIMESTAMP"),
    "identifies": (_EDGE + ", severity STRING, confidence STRING, trend STRING, source_terminology STRING, created_at TIMESTAMP"),
    "about_control": (_EDGE + ", relationship_type STRING, org_id STRING"),
}

#: The words that fields may hold.
MEMORY_TYPES = ("fact", "decision", "insight", "todo", "event", "observation")
TASK_STATUSES = ("open", "active", "blocked", "done", "abandoned")
VALUE_LEVELS = ("H", "M", "L")
RELATIONSHIP_TYPES = ("context", "evidence", "gap")
