"""Numeric defaults that are part of the operators' semantics."""

INITIAL_STRENGTH_FACTOR, IMPORTANCE_FLOOR_FACTOR = 0.4, 0.3
INITIAL_DECAY_RATE, CONSOLIDATED_DECAY_RATE, EDGE_DECAY_RATE = 0.07, 0.01, 0.005
RECALL_INCREMENT, EXPLICIT_INCREMENT = 0.05, 0.20
EDGE_RECALL_INCREMENT, EDGE_EXPLICIT_INCREMENT = 0.02, 0.10
WEAK_EDGE, HARD_PRUNE_FLOOR, HARD_PRUNE_DAYS = 0.05, 0.01, 90
SHORT_REST_DAYS, LONG_REST_DAYS = 7, 1
REDISCOVERY_STRENGTH = 0.3
MODULATION_FACTOR, MODULATION_CAP = 0.5, 10.0
NEIGHBOUR_CAP, MAX_HOPS = 50, 3
DEDUP_DISTANCE, NEAR_DUP_SIMILARITY, NEAR_DUP_LIMIT = 0.05, 0.92, 20
COMPANION_LIMIT, CONVERSANT_LIMIT = 5, 10
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MIN = 2000, 200, 50
AUTO_SUPPORTS_DISTANCE, AUTO_SUPPORTS_K = 0.20, 3
AUTO_LINK_K, AUTO_LINK_DISTANCE = 5, 0.5
PERSON_OVERFETCH, PERSON_OVERFETCH_CAP = 5, 200
LOG_CAP, OPERATION_LOG_CAP = 100, 200
LEVELS = {"H": 3, "M": 2, "L": 1}
DEFAULT_EDGE_WEIGHT = 0.5
INDEX_CAPACITY, CAPACITY_WARN = 5000, 80.0
FRAMEWORK_SIMILARITY, ATTRIBUTE_THREAT_SIMILARITY, ATTRIBUTE_THREAT_K = 0.55, 0.40, 20
ATTRIBUTE_LEAF_K = 10
THREAT_DISTANCE, MERGE_GATE = 0.28, 30
INBOX_WEIGHT = 0.3
MIN_SENTENCE, FACT_CAP = 20, 500
RECOMMEND_LOW, RECOMMEND_HIGH, DRIFT_LIMIT = 0.18, 0.32, 0.03
GATE_PCT, GATE_EDGES = 80.0, 50
