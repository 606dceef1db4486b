"""Explicit schemas of stored and exchanged tables."""

from __future__ import annotations

CATEGORIES = (
    "marketplace_id string, category_id string, external_id string, category_name string, "
    "parent_category_id string, ordinal bigint, import_run_id string, created_at timestamp"
)
CHARACTERISTICS = (
    "marketplace_id string, characteristic_id string, external_characteristic_id string, category_id string, "
    "characteristic_name string, mandatory boolean, restrictive boolean, ordinal bigint, import_run_id string, "
    "created_at timestamp"
)
VALUES = (
    "marketplace_id string, category_id string, characteristic_id string, characteristic_name string, "
    "value string, ordinal bigint, import_run_id string, created_at timestamp"
)
MARKETPLACES = "marketplace_id string, marketplace_name string, is_active boolean, updated_at timestamp"
IMPORT_RUNS = (
    "import_run_id string, marketplace_id string, source_type string, status string, notes string, logged_at timestamp"
)
IMPORT_ISSUES = (
    "import_run_id string, marketplace_id string, severity string, issue_type string, entity_type string, "
    "entity_id string, message string"
)
OFFERS = (
    "offer_id string, title string, status string, error string, description string, category string, "
    "image_url string, ean string, brand string, sku string, weight string, warranty string, "
    "existing_chars map<string,string>, ordinal bigint"
)
PRODUCT_KNOWLEDGE = (
    "ean string, brand string, normalized_title string, marketplace_id string, offer_id string, category string, "
    "final_attributes map<string,string>, confidence double, run_id string, updated_at timestamp"
)
AI_RUN_LOG = (
    "run_id string, ean string, offer_id string, marketplace string, model_used string, tokens_input int, "
    "tokens_output int, cost_usd double, fields_requested int, fields_accepted int, fields_rejected int, "
    "retry_count int, fallback_used boolean, duration_ms int, created_at timestamp, structured_mode string, "
    "structured_attempted boolean, structured_success boolean, structured_fallback_used boolean, "
    "structured_latency_ms int, structured_model_used string, schema_fields_count int, shadow_diff string, "
    "vision_signal string, vision_confidence double, fusion_action string, conflict_flag boolean"
)
RESULTS = (
    "offer_id string, title string, original_cat string, error_code string, action string, new_category string, "
    "cleared array<string>, new_chars map<string,string>, missing_mandatory array<string>, needs_manual boolean, "
    "category_reason string, chars_reasons map<string,string>, "
    "review array<struct<char_name:string,value_input:string,value:string,method:string,score:double,reason:string>>"
)
RUN_LOG = (
    "offer_id string, title string, error_code string, action string, new_category string, new_chars map<string,string>, "
    "cleared array<string>, reason string, category_reason string, chars_reasons map<string,string>, "
    "missing_mandatory array<string>, unmapped boolean, logged_at string, day date, run_id string"
)
RUN_INDEX = "marketplace string, run_id string, run_ts timestamp"
TABLES = {
    "categories": CATEGORIES,
    "characteristics": CHARACTERISTICS,
    "characteristic_values": VALUES,
    "marketplaces": MARKETPLACES,
    "import_runs": IMPORT_RUNS,
    "import_issues": IMPORT_ISSUES,
    "product_knowledge": PRODUCT_KNOWLEDGE,
    "ai_run_log": AI_RUN_LOG,
    "process_runs": RESULTS,
    "run_index": RUN_INDEX,
}
