"""Declared schemas of the corpus tables. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

USD = "decimal(38,12)"

DETAILS = (
    "struct<raw_characters:bigint,raw_bytes:bigint,created_ids:array<string>,"
    "returned_ids:array<string>,candidate_ids:array<string>,source_status:string,"
    "new_source:boolean,duplicate:boolean,tool:string,query:string,context:string,"
    "seed_id:string,proposal_reused:boolean,model_invoked:boolean,"
    "relations:array<struct<memory_id:string,related_memory_id:string,kind:string>>,"
    "abstractions:array<struct<content:string,derived_from:array<string>>>>"
)
USAGE = (
    "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,"
    "cost_usd:decimal(38,12),cache_write_tokens:bigint>"
)
PROPOSAL = (
    "struct<allowed_candidate_ids:array<string>,"
    "relations:array<struct<memory_id:string,related_memory_id:string,kind:string>>,"
    "abstractions:array<struct<content:string,derived_from:array<string>>>>"
)

_DDL = {
    "state": "key string, value string",
    "sources": "id string, content_hash string, relative_path string, created_at timestamp, status string",
    "memories": ("seq long, id string, depth int, content string, source_ref string, "
                 "created_at timestamp, dream_revision long, last_recalled_at timestamp, "
                 "created_by_model string, origin_key string, sealed boolean"),
    "derived_from": "child_id string, parent_id string",
    "memory_roots": "memory_id string, source_id string",
    "runs": ("id long, kind string, period_start timestamp, period_end timestamp, "
             "started_at timestamp, memory_high_water long, relation_high_water long, "
             f"recall_high_water long, status string, budget_usd {USD}, finished_at timestamp, "
             "work_initialized boolean"),
    "relations": ("seq long, memory_id string, related_memory_id string, kind string, "
                  "related_at timestamp, run_id long"),
    "recall_events": "seq long, memory_id string, recalled_at timestamp",
    "embeddings": "memory_id string, space string, dimensions int, vector array<float>",
    "run_work": ("run_id long, work_key string, phase string, memory_id string, ordinal int, "
                 "status string, proposal_json string, model string"),
    "rejected_proposals": "run_id long, work_key string, proposal_index int, reason string",
    "api_calls": (f"id string, run_id long, model string, operation string, reserved_usd {USD}, "
                  f"actual_usd {USD}, usage_json string, created_at timestamp, completed_at timestamp"),
    "activity_operations": ("id string, kind string, origin string, parent_id string, "
                            "source_id string, run_id long, work_key string, charged_run_id long, "
                            "started_at timestamp, completed_at timestamp, status string, "
                            "error_type string, details_json string"),
    "activity_relation_results": ("run_id long, work_key string, proposal_index int, "
                                  "activity_id string, at timestamp, outcome string, "
                                  "memory_id string, related_memory_id string, kind string, "
                                  "reason string"),
    "activity_api_calls": "api_call_id string, activity_id string, settings_json string",
}

JSON_COLUMNS = {
    "details_json": DETAILS,
    "usage_json": USAGE,
    "proposal_json": PROPOSAL,
    "settings_json": "map<string,string>",
}

TABLES = tuple(_DDL)

STATUS_DOMAIN = {
    "sources": ("pending", "processing", "complete", "failed"),
    "run_kinds": ("dream", "meditation"),
    "relation_kinds": ("positive", "negative"),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


QUESTION_FILE = (
    "question_id string, question_type string, question string, answer string, "
    "question_date string, answer_session_ids array<string>, haystack_dates array<string>, "
    "haystack_session_ids array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string>>>"
)
