"""Schemas of the audit tables (DDL strings)."""

TASKS = (
    "task_id string, name string, remark string, status string, created_at timestamp, "
    "result string, output_json string, logs array<string>"
)
STAGE_META = (
    "struct<last_run_kind: string, gap_checked_at: timestamp, revalidated_at: timestamp, "
    "review_summary: string, rejected_count: int, confirmed_count: int, uncertain_count: int>"
)
STAGES = (
    "stage_id string, task_id string, name string, status string, result string, output_json string, "
    f"logs array<string>, meta {STAGE_META}, created_at timestamp, updated_at timestamp"
)
FILES = "task_id string, path string, content string"
BOUNDARY = (
    "struct<source: string, pre_bytes: bigint, post_bytes: bigint, summarized_message_count: bigint, "
    "head_id: string, anchor_id: string, tail_id: string>"
)
TOOL_CALLS = "array<struct<id: string, name: string, arguments: string>>"
MESSAGES = (
    "session string, seq bigint, id string, parent_id string, role string, kind string, content string, "
    f"tool_calls {TOOL_CALLS}, tool_call_id string, tool_name string, artifact_id string, "
    f"boundary {BOUNDARY}, created_at timestamp"
)
STATES = (
    "session string, task_id string, stage string, status string, active_boundary_id string, "
    "last_memory_message_id string, memory_text string, last_memory_failure_at timestamp, consecutive_memory_failures int, "
    "next_artifact_id bigint, next_evidence_id bigint, artifact_order array<string>, updated_at timestamp"
)
ARTIFACTS = (
    "session string, seq bigint, id string, type string, tool_name string, path string, start_line int, "
    "end_line int, original_bytes bigint, truncated boolean, captured_at timestamp, content string"
)
