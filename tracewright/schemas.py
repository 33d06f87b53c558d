"""Schemas of the canonical tables."""

from __future__ import annotations

# The canonical event types and source tiers.
EVENT_TYPES = ("invocation_start", "prompt_capture", "cot_reasoning", "tool_call", "tool_result", "evidence_seal", "agent_registered")
SOURCE_TIERS = ("T3a", "T4")

AGENT_EVENT = "event_id string, event_timestamp timestamp, ingested_at timestamp, agent_id string, agent_name string, event_type string, source_tier string, payload string, decision_journal_id string, integrity_hash string"
TOOL_CALL = "struct<tool_name:string,tool_args:string,result:string,duration_ms:double>"
MODEL_CALL = "struct<model_id:string,prompt_preview:string,cot_reasoning:string,token_usage:map<string,bigint>,latency_ms:double>"
JOURNAL = f"journal_id string, agent_id string, agent_name string, started_at timestamp, completed_at timestamp, user_message string, final_response string, model_calls array<{MODEL_CALL}>, tool_calls array<{TOOL_CALL}>, total_tokens bigint, sealed boolean, integrity_hash string"
VERDICT = "struct<decision:string,rule:string,message:string,approval:struct<status_url:string>>"

# Caps in code points of the captured fields.
CAPS = {
    "journal.user_message": 500,
    "event.user_message": 300,
    "model_call.prompt_preview": 300,
    "model_call.cot_reasoning": 1000,
    "llm_span.input": 500,
    "llm_span.output": 1000,
    "event.cot_preview": 300,
    "tool_result.text": 500,
    "tool_call.result": 200,
    "tool_span.value": 500,
    "journal.final_response": 500,
    "span.value": 4000,
}
