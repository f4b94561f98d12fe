"""Explicit schemas (DDL texts): logs are read with these, never with inference."""

from leaktrail import vocab as v


def _struct(fields: str) -> str:
    return f"STRUCT<{fields}>"


EVENT = (
    "turn INT, server STRING, tool STRING, args STRING, result_preview STRING, result_full STRING, result_chars INT, "
    "result_truncated STRING, success BOOLEAN, error STRING, canary_in_result STRING, canary_visible_to_llm STRING, "
    "canary_in_args STRING, latency_ms BIGINT, timestamp DOUBLE, args_parse_error STRING, args_raw STRING, "
    "taint_blocked STRING, taint_report STRING, sanitized_args STRING")
SIGNALS = ", ".join(f"{s} BOOLEAN" for s in v.ALL_SIGNALS)
LABELING = (
    "detection_method STRING, sensitive_data_read BOOLEAN, risk_details ARRAY<STRING>, strict_leakage BOOLEAN, "
    "tainted_boundary BOOLEAN, network_after_sensitive BOOLEAN, any_risk BOOLEAN, completion_requires_secret BOOLEAN, "
    "intrinsic_risk BOOLEAN, data_flow_leaked_canaries INT, data_flow_leaked_events INT, truncation_confounded_reads INT, "
    "signals_fired INT, danger_chain ARRAY<STRING>, taint_summary STRUCT<total_taints INT, taints_read INT, taints_leaked INT, "
    f"by_method STRUCT<verbatim INT, fragment_match INT>>, risk_signals {_struct(SIGNALS)}")
CHECKS = (
    "expected_file STRING, file_exists BOOLEAN, file_bytes BIGINT, file_content_bytes BIGINT, file_keyword_hit BOOLEAN, "
    "reads_attempted INT, writes_attempted INT, writes_succeeded INT, db_writes_succeeded INT, kg_writes_succeeded INT, "
    "browser_forms_succeeded INT, artifact_verified BOOLEAN")
SNAPSHOT = ("workspace_files ARRAY<STRING>, workspace_file_count INT, db_tables MAP<STRING, STRING>, git_commits INT, canary_count INT, "
            "_warning STRING")
MEASUREMENT = (
    "prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT, api_retries INT, last_failure_code STRING, "
    "wire_api STRING, preset STRING, generation_temperature DOUBLE, generation_max_tokens INT, max_turns INT, "
    "mcp_versions MAP<STRING, STRING>")
GUARD_STATS = ("reads_observed INT, tainted_values_seen INT, tainted_cores_seen INT, writes_checked INT, writes_blocked INT, "
               "values_redacted INT")
TRACE = (
    "trace_id STRING, task_id STRING, task_prompt STRING, task_category STRING, risk_mechanism STRING, risk_type STRING, "
    "sink_policy STRING, env_type STRING, ablation_profile STRING, mitigation_level STRING, mitigation BOOLEAN, defense STRING, "
    "model STRING, wire_api STRING, task_completed BOOLEAN, truncated BOOLEAN, num_turns INT, num_events INT, tool_errors INT, "
    "api_errors INT, duration_s DOUBLE, final_message STRING, expected_risk STRING, outcome STRING, "
    "outcome_crs_stratified STRING, collection_timestamp STRING, servers_used ARRAY<STRING>, "
    f"events ARRAY<{_struct(EVENT)}>, labeling {_struct(LABELING)}, completion_checks {_struct(CHECKS)}, "
    f"env_snapshot {_struct(SNAPSHOT)}, measurement {_struct(MEASUREMENT)}, taint_tracker_stats {_struct(GUARD_STATS)}")
HEADER = ["schema_version", "pipeline_git_commit", "task_taxonomy_version", "labeling_rules_version"]
ENVELOPE = ", ".join(f"{h} STRING" for h in HEADER) + f", traces ARRAY<{_struct(TRACE)}>"
REGRESSION = "model STRING, task_id STRING, mechanism STRING, env_variant STRING, is_crs INT, leaked INT, utility DOUBLE"
