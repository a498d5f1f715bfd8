"""Schemas of the truth tables and of the index; keys are kept unique by the operators that append."""

TRUTH = {
    "sessions": "id string, parent_session_id string, session_hash string, captured_at timestamp_ntz, actor_type string, agent_id string, user_email string, branch string",
    "turns": "id string, session_id string, turn_index int, role string, content string, ts timestamp_ntz",
    "tool_calls": "id string, session_id string, call_order int, tool string, path string, cmd_prefix string",
    "checkpoints": "id string, git_sha string, git_branch string, user_email string, ts timestamp_ntz, actor_type string, agent_id string",
    "files_touched": "id string, checkpoint_id string, file_path string, change_type string",
    "checkpoint_sessions": "checkpoint_id string, session_id string",
    "checkpoint_state": "file_path string, byte_size bigint, file_hash string, version bigint",
    "exported": "checkpoint_id string, batch string",
    "stream_lines": "file_name string, line_no int, raw_line string",
}
KEYS = {"sessions": ["id"], "turns": ["id"], "tool_calls": ["id"], "checkpoints": ["id"], "files_touched": ["id"], "checkpoint_sessions": ["checkpoint_id", "session_id"], "stream_lines": ["file_name", "line_no"]}
INDEX = {
    "turns_ft": "id string, session_id string, turn_index int, role string, content string, ts timestamp_ntz",
    "tool_calls_index": "id string, session_id string, call_order int, tool string, path string, cmd_prefix string",
    "files_index": "checkpoint_id string, session_id string, file_path string, change_type string",
    "session_facets": "session_id string, user_email string, git_branch string, actor_type string, agent_id string, captured_at timestamp_ntz, turn_count bigint, tool_call_count bigint, file_count bigint, checkpoint_id string, git_sha string",
    "file_cooccurrence": "file_a string, file_b string, count bigint",
    "postings": "term string, id string, session_id string, turn_index int, tf bigint, dl int, bucket int",
    "session_embeddings": "session_id string, embedding array<float>, generated_at timestamp, model string",
    "lsa_terms": "term string, idx int, idf double, vec array<double>",
    "index_state": "key string, value string",
}
