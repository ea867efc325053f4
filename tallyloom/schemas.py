"""Schemas of the tables the operators work on, as DDL text."""


MESSAGES = (
    "conversation_id string, message_index bigint, role string, content string, "
    "content_type string, model string, ts timestamp"
)
CALLS = (
    "conversation_id string, call_index bigint, input bigint, cache_read bigint, cache_write bigint, "
    "output bigint, total_tokens bigint, model string, provider string, role string, ts timestamp"
)
SESSIONS = (
    "id string, source string, source_id string, title string, model string, total_input_tokens bigint, "
    "total_output_tokens bigint, total_cache_read_tokens bigint, api_call_count bigint, "
    "input_output_ratio double, message_count bigint, cost_estimate double, accuracy string, "
    "start_time timestamp, end_time timestamp, context struct<first_msg:string, second_msg:string, "
    "last_msg:string, user_turns:bigint, assistant_turns:bigint, total_messages:bigint, total_chars:bigint, "
    "time_start:timestamp, time_end:timestamp, system_tokens:bigint, "
    "message_sizes:array<struct<role:string,estimated_tokens:bigint>>, thinking_tokens:bigint, "
    "thinking_output_tokens:bigint>"
)
REQUEST_LOG = (
    "request_id string, model string, channel_header string, port int, user_agent string, body string, "
    "response_time_ms bigint, ts timestamp, stream boolean"
)
LINES = ("doc_id string, path string, line_no bigint, line string")
TASKS = (
    "project string, seq bigint, module string, content string, task_type string, section_path string, "
    "line_num bigint, raw_text string"
)
CALIBRATION = (
    "task_content string, task_type string, module string, predicted_days double, actual_days double, "
    "recorded_at timestamp"
)

# One nullable struct that covers every transcript record type.
TRANSCRIPT_RECORD = (
    "type string, timestamp string, key string, kind string, channel string, modelId string, provider string, "
    "customType string, data struct<modelId:string>, "
    "message struct<role:string, content:string, model:string, "
    "usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint>>, _corrupt string"
)
CONTENT_PARTS = "array<struct<type:string,text:string>>"
