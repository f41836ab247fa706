"""Fixed schemas: nothing is inferred when records are read."""

from __future__ import annotations

ATTRIBUTE = (
    "struct<namespace:string,path:string,value_type:string,string_value:string,integer_value:decimal(38,0),"
    "double_value:double,boolean_value:boolean,json_value:string,unit:string>"
)

#: The analytics table, in column order.
RECORDS = (
    "tenant_id bigint, project_id bigint, record_id string, acceptance_id string, batch_id string, lane_id int, batch_seq bigint, record_ordinal int,"
    " kind string, event_time_us bigint, event_time_ns_remainder smallint, arrival_time_us bigint, received_time_us bigint, source_event_id string,"
    " trace_id string, span_id string, level string, original_level string, severity_number smallint, message string, message_template string,"
    " service string, environment string, release string, logger string, sdk_name string, sdk_version string, platform string, server_name string,"
    f" issue_id string, exception_type string, exception_value string, handled boolean, attrs array<{ATTRIBUTE}>, search_values array<string>,"
    " warnings array<string>, schema_version int, normalizer_version int, grouping_version int"
)
PAYLOADS = "record_id string, raw_json string, envelope_sdk_json string, normalization_warnings_json string, canonical_metadata_json string"

#: Columns of a list row and of a detail row.
LIST_COLUMNS = (
    "project_id record_id kind event_time_us event_time_ns_remainder received_time_us lane_id batch_seq record_ordinal level severity_number"
    " message service environment release trace_id issue_id"
).split()
DETAIL_COLUMNS = "record_id project_id kind event_time_us event_time_ns_remainder received_time_us source_event_id raw_json envelope_sdk_json normalization_warnings_json canonical_metadata_json".split()
