"""Schemas of the logical tables, as DDL."""

VOICE_SOURCE = "id long, voice_id string, title string, gmt_create timestamp_ntz, add_date timestamp_ntz, voice_channel string, uid string, voice_detail_link string"
#: Voices without an id or a time, as they came.
QUARANTINE = f"{VOICE_SOURCE}, reason string"
ROUTE = "struct<gm_code:string,goc_product_line:string,voice_router_score:double,collection_name:string,document:string>"
CANDIDATE = "struct<risk_event_id:string,risk_event_title:string,score:double,time_decay_factor:double,decision_score:double>"
RISK_EVENT = (
    "risk_event_id string, risk_event_title string, status string, gm_code string, goc_product_line string, data_source string, risk_event_volume long, "
    "initial_timestamp timestamp_ntz, last_active_timestamp timestamp_ntz, threshold_breach_timestamp timestamp_ntz, last_alerted_timestamp timestamp_ntz"
)
#: Known events as the matching finds them: by the vector of their title.
KNOWLEDGE = (
    "risk_event_id string, risk_event_title string, status string, gm_code string, goc_product_line string, data_source string, "
    "initial_timestamp timestamp_ntz, embedding array<double>"
)
#: What the stages before event management decide about a voice.
DECIDED = (
    "id long, voice_id string, title string, gm_code string, gmt_create timestamp_ntz, risk_event_id string, decision string, "
    "goc_product_line string, batch_cluster_title string, initial_summary_text string"
)
VOICE_MAPPING = "voice_id string, risk_event_id string, voice_date timestamp_ntz"
VOLUME_TIMELINE = "risk_event_id string, snapshot_time timestamp_ntz, volume_at_snapshot long, incremental_volume_at_snapshot long"
ALERT_RECORD = "risk_event_id string, alert_timestamp timestamp_ntz, volume_at_alert long, alert_type string, alert_context string"
SUMMARIES = "struct<summaries:array<struct<text:string,original_indices:array<int>>>>"
DECISION = "struct<decision:string,matched_risk_event_id:string,reason:string>"
