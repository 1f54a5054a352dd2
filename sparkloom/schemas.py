"""Tables of a workspace as explicit schemas (DDL), and their closed vocabularies."""

from __future__ import annotations


PAYLOAD = "struct<doc_id:string,chunk_id:string,text:string,source_file:string,source_path:string,page_num:int,chunk_index:int,char_count:int,created_at:string,mtime_iso:string,section:string,title:string,injection_risk:boolean,source_type:string,connector_id:string>"
POINTS = f"point_id bigint, doc_id string, source_file string, created_at string, text string, payload {PAYLOAD}, embedding array<float>"
CHUNKS = "doc_id string, chunk_id string, text string, source_file string, chunk_index int, section string, title string, created_at string, char_count int"
RECEIPTS = "id bigint, run_id string, sentence_index int, claim_text string, doc_id string, chunk_id string, retrieval_score double, confidence_band string, validator_pass int, model string, tokens int, cost_usd double, risk_tier string, created_at timestamp"
COSTS = "id bigint, run_id string, model string, tokens_in int, tokens_out int, cost_usd double, latency_ms double, tier_reason string, created_at timestamp"
APPROVALS = "id bigint, run_id string, action_class string, risk_tier string, payload string, status string, requested_at timestamp, resolved_at timestamp"
SESSIONS = "id string, intent string, started_at timestamp, duration double, cost double, project string, workspace_id string"
MCP_RESULTS = "id bigint, connector_id string, tool string, received_at timestamp, raw_text string, pii_redacted int, injection_risk int, injection_patterns array<string>, sanitized_summary string"
CONNECTORS = "workspace_id string, connector_id string, scopes string, allowed_actions string"
BRIEFS = "id bigint, workspace_id string, kind string, items array<struct<section:string,line:string,breadcrumb:struct<source:string,chunk:int,date:string>>>, created_at timestamp, notified int"
EVENTS_LOG = "id bigint, workspace_id string, step string, detail string, created_at timestamp"
ENTITIES = "id bigint, canonical_key string, label string, type string, confidence double, mention_count bigint, first_seen string, last_seen string"
ALIASES = "entity_id bigint, alias string, alias_key string, source_doc_id string"
EDGES = "src_id bigint, dst_id bigint, predicate string, confidence double, weight double, doc_id string, chunk_id string, extractor string, asserted_at timestamp"
MENTIONS = "entity_id bigint, doc_id string, chunk_id string, confidence double"
BACKFILL = "doc_id string, pass string, status string, entities int, edges int, error string, updated_at timestamp"

# fixed values
ENTITY_TYPES = ("person", "org", "product", "technology", "decision", "commitment", "money", "date", "place", "marker", "lock", "slice")
PREDICATES = ("MENTIONS", "AUTHORED_BY", "DECIDED_BY", "BLOCKS", "DEPENDS_ON", "OWNS", "WORKS_ON", "CLIENT_OF", "PRICED_AT", "DUE_ON", "SUPERSEDES", "PART_OF", "COMPETES_WITH", "CO_ACTIVITY")
EXTRACTORS = ("gazetteer", "regex", "llm", "pmi", "co_activity")
RISK_TIERS = ("read", "write_local", "exec", "external")
ANSWER_KINDS = ("empty", "extractive", "synthesized", "validator-degraded", "egress-blocked", "executor-offline", "unvalidated_offline")
