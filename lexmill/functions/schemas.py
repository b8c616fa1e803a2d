"""Explicit schemas of the engine's tables; ``readers.read_rows`` reads by them instead of inference, so a missing field is null."""

REFERENCE = "struct<text_match:string,target_id:string>"
NODES = f"doc_id string, node_id string, parent_id string, path array<int>, depth int, seq int, node_type string, node_index string, title string, content string, lead_in string, trailing string, breadcrumb string, references array<{REFERENCE}>"
EDGES = "src_id string, text_match string, target_id string"
TABLES = "doc_id string, table_index int, page_number int, headers array<string>, rows array<array<string>>, row_count int, col_count int, extraction_strategy string"
DOCUMENT = "document_id string, document_type string, document_number string, title string, issue_date date, effective_date date, hierarchy_rank int, status string, expiry_date date, superseded_by string"
CHUNKS = (
    "chunk_id string, doc_id string, node_id string, node_type string, node_index string, seq int, title string, breadcrumb string, text string, depth int, parent_dieu_index string, "
    "parent_khoan_index string, referenced_node_ids array<string>, amended_by_doc_ids array<string>, effective_date date, effective_to date, status string, superseded boolean, superseded_by string, embedding array<float>"
)
REGISTRY = (
    "key string, doc_id string, doc_type string, number string, legal_level int, effective_from date, effective_to date, status string, supersedes array<string>, amended_by array<string>, "
    "implements array<string>, amends array<string>, category string, tax_scope map<string,array<string>>, scope_of_application string"
)
POINTS = "array<struct<letter:string,content:string,subpoints:array<string>>>"
CLASSIC = f"doc_id string, articles array<struct<number:string,title:string,clauses:array<struct<number:string,content:string,points:{POINTS}>>>>"
ANNOTATION = "chunk_id string, who array<string>, activity_group array<string>, tax_domain array<string>, content_type string, effective_from string, effective_to string, confidence double"
KEY_FACT = "value string, fact_type string, source string, evidence_node string, confidence double"
TIER = "struct<score:double,reason:string,details:map<string,string>>"
RESULT = (
    f"question_id int, question string, topic string, difficulty string, user_type string, needs_calculation boolean, answer string, tool_calls array<struct<tool:string,args:string,result:string>>, "
    f"latency_ms long, error string, tier1 {TIER}, tier2 {TIER}, tier3 {TIER}, tier4 {TIER}, degrade_level int, fm_breakdown map<string,int>, retrieved_doc_ids array<string>, false_refusal boolean"
)
CACHE = "entry_id string, question string, answer string, key_facts array<string>, topic string, source_round string, cache_version int, top_doc_ids array<string>, created_at timestamp, embedding array<float>"
ANSWER_LOG = "ts timestamp, question string, answer_len int, model string, iterations int, latency_ms long, tools_used array<string>, top_chunks array<string>, top_scores array<double>"
PATCHES = "doc_id string, op_seq int, op string, node_id string, field string, value string"
HITS = "query_id long, rank int, chunk_id string, doc_id string, rrf_score double, final_score double, provenance array<string>"
TURNS = "conv_id long, turn long, role string, text string"
