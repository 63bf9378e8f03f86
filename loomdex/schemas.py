"""Schemas of the stored tables and of the records models must return."""

from __future__ import annotations

DOCUMENTS = (
    "doc_id STRING, filename STRING, content_hash STRING, kind STRING, status STRING, "
    "chunks_count INT, error STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CHUNK_METADATA = "STRUCT<doc_id: STRING, page: INT, section: STRING, articul: STRING, brand: STRING>"
CHUNKS = (
    f"chunk_id STRING, doc_id STRING, ordinal INT, text STRING, metadata {CHUNK_METADATA}, "
    "suspicious BOOLEAN"
)
VECTORS = "chunk_id STRING, doc_id STRING, embedding ARRAY<FLOAT>"
BLOCKS = (
    "doc_id STRING, block_no INT, kind STRING, content STRING, page INT, section STRING, "
    "rows ARRAY<ARRAY<STRING>>"
)
CALLS = (
    "job_id STRING, agent STRING, model STRING, prompt_tokens INT, completion_tokens INT, "
    "cost DECIMAL(10,6), latency_ms INT, outcome STRING, error STRING"
)
TRACES = (
    "job_id STRING, ordinal BIGINT, step STRING, agent STRING, model STRING, prompt_text STRING, "
    "raw_completion STRING, parsed_output STRING, usage_json STRING"
)

FACTS = "STRUCT<product_name: STRING, characteristics: MAP<STRING, STRING>, missing_fields: ARRAY<STRING>>"
SOURCE = "STRUCT<chunk_id: STRING, doc_id: STRING, page: INT, score: DOUBLE>"
CARD = (
    "STRUCT<title: STRING, description: STRING, characteristics: MAP<STRING, STRING>, "
    "benefits: ARRAY<STRING>, seo: STRUCT<title: STRING, description: STRING, keywords: ARRAY<STRING>>, "
    f"sources: ARRAY<{SOURCE}>, missing_fields: ARRAY<STRING>, confidence: DOUBLE>"
)
CRITIQUE = "STRUCT<verdict: STRING, issues: ARRAY<STRING>>"
INJECTION_VERDICT = "STRUCT<injection: BOOLEAN, reason: STRING>"
JUDGEMENT = "STRUCT<faithfulness: DOUBLE, reasons: ARRAY<STRING>>"
GOLDEN = (
    "file STRING, product STRING, characteristics MAP<STRING, STRING>, benefits_topics ARRAY<STRING>, "
    "missing_fields ARRAY<STRING>, source_probes MAP<STRING, STRUCT<page: INT, text_contains: STRING>>, "
    "pii_must_be_masked ARRAY<STRING>, "
    "injection_must_be_blocked STRUCT<marker: STRING, card_must_not_contain: ARRAY<STRING>>, "
    "notes STRING, ocr_characteristics_if_enabled MAP<STRING, STRING>"
)

EMPTY_MAP = "CAST(MAP() AS MAP<STRING, STRING>)"
EMPTY_LIST = "CAST(ARRAY() AS ARRAY<STRING>)"
