"""Schemas of the engine's tables."""

from __future__ import annotations

PAPER_PAGES = "paper_id string, page_no int, text string, n_images int"
TABLE_CELLS = "paper_id string, page_no int, table_no int, row_no int, col_no int, cell string"
CODE_FILES = "code_id string, path string, kind string, text string"
RESULTS = "audit_id string, metric string, value double"
AUDITS = "audit_id string, paper_id string, code_id string"
READINGS = "paper_id string, page_no int, region_kind string, run int, name string, value string, evidence_text string"
ANSWERS = "audit_id string, qid string, answer string"
EVIDENCE = "owner_id string, side string, key string, ordinal bigint, raw_value string, num double, txt string, location string, file string, page int, line int, snippet string, channel string, excluded boolean"
EVIDENCE_COLUMNS = [c.split()[0] for c in EVIDENCE.split(", ")]
REJECTED = "owner_id string, side string, key string, value string, location string, reason string"
MEMORY = "fp string, title string, runs int, last_seen timestamp, unresolved array<string>, page_hints map<string,array<int>>, scheme int"
