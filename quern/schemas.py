"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

DOCUMENTS = "source string, page int, doc_ord long, content string"
CHUNKS = "chunk_id string, source string, page int, chunk_ord long, content string, content_hash string"
MANIFEST = "source string, hash string, chunk_ids array<string>"
GOLDEN = "question string, ground_truth string, reference_contexts array<string>, expected_route string, expected_sources array<string>"
HITS = "question_id long, path string, path_ord int, sub_query_ord int, sub_query string, rank int, content string, source_id string, title string, score double"
ROUTES = ("vector", "web", "both", "none")
STAGES = ("queued", "parsing", "indexing", "indexed", "failed")
