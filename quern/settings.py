"""Defaults of the engine; every one is a parameter where it is used."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    chunk_overlap: int = 100
    top_k: int = 4
    web_results: int = 4
    rrf_k: int = 60
    graded: int = 6
    confidence: float = 0.6
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_floor: float = 0.25
    route_ttl: int = 300
    web_ttl: int = 600
    answer_ttl: int = 1800
    question_chars: int = 2000
    upload_bytes: int = 25 * 1024 * 1024
    tasks_kept: int = 500
    upload_timeout: int = 300
    eval_questions: int = 3
    #: Sides with at most so many rows are broadcast; beyond, the join shuffles.
    broadcast_rows: int = 500_000


DEFAULTS = Settings()
