"""Tunable limits, all with the defaults the results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults that decide which rows a query returns.
    retrieval_top_k: int = 5
    retrieval_threshold: float = 0.35
    rrf_k: int = 60
    leg_factor: int = 2
    suspicious_chunk_limit: int = 2
    upload_max_bytes: int = 10 * 1024 * 1024
    chunk_size: int = 700
    chunk_overlap: int = 120
    context_char_limit: int = 6000
    card_title_max_len: int = 60
    confidence_human_threshold: float = 0.5
    source_coverage_threshold: float = 0.8
    max_fix_attempts: int = 2
    max_rounds: int = 3
    embed_dim: int = 768
    model_timeout_s: float = 300.0
    model_max_attempts: int = 3
    detector_char_limit: int = 4000
    error_char_limit: int = 480
    call_error_char_limit: int = 500


DEFAULTS = Settings()


def top_k_or_default(top_k: int | None, settings: Settings = DEFAULTS) -> int:
    """``None`` and ``0`` both mean the configured default."""
    return top_k or settings.retrieval_top_k


def threshold_or_default(threshold: float | None, settings: Settings = DEFAULTS) -> float:
    """Only ``None`` means the default: a threshold of zero is a real threshold."""
    return settings.retrieval_threshold if threshold is None else threshold
