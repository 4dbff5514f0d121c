"""Numbers that the semantics rest on."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    candidate_k: int = 20
    final_k: int = 5
    overall_high: float = 0.78
    overall_low: float = 0.45
    document_high: float = 0.75
    document_low: float = 0.45
    average_gate: float = 0.55
    rrf_k: int = 60
    weights: tuple[float, float, float, float, float] = (0.35, 0.25, 0.20, 0.15, 0.05)
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    window_rounds: int = 10
    summary_chars: int = 1200
    chunk_size: int = 1600
    chunk_overlap: int = 100
    pdf_chunk_size: int = 900
    pdf_chunk_overlap: int = 140
    markdown_merge: int = 300
    pdf_merge: int = 250
    embedding_dim: int = 1024
    snapshot_k: int = 5
    cpu_alert: float = 80.0
    memory_alert: float = 70.0


DEFAULTS = Settings()
