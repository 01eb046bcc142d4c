"""Constants of the analysis pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values.
    max_tokens: int = 512
    overlap_tokens: int = 64
    slice_chars: int = 2048
    top_k: int = 5
    similarity_floor: float = 0.5
    routing_similarity: float = 0.6
    min_chunks: int = 3
    max_retries: int = 2
    sentence_limit: int = 50
    sentence_chars: int = 512
    min_sentence_chars: int = 5
    label_threshold: float = 0.2
    positive_threshold: float = 0.5
    tolerance: float = 0.01

    def __post_init__(self) -> None:
        if self.routing_similarity <= self.similarity_floor:
            raise ValueError("the routing threshold must lie above the similarity floor, or it never fires")


DEFAULT = Settings()
