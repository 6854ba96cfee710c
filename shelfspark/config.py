"""Settings and their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes of pools and results, packing of passages, and the window of a prompt."""

    hybrid_k: int = 24
    final_k: int = 8
    min_relevance: float = 0.15
    target_tokens: int = 350
    overlap_tokens: int = 60
    min_tokens: int = 80
    recent_turns: int = 6
    turn_chars: int = 1_500
    digest_tokens: int = 800
    note_tokens: int = 600
    context_tokens: int = 16_384
    answer_tokens: int = 2_048
    dim: int = 64

    @property
    def prompt_budget(self) -> int:
        return int((self.context_tokens - self.answer_tokens) * 0.9)
