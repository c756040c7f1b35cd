"""Options of the compression pipeline."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from weftline.functions.adapters import FormatAdapter
from weftline.functions.units import tokens


@dataclass(frozen=True)
class CompressOptions:
    """What ``compress`` does. Callables run on workers, a batch at a time, and must pickle."""

    preserve: tuple[str, ...] = ("system",)
    recency_window: int = 4
    source_version: int = 0
    short_chars: int = 120
    dedup: bool = True
    fuzzy_dedup: bool = False
    fuzzy_threshold: float = 0.85
    importance_scoring: bool = False
    importance_threshold: float = 0.65
    contradiction_detection: bool = False
    contradiction_topic_threshold: float = 0.15
    #: (regular expression, label) pairs; a text that one finds stays.
    preserve_patterns: tuple[tuple[str, str], ...] = ()
    #: Text to {decision: preserve | compress, confidence, reason}; ``full`` skips the engine's own detectors.
    classifier: Callable[[str], Mapping[str, Any]] | None = None
    classifier_mode: str = "hybrid"
    adapters: tuple[FormatAdapter, ...] = ()
    #: Messages of more tokens than this are compressed even where they are recent, short, important or structured.
    observation_threshold: int | None = None
    #: Conversations of fewer tokens than this stay as they are.
    compression_threshold: int | None = None
    #: Best sentence score below which a group is dropped to a stub.
    relevance_threshold: float | None = None
    embed_summary_id: bool = False
    compression_depth: str = "gentle"  # gentle, moderate, aggressive; auto with a token budget
    summarizer: Callable[[str], str] | None = None
    entropy_scorer: Callable[[list[str]], Sequence[float]] | None = None
    entropy_scorer_mode: str = "augment"
    token_classifier: Callable[[str], Sequence[tuple[str, bool, float]]] | None = None
    discourse_aware: bool = False
    semantic_clustering: bool = False
    cluster_threshold: float = 0.15
    conversation_flow: bool = False
    coreference: bool = False
    tool_prepass: bool = False
    #: A content column to its number of tokens.
    token_counter: Callable[[Column], Column] = tokens
    token_budget: int | None = None
    budget_strategy: str = "binary"  # or tiered
    min_recency_window: int = 0
    force_converge: bool = False
    #: Put before "dup of", "near-dup of" and "superseded by" in tags, for readers that expect a name there.
    namespace: str = ""
    summary_id_prefix: str = "sum_"
