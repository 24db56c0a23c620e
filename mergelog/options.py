"""Options of a store; per open, never persisted."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    create_if_missing: bool = True
    flush_threshold_bytes: int = 4 << 20
    bloom_fpr: float = 0.01
    bloom_filters: bool = True
    compaction_min_merge: int = 4
    tier_ratio: int = 4
    block_size: int = 4096
