"""The engine's knobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: the defaults of the store that the queries model
    wal_segment_size: int = 20
    memtable_size: int = 20
    summary_count: int = 3
    cache_size: int = 10
    lsm_levels: int = 4
    lsm_max_per_level: int = 4
    sstable_size: int = 100
    leveled_max_runs: tuple[int, ...] = (4, 10, 25, 100)
    bloom_fpr: float = 0.01
    # rows of a flushed run, for logs that carry no run of their own
    run_size: int = 500


DEFAULT = Config()
#: Key prefixes that belong to the store itself.
RESERVED = ("tb_", "hll_", "cms_", "bf_", "sh_")
