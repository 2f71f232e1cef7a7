"""Schemas and constants of the operation log and its bookkeeping tables."""

from __future__ import annotations

from dataclasses import dataclass

#: An operation, as a log row and on the wire.
OP = "src_node string, src_seq long, hlc string, op_type string, col_id string, col_name string, record_id string, payload string, files map<string,array<string>>"
#: What schema operations are keyed by.
SCHEMA_COL = "_collections"
RECORD_OPS, SCHEMA_OPS = ("upsert", "delete"), ("col_upsert", "col_delete")
#: The clock value that everything supersedes but nothing.
FLOOR_HLC = "0000000000000000-0001"


@dataclass(frozen=True)
class Config:
    """The knobs that change what a query returns; times in seconds."""

    sync_interval: int = 10
    max_batch: int = 500
    apply_batch: int = 200
    compaction_interval: int = 3600
    tombstone_retention: int = 720 * 3600
    event_buffer_size: int = 512
    exclude_collections: tuple[str, ...] = ("_logs",)
    replicate_superusers: bool = False
    exempt_superusers: bool = True
    max_clients: int = 10_000
    max_paths: int = 200
    max_dangling: int = 500
    max_parked: int = 10_000
    path_bytes: int = 256

    def __post_init__(self) -> None:
        if min(self.sync_interval, self.max_batch, self.apply_batch, self.event_buffer_size, self.max_clients, self.max_paths) < 1:
            raise ValueError("intervals, batches and caps must be positive")

    def excluded(self) -> tuple[str, ...]:
        """Names or ids that never replicate."""
        return self.exclude_collections if self.replicate_superusers else (*self.exclude_collections, "_superusers")

    def page(self, asked: int | None) -> int:
        """A page limit within (0, max_batch]."""
        return asked if asked and 0 < asked <= self.max_batch else self.max_batch
