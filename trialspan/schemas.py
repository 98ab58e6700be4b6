"""Declared schemas and column roles of the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names of latency points.
#: Latency points of a window, in the order of its life; the first thirteen add up on a serial path.
POINTS = [
    "buffer_fill", "admission_wait", "queue_wait", "weak_attempt", "dep_block", "store_read", "backend_queue_wait", "input_link_per_window",
    "compute_wait", "fetch", "algorithm", "release", "service", "confidence", "input_check_wait", "selection_wait", "output_link_per_window",
    "frame_commit", "dd_per_window", "escalation_link_per_window", "buffer0_ready_to_frame", "buffer0_first_round_to_frame",
    "qpu_last_round_to_frame", "qpu_first_round_to_frame",
]

WINDOWS = """stream_id string, window_index long, commit_lo long, commit_hi long, buffer_hi long, t_first_round long, t_data_complete long,
t_queued long, t_released long, t_dispatch long, t_done long, t_input_final long"""

STAGES = """stream_id string, run_sequences array<long>, tier string, dispatch long, compute_start long, fetch_end long, algorithm_end long, done long,
ready long, store_read long, backend_queue_wait long, cancelled boolean"""

COMMITS = "stream_id string, window_index long, run_sequence long, accepted long, committed long"

SHOTS = "task_id string, algorithm string, seed long, failed boolean, scored boolean, unscored_reason string, core_seconds double, windows long, strong_windows long, strong_service_us double, reaction_us double, backlog_peak long"


@dataclass(frozen=True)
class Roles:
    """How the columns of a table fold."""

    means: list[str] = field(default_factory=list)
    maxes: list[str] = field(default_factory=list)
    sums: list[str] = field(default_factory=list)
    true_counts: list[str] = field(default_factory=list)


SHOT_ROLES = Roles(means=["reaction_us"], maxes=["backlog_peak"], sums=["windows", "strong_windows", "strong_service_us", "core_seconds"], true_counts=["failed", "scored"])


@dataclass(frozen=True)
class Additive:
    """A table of a record: the columns that name a row, and those that are counts of it. Records join by union, and counts of one name by addition."""

    keys: list[str]
    counts: list[str] = field(default_factory=list)


_TASK = ["task_id", "algorithm"]
# Names of the eleven tables.
#: The additive tables of a record.
RECORD = {
    "shots": Additive([*_TASK, "seed"]),
    "shot_links": Additive([*_TASK, "seed", "link"]),
    "shot_pools": Additive([*_TASK, "seed", "pool"]),
    "shot_stats": Additive([*_TASK, "seed", "path", "statistic", "field"]),
    "stat_values": Additive([*_TASK, "path", "statistic", "value"], ["count"]),
    "shot_data_movement": Additive([*_TASK, "seed", "path"]),
    "window_samples": Additive([*_TASK, "seed", "window_index"]),
    "latency_samples": Additive([*_TASK, "point", "tier", "value_us"], ["count"]),
    "window_confidence": Additive([*_TASK, "seed", "window_index"]),
    "confidence_histogram": Additive([*_TASK, "kind", "gap_bin"], ["windows", "failures"]),
    "window_outcomes": Additive([*_TASK, "seed", "window_index"]),
}
