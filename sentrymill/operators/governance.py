"""Locks on frozen inputs, the guarded test split, and the feature registry's checks."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

STATE_BUDGET = 4096


def file_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def write_lock(path: str, files: list[str], supersedes: str | None = None) -> dict:
    """Hashes of files, and of the lock that this one replaces, as canonical JSON."""
    lock = {"files": {os.path.basename(f): file_hash(f) for f in sorted(files)}, "supersedes": file_hash(supersedes) if supersedes else None, "opened": 0}
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(lock, f, sort_keys=True, indent=1)
    return lock


def verify_lock(path: str, files: list[str]) -> None:
    with open(path, encoding="utf-8") as f:
        lock = json.load(f)["files"]
    changed = [f for f in files if lock.get(os.path.basename(f)) != file_hash(f)]
    if changed:
        raise RuntimeError(f"changed since the lock: {changed}")


def open_split(name: str, path: str, flag: str = "SENTRYMILL_OPEN_TEST") -> int:
    """How often the test split was opened, this time included; refused without the environment flag."""
    if name != "test":
        return 0
    if os.environ.get(flag) != "1":
        raise PermissionError(f"the test split opens only with {flag}=1")
    with open(path, encoding="utf-8") as f:
        lock = json.load(f)
    lock["opened"] += 1
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(lock, f, sort_keys=True, indent=1)
    return lock["opened"]


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    tier: int
    state_bytes: int
    residual: bool


#: The register, in the order of feature vectors.
FEATURES = tuple(
    Feature(*x)
    for x in (
        ("v_txn_count_z", "F1", 1, 24, True), ("v_gmv_z", "F1", 1, 24, True), ("v_gmv_accel", "F1", 1, 176, True), ("v_declared_ratio", "F1", 1, 248, True), ("v_fano_trailing", "F1", 1, 232, True),
        ("v_dormant_burst", "F1", 1, 32, True), ("t_p95_median_ratio", "F2", 1, 264, True), ("t_round_amount_share", "F2", 1, 16, True), ("t_micro_share", "F2", 1, 16, True), ("t_new_max_event", "F2", 1, 24, False),
        ("i_intl_share", "F3", 1, 16, True), ("i_cnp_share", "F3", 1, 16, True), ("f_auth_fail_rate_z", "F5", 1, 32, True), ("f_retry_burst_rate", "F5", 1, 160, True), ("d_refund_rate_z", "F6", 1, 32, True),
        ("d_refund_amount_ratio", "F6", 1, 120, True), ("h_interarrival_cv", "F7", 1, 184, True), ("h_weekend_share_z", "F7", 1, 136, True), ("p_mcc_group", "F9", 1, 0, False), ("p_days_since_onboarding", "F9", 1, 0, False),
        ("p_kyc_tier", "F9", 1, 0, False), ("p_vintage_months", "F9", 1, 0, False), ("p_declared_monthly_gmv", "F9", 1, 0, False), ("p_city_tier", "F9", 1, 0, False), ("t_wasserstein_7d", "F2", 2, 1150, True),
        ("i_mix_jsd", "F3", 2, 252, True), ("f_decline_entropy", "F5", 2, 40, True), ("h_hourly_jsd", "F7", 2, 864, True),
    )
)


def check_register(features: tuple = FEATURES, budget: int = STATE_BUDGET) -> tuple[int, int]:
    """(declared bytes, residual columns); raises on a repeated name or an overdrawn budget."""
    names = [f.name for f in features]
    if len(set(names)) < len(names):
        raise ValueError("a feature is registered twice")
    if (total := sum(f.state_bytes for f in features)) > budget:
        raise ValueError(f"state of {total} bytes is over {budget}")
    return total, sum(f.residual for f in features)


def align(columns: list[str], trained: list[str]) -> list[str]:
    """The trained order; raises if a column is missing."""
    missing = [c for c in trained if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return trained


def added_columns(before: list[str], after: list[str], declared: set[str]) -> None:
    """One declared difference between two rungs, or an error."""
    if set(after) - set(before) != declared or set(before) - set(after):
        raise ValueError("the rungs differ in more than what is declared")
