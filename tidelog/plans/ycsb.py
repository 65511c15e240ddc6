"""Operation mixes over a database, with latency percentiles."""

from __future__ import annotations

import random
import time

import numpy as np

from tidelog.database import Database

#: Shares of reads, updates, inserts, scans and read-modify-writes: the public YCSB core workloads.
MIXES = {
    "a": {"read": 0.5, "update": 0.5}, "b": {"read": 0.95, "update": 0.05}, "c": {"read": 1.0},
    "d": {"read": 0.95, "insert": 0.05}, "e": {"scan": 0.95, "insert": 0.05}, "f": {"read": 0.5, "modify": 0.5},
}


def run_mix(db: Database, mix: str, operations: int, keys: int, seed: int = 0) -> dict[str, dict[str, float]]:
    """{operation: {n, p50, p95, p99}} in milliseconds.  keys: user0 to user<keys - 1> are taken to be loaded."""
    rng, shares = random.Random(seed), MIXES[mix]
    took: dict[str, list[float]] = {}
    for _ in range(operations):
        (kind,) = rng.choices(list(shares), list(shares.values()))
        key = f"user{min(int(rng.paretovariate(1.2)) - 1, keys - 1)}"
        began = time.perf_counter()
        if kind == "read":
            db.get(key)
        elif kind == "scan":
            db.scan(key).limit(rng.randint(1, 100)).collect()
        elif kind == "insert":
            keys += 1
            db.put(f"user{keys - 1}", "x" * 100)
        else:
            db.put(key, (db.get(key) or b"")[:99] + b"y" if kind == "modify" else "y" * 100)
        took.setdefault(kind, []).append(1000 * (time.perf_counter() - began))
    return {k: {"n": len(v)} | {f"p{q}": round(float(np.percentile(v, q)), 3) for q in (50, 95, 99)} for k, v in took.items()}
