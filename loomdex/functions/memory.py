"""A bound on what a Python process holds."""

from __future__ import annotations

import os
import resource


def held_mb() -> float:
    """Resident memory of this process."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
    except OSError:  # no such file system: the most it ever held
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def guard(limit_mb: int | None, doing: str) -> None:
    """MemoryError where the process holds more; None is no limit."""
    if limit_mb is not None and held_mb() > limit_mb:
        raise MemoryError(f"{held_mb():.0f} MB held while {doing}, {limit_mb} allowed")
