"""Settings from the environment: flags and bounded numbers."""

from __future__ import annotations

import os

# Spellings of a switched-on flag.
ON = ("1", "true", "yes", "on")


def flag(name: str, default: bool = False) -> bool:
    """Whether a variable is switched on; the default where it is missing or blank."""
    value = os.environ.get(name, "").strip().lower()
    return value in ON if value else default


def bounded(name: str, default: int, low: int, high: int | None = None) -> int:
    """An integer variable within its bounds; the default where it is missing or no integer."""
    try:
        value = int(os.environ.get(name, "").strip())
    except ValueError:
        value = default
    return max(low, value if high is None else min(value, high))
