"""What a Python worker keeps between batches, given up when another operator moves in.

Spark reuses its Python workers for stage after stage, so the vocabularies and memories of
every operator that ran in a worker would stay there together.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_here: dict[str, Callable[[], None]] = {}


def occupy(name: str, release: Callable[[], None]) -> None:
    """Say that ``name`` uses this worker now; others release what they hold."""
    if name in _here:
        return
    others = list(_here.values())
    _here.clear()
    _here[name] = release
    for other in others:
        other()
    if others:
        gc.collect()
        try:  # Give freed pages back to the system where the C library can.
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass
