"""What a Python worker keeps from task to task.

Spark gives a worker the tasks of one operator after another. Tokenizers, models and the
words they have met are worth keeping between tasks of the same operator, but those of
several would add up, so a worker holds one at a time.
"""

from __future__ import annotations

import ctypes
import gc

_HELD: dict = {}


def trim() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def held(key, make):
    """The object under `key`, made if this worker has it not; anything else it held goes first."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            trim()
        _HELD[key] = make()
    return _HELD[key]
