"""Models in Python workers, which Spark reuses from stage to stage.

A worker holds one model at a time, and gives it back to the system when no
task has used it for a few seconds, so that an idle worker holds nothing while
another stage runs beside it.
"""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import TypeVar

T = TypeVar("T")
#: Seconds after the last use from which on a model goes.
IDLE = 4.0
_held: dict[Hashable, object] = {}
_lock = threading.RLock()
_state = {"users": 0, "left": 0.0, "watched": False}


def _give_back() -> None:
    _held.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _watch() -> None:
    while True:
        time.sleep(1)
        with _lock:
            if not _state["users"] and time.monotonic() - _state["left"] >= IDLE:
                _give_back()
                _state["watched"] = False
                return


@contextmanager
def resident(name: Hashable, make: Callable[[], T]) -> Iterator[T]:
    """The model of that name while it is used; another one that the worker still holds goes first."""
    with _lock:
        if name not in _held:
            _give_back()
            _held[name] = make()
        _state["users"] += 1
        model = _held[name]
    try:
        yield model  # type: ignore[misc]
    finally:
        with _lock:
            _state["users"] -= 1
            _state["left"] = time.monotonic()
            if not _state["watched"]:
                _state["watched"] = True
                threading.Thread(target=_watch, daemon=True).start()
