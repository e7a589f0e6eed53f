"""Objects that a Python worker process builds once and all its tasks share."""

from __future__ import annotations

import threading
from collections.abc import Callable

_built: dict[str, object] = {}
_lock = threading.Lock()


def once(name: str, build: Callable[[], object]) -> object:
    """What ``build`` gave when this process first asked for ``name``; a build that raises is tried again."""
    if name not in _built:
        with _lock:
            if name not in _built:
                _built[name] = build()
    return _built[name]
