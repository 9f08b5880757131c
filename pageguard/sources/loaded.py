"""Objects that cost much to load (models, tokenizers), kept for the life of a worker process."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from threading import Lock
from typing import Any

#: Objects that a process keeps; the one that was used longest ago goes first.
MOST = 4

_KEPT: OrderedDict[str, Any] = OrderedDict()
_LOCKS: dict[str, Lock] = {}
_GUARD = Lock()


class Memo:
    """A loader that loads once a process, however many tasks ask, and one at a time for each key.

    A load that fails leaves nothing behind, so the next call tries again; forget() gives up what has been loaded, as after
    a failure in use. Loaders with one key are taken for the same; without a key each Memo has one of its own, which goes
    along to the workers.
    """

    def __init__(self, load: Callable[[], Any], key: str | None = None):
        self.load, self.key = load, key or uuid.uuid4().hex

    def __call__(self) -> Any:
        with _GUARD:
            lock = _LOCKS.setdefault(self.key, Lock())
        with lock:
            if self.key not in _KEPT:
                made = self.load()
                with _GUARD:
                    _KEPT[self.key] = made
                    while len(_KEPT) > MOST:
                        _KEPT.popitem(last=False)
                return made
            with _GUARD:
                _KEPT.move_to_end(self.key)
                return _KEPT[self.key]

    def forget(self) -> None:
        with _GUARD:
            _KEPT.pop(self.key, None)


def memoised(load: Callable[[], Any], key: str | None = None) -> Memo:
    return load if isinstance(load, Memo) else Memo(load, key)
