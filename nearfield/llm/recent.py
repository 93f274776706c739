"""Bounded caches for the hot loops of Python workers."""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What ``make`` gave for ``name`` in this process. Only the last name is remembered, so that a worker that runs several operators in turn has room for one's caches at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    """Give up what is held: operators without caches of their own need the room for other things."""
    _held.clear()


class Recent(dict):
    """Remembers what :meth:`make` gives for recent keys.

    It holds two generations of ``size`` keys at most. A full one becomes the old one, and a key that
    is found there moves up again, so what is used often stays. A hit costs one lookup in C.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
