"""Model sessions of a Python worker: a bounded cache with leases.

Workers are reused from task to task, so what they hold must not grow. A session is opened on first use and stays open for
the next user. At the bound, the session that was idle longest is closed first; a session in use is never closed, and a
caller who needs another one waits for a lease to end. release() closes a session now, or when its last lease ends.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any


class _Held:
    def __init__(self, session: Any, close: Callable[[Any], None] | None):
        self.session, self.close, self.leases, self.unwanted = session, close, 0, False


class SessionPool:
    def __init__(self, bound: int = 2):
        self.bound, self.held, self.changed = bound, OrderedDict(), threading.Condition()
        self.opened = self.most = 0

    def _close(self, key: str) -> None:
        h = self.held.pop(key)
        if h.close is not None:
            h.close(h.session)
        self.changed.notify_all()

    @contextmanager
    def lease(self, key: str, open_: Callable[[], Any], close: Callable[[Any], None] | None = None, wait: float = 600.0) -> Iterator[Any]:
        with self.changed:
            while key not in self.held or self.held[key].unwanted:
                if key not in self.held and len(self.held) < self.bound:
                    self.held[key] = _Held(open_(), close)
                    self.opened, self.most = self.opened + 1, max(self.most, len(self.held))
                    break
                idle = next((k for k, h in self.held.items() if not h.leases), None)
                if idle is not None:
                    self._close(idle)
                elif not self.changed.wait(wait):
                    raise TimeoutError(f"all {self.bound} sessions stay in use")
            held = self.held[key]
            held.leases += 1
            self.held.move_to_end(key)
        try:
            yield held.session
        finally:
            with self.changed:
                held.leases -= 1
                if held.unwanted and not held.leases:
                    self._close(key)
                self.changed.notify_all()

    def release(self, key: str) -> None:
        """Closes a session, once nobody uses it."""
        with self.changed:
            if key in self.held:
                self.held[key].unwanted = True
                if not self.held[key].leases:
                    self._close(key)


#: The sessions of this process: image and text models of one worker share the bound.
SESSIONS = SessionPool()
