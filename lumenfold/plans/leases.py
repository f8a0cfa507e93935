"""Leases: one job of a name at a time, without locks that a dead driver leaves behind.

A lease is the file locks/<name>/<number>.json with the time until which it holds. Whoever creates the next number holds
it; that succeeds once, and only when the last one has run out or was given back. The number is a fencing token: a commit
made under a lease is refused once a commit under a later one of that name is in the store.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from lumenfold.sources.storage import HadoopFiles

TTL = 60.0


class AlreadyRunning(RuntimeError):
    """Another job of that name holds a lease that hasn't run out."""


class StaleLease(RuntimeError):
    """The lease ran out, and another job has taken over."""


class Lease:
    def __init__(self, spark: SparkSession, root: str, name: str, ttl: float = TTL, clock: Callable[[], float] = time.time):
        self.files, self.name, self.ttl, self.clock = HadoopFiles(spark), name, ttl, clock
        self.folder, self.token = f"{root.rstrip('/')}/locks/{name}", 0

    def _last(self) -> int:
        return max((int(n[:12]) for n in self.files.names(self.folder) if n[:12].isdigit()), default=0)

    def _file(self, token: int) -> str:
        return f"{self.folder}/{token:012d}.json"

    def take(self) -> Lease:
        last = self._last()
        if last and json.loads(self.files.read(self._file(last)))["until"] > self.clock():
            raise AlreadyRunning(self.name)
        if not self.files.publish(self._file(last + 1), {"until": self.clock() + self.ttl}):
            raise AlreadyRunning(self.name)  # another was faster
        self.token = last + 1
        return self

    def renew(self) -> None:
        if self._last() != self.token:
            raise StaleLease(self.name)
        self.files.write(self._file(self.token), json.dumps({"until": self.clock() + self.ttl}).encode())

    def give_back(self) -> None:
        if self._last() == self.token:
            self.files.write(self._file(self.token), b'{"until": 0}')


@contextmanager
def single_flight(spark: SparkSession, root: str, name: str, ttl: float = TTL) -> Iterator[Lease]:
    """Holds the lease of a name, renewing it as long as the block runs."""
    lease, over = Lease(spark, root, name, ttl).take(), threading.Event()

    def keep() -> None:
        while not over.wait(ttl / 3):
            try:
                lease.renew()
            except StaleLease:
                return  # its next commit says so

    threading.Thread(target=keep, daemon=True).start()
    try:
        yield lease
    finally:
        over.set()
        lease.give_back()
