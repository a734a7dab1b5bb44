"""Work that is done one after the other for each key, and side by side for different keys."""

from __future__ import annotations

import threading
from collections.abc import Callable, Hashable
from concurrent.futures import Future, ThreadPoolExecutor


class KeyedExecutor:
    """First in, first out for each key; a task that fails doesn't hold up the next; a key without work is forgotten."""

    def __init__(self, threads: int = 8):
        self._pool = ThreadPoolExecutor(threads, thread_name_prefix="keyed")
        self._lock = threading.Lock()
        self._waiting: dict[Hashable, list[tuple[Callable, Future]]] = {}

    def submit(self, key: Hashable, task: Callable) -> Future:
        future: Future = Future()
        with self._lock:
            idle = key not in self._waiting
            self._waiting.setdefault(key, []).append((task, future))
        if idle:
            self._pool.submit(self._drain, key)
        return future

    def run(self, key: Hashable, task: Callable):
        """Waits for the result. Not to be called from a task of the same key."""
        return self.submit(key, task).result()

    def _drain(self, key: Hashable) -> None:
        while True:
            with self._lock:
                queue = self._waiting[key]
                if not queue:
                    del self._waiting[key]
                    return
                task, future = queue.pop(0)
            if not future.set_running_or_notify_cancel():
                continue
            try:
                future.set_result(task())
            except BaseException as e:
                future.set_exception(e)

    @property
    def keys(self) -> set:
        with self._lock:
            return set(self._waiting)

    def close(self) -> None:
        self._pool.shutdown()
