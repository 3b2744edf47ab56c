"""Sending: retried, in the background, in batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame

from tidelog.broker import Broker

#: Tries after the first, and the seconds that the n-th waits for.
RETRIES, WAIT = 3, lambda n: float(n)


class Producer:
    """Sends batches to a broker. A batch that failed is sent again under its number, so what was stored before the failure is not stored twice."""

    def __init__(self, broker: Broker, retries: int = RETRIES, wait: Callable[[int], float] = WAIT, publish: Callable[..., DataFrame] | None = None):
        self.broker, self.retries, self.wait = broker, retries, wait
        self.publish = publish or broker.publish
        self.pool = ThreadPoolExecutor(max_workers=1)  # a store has one writer

    def send(self, messages: DataFrame, batch: int, keyed: bool = False) -> tuple[DataFrame, int]:
        """(what broker.publish returns, tries); the last fault is raised when no try is left. Unknown topics aren't tried again."""
        for n in range(1, self.retries + 2):
            try:
                return self.publish(messages, batch, keyed), n
            except ValueError:
                raise
            except Exception:
                if n > self.retries:
                    raise
                time.sleep(self.wait(n))
        raise AssertionError

    def send_async(self, messages: DataFrame, batch: int, keyed: bool = False, done: Callable[[DataFrame | None, Exception | None], None] | None = None) -> Future:
        """send() in the background; done gets its result, or what was wrong."""

        def run() -> tuple[DataFrame, int]:
            try:
                out = self.send(messages, batch, keyed)
            except Exception as fault:
                if done:
                    done(None, fault)
                raise
            if done:
                done(out[0], None)
            return out

        return self.pool.submit(run)

    def close(self) -> None:
        self.pool.shutdown(wait=True)
