"""Spark actions in flight: bounded submission with cancellation, values used in turn, deadlines, timing."""

from __future__ import annotations

import asyncio
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import SparkSession

from gridloom.sources import tuning
from gridloom.sources.store_writer import Conflict, latest


class Actions:
    """Spark actions run from ``threads`` threads, under a job tag of their own.

    At most ``most`` actions may be unfinished: ``submit`` blocks until there is room, so a fast producer cannot flood
    the driver. With one thread, actions run in the order in which they were submitted. As a context manager
    it waits for all on the way out, or cancels what is left if the body failed.
    """

    def __init__(self, spark: SparkSession, threads: int = 4, most: int | None = None):
        self.spark, self.tag = spark, f"gridloom-{uuid.uuid4().hex}"
        self._threads = ThreadPoolExecutor(threads, thread_name_prefix="action")
        self._room = threading.BoundedSemaphore(most) if most else None
        self._unsettled: dict[Future, int] = {}
        self._cancelled = threading.Event()

    def submit(self, action: Callable[[], object]) -> Future:
        if self._room:
            self._room.acquire()
        future = self._threads.submit(self._tagged, action)
        if self._room:
            future.add_done_callback(lambda _: self._room.release())
        self._unsettled[future] = len(self._unsettled)
        return future

    def _tagged(self, action: Callable[[], object]) -> object:
        if self._cancelled.is_set():
            raise InterruptedError("cancelled before it began")
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            return action()
        finally:
            context.removeJobTag(self.tag)

    @property
    def unfinished(self) -> list[Future]:
        return [f for f in self._unsettled if not f.done()]

    def settle(self, left: int = 0) -> None:
        """Waits until at most ``left`` actions are unfinished, then raises the first error among the finished ones, if any."""
        while len(running := self.unfinished) > left:
            wait(running, return_when=FIRST_COMPLETED)
        over = [f for f in self._unsettled if f.done()]
        for f in over:
            del self._unsettled[f]
        for f in over:
            f.result()

    def cancel(self) -> None:
        """Stops running Spark jobs of these actions; what has not begun does not begin."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Actions:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self.cancel()
            wait(self.unfinished)
        try:
            if error is None:
                self.settle()
        finally:
            self._threads.shutdown()


async def results(futures: Iterable[Future]) -> list:
    """What actions return, awaited from a coroutine."""
    return list(await asyncio.gather(*(asyncio.wrap_future(f) for f in futures)))


async def wait_until(awaitable, when: float):
    """The result, unless ``when`` (of time.monotonic()) comes first: TimeoutError, and the work is cancelled."""
    async with asyncio.timeout(max(0.0, when - time.monotonic())):
        return await awaitable


class InTurn:
    """A value that coroutines use one at a time, in the order in which they asked for it.

    ``async with shared.ask() as value`` waits for the number drawn by ``ask``. If the body fails, whoever comes next fails
    with the same error on entry, and so on, as what the value holds is then in doubt.
    """

    def __init__(self, value):
        self.value = value
        self._drawn = self._called = 0
        self._doubt: BaseException | None = None
        self._moved = asyncio.Condition()

    def ask(self) -> _Number:
        self._drawn += 1
        return _Number(self, self._drawn)


class _Number:
    def __init__(self, shared: InTurn, number: int):
        self.shared, self.number = shared, number

    async def _over(self) -> None:
        async with self.shared._moved:
            self.shared._called = self.number
            self.shared._moved.notify_all()

    async def __aenter__(self):
        shared = self.shared
        async with shared._moved:
            await shared._moved.wait_for(lambda: shared._called == self.number - 1)
        if shared._doubt is not None:
            await self._over()
            raise shared._doubt
        return shared.value

    async def __aexit__(self, kind, error, trace) -> None:
        if error is not None:
            self.shared._doubt = error
        await self._over()


def elapsed(action: Callable[[], object]) -> tuple[object, float]:
    """An action's result and its seconds."""
    began = time.perf_counter()
    got = action()
    return got, time.perf_counter() - began


def best_setting(spark: SparkSession, key: str, values: list, action: Callable[[], object]):
    """The value of a session setting under which ``action`` ran fastest; the setting is restored."""
    old, times = spark.conf.get(key, None), {}
    try:
        for v in values:
            spark.conf.set(key, v)
            times[v] = elapsed(action)[1]
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    return min(times, key=times.get)


def tuned_setting(spark: SparkSession, store: str, operation: str, arguments: dict, key: str, values: list, action: Callable[[], object], nearest: bool = False):
    """The best of ``values`` for a session setting, from the tuning store at ``store`` if it knows the operation with these arguments on this cluster; else
    measured by ``best_setting`` and saved there. ``nearest``: what is known of another version or cluster will do. Two that measure at the same time may both
    save; the one that comes second reads the first one's value."""
    keys = {"device_name": spark.sparkContext.master, "device_platform": "spark", "device_version": spark.version, "operation": operation, "arguments": json.dumps(arguments, sort_keys=True), "setting": key}
    on = latest(store)
    if on >= 0 and (known := tuning.lookup(tuning.load(spark, store), keys, nearest).first()) is not None:
        return known["value"]
    best = str(best_setting(spark, key, values, action))
    row = spark.createDataFrame([tuple(keys.values()) + (best,)], ", ".join(f"{c} string" for c in (*keys, "value")))
    try:
        tuning.save(store, row, list(keys), on)
    except Conflict:
        return tuned_setting(spark, store, operation, arguments, key, [best], lambda: None, nearest)
    return best
