"""Plan cache (LRU) and result cache, both invalidated by table versions."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class CacheStats:
    hits: int = 0
    misses: int = 0
    evictions: int = 0


class PlanCache:
    """Prepared statements by text; the least recently used goes first."""

    def __init__(self, size: int = 100):
        self.size, self.stats, self._held = size, CacheStats(), OrderedDict[Any, Any]()

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        if key in self._held:
            self.stats.hits += 1
            self._held.move_to_end(key)
            return self._held[key]
        self.stats.misses += 1
        self._held[key] = make()
        while len(self._held) > self.size:
            self._held.popitem(last=False)
            self.stats.evictions += 1
        return self._held[key]

    def clear(self) -> None:
        self._held.clear()

    def view(self, spark: SparkSession) -> DataFrame:
        """The system view ``plan_cache_stats``: one row."""
        s = self.stats
        rate = s.hits / (s.hits + s.misses) if s.hits + s.misses else 0.0
        return spark.createDataFrame(
            [(s.hits, s.misses, len(self._held), s.evictions, rate, self.size)],
            "hits bigint, misses bigint, size bigint, evictions bigint, hit_rate double, max_size bigint",
        )


class ResultCache:
    """Persisted results by statement and the versions of the tables it reads.

    Results stay in Spark's storage (memory, then disk); an entry goes when it
    is too old, when there are too many or they hold too many bytes, or when a
    table it read has changed.  A result of more bytes than all may hold is
    computed, but not kept.
    """

    def __init__(self, entries: int = 1000, seconds: float = 300.0, most_bytes: int = 64 << 20):
        self.entries, self.seconds, self.most_bytes, self.stats = entries, seconds, most_bytes, CacheStats()
        self._held: OrderedDict[Any, tuple[float, frozenset[str], DataFrame]] = OrderedDict()

    def get(self, key: Any, tables: frozenset[str], make: Callable[[], DataFrame]) -> DataFrame:
        now = time.monotonic()
        if (held := self._held.get(key)) and now - held[0] <= self.seconds:
            self.stats.hits += 1
            self._held.move_to_end(key)
            return held[2]
        self.stats.misses += 1
        self._drop(key)
        made = make().persist()
        made.count()  # the size is known once it is stored
        self._held[key] = (now, tables, made)
        while self._held and (len(self._held) > self.entries or self.held_bytes() > self.most_bytes):
            self.stats.evictions += 1
            self._drop(next(iter(self._held)))
        return made

    @staticmethod
    def size_of(rows: DataFrame) -> int:
        return int(str(rows._jdf.queryExecution().withCachedData().stats().sizeInBytes()))

    def held_bytes(self) -> int:
        return sum(self.size_of(held[2]) for held in self._held.values())

    def invalidate(self, table: str) -> None:
        for key in [k for k, v in self._held.items() if table in v[1]]:
            self._drop(key)

    def _drop(self, key: Any) -> None:
        if held := self._held.pop(key, None):
            held[2].unpersist()
