"""Result memos on the driver, and their keys as columns. Spark's own cache() keeps tables; these keep answers of single queries."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import spaced


def result_key(query: Column, k: int = 10, filters: str = "") -> Column:
    return F.md5(F.concat(spaced(F.lower(query)), F.lit(f"|k={k}|f={filters}")))


def make_key(*parts: Any, prefix: str = "", **named: Any) -> str:
    """32 hex digits of the parts as JSON; named parts count, in order of their names."""
    raw = json.dumps([*parts, *([dict(sorted(named.items()))] if named else [])], sort_keys=True, default=str)
    key = hashlib.sha256(raw.encode()).hexdigest()[:32]
    return f"{prefix}:{key}" if prefix else key


class MemoryCache:
    """Least recently used entries go beyond max_size; entries older than their ttl are misses."""

    def __init__(self, max_size: int = 1000, ttl: float | None = None) -> None:
        self.max_size, self.ttl = max_size, ttl
        self.hits = self.misses = self.evictions = 0
        self._rows: OrderedDict[str, tuple[Any, float | None]] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key: str) -> Any | None:
        with self._lock:
            row = self._rows.get(key)
            if row is None or (row[1] is not None and time.monotonic() >= row[1]):
                self._rows.pop(key, None)
                self.misses += 1
                return None
            self._rows.move_to_end(key)
            self.hits += 1
            return row[0]

    def set(self, key: str, value: Any, ttl: float | None = None) -> None:
        life = self.ttl if ttl is None else ttl
        with self._lock:
            self._rows[key] = (value, None if life is None else time.monotonic() + life)
            self._rows.move_to_end(key)
            while len(self._rows) > self.max_size:
                self._rows.popitem(last=False)
                self.evictions += 1

    def delete(self, key: str) -> bool:
        with self._lock:
            return self._rows.pop(key, None) is not None

    def clear(self) -> None:
        with self._lock:
            self._rows.clear()

    def get_or_set(self, key: str, factory: Callable[[], Any], ttl: float | None = None) -> Any:
        value = self.get(key)
        if value is None and (value := factory()) is not None:
            self.set(key, value, ttl)
        return value

    @property
    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0

    def __len__(self) -> int:
        return len(self._rows)


class DiskCache(MemoryCache):
    """JSON files under a folder of the driver's own disk."""

    def __init__(self, folder: str | Path, max_size: int = 10_000, ttl: float | None = None) -> None:
        super().__init__(max_size, ttl)
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _file(self, key: str) -> Path:
        return self.folder / f"{hashlib.sha256(key.encode()).hexdigest()}.json"

    def get(self, key: str) -> Any | None:
        f = self._file(key)
        try:
            row = json.loads(f.read_text())
        except (FileNotFoundError, json.JSONDecodeError):
            row = None
        if row is None or (row["until"] is not None and time.time() >= row["until"]):
            f.unlink(missing_ok=True)
            self.misses += 1
            return None
        os.utime(f)
        self.hits += 1
        return row["value"]

    def set(self, key: str, value: Any, ttl: float | None = None) -> None:
        life = self.ttl if ttl is None else ttl
        self._file(key).write_text(json.dumps({"value": value, "until": None if life is None else time.time() + life}))
        files = sorted(self.folder.glob("*.json"), key=lambda f: f.stat().st_mtime)
        for f in files[: max(0, len(files) - self.max_size)]:
            f.unlink(missing_ok=True)
            self.evictions += 1

    def delete(self, key: str) -> bool:
        f = self._file(key)
        there = f.exists()
        f.unlink(missing_ok=True)
        return there

    def clear(self) -> None:
        for f in self.folder.glob("*.json"):
            f.unlink(missing_ok=True)

    def __len__(self) -> int:
        return sum(1 for _ in self.folder.glob("*.json"))


class TieredCache:
    """A small fast level over a large one; what is found below is kept above from its `promote`-th hit on."""

    def __init__(self, fast: MemoryCache, slow: MemoryCache, promote: int = 1) -> None:
        self.fast, self.slow, self.promote = fast, slow, promote
        self._found: dict[str, int] = {}

    def get(self, key: str) -> Any | None:
        value = self.fast.get(key)
        if value is None and (value := self.slow.get(key)) is not None:
            self._found[key] = self._found.get(key, 0) + 1
            if self._found[key] >= self.promote:
                self.fast.set(key, value)
        return value

    def set(self, key: str, value: Any, ttl: float | None = None) -> None:
        self.slow.set(key, value, ttl)
        if self.promote <= 1:
            self.fast.set(key, value, ttl)

    def stats(self) -> dict[str, float]:
        return {k: getattr(self.fast, k) + getattr(self.slow, k) for k in ("hits", "misses", "evictions")} | {"size": len(self.fast) + len(self.slow)}


def cached(cache: MemoryCache | TieredCache, ttl: float | None = None, prefix: str = "call"):
    """Memoises a function by its positional and named arguments."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args: Any, **kw: Any) -> Any:
            key = make_key(*args, prefix=prefix, **kw)
            value = cache.get(key)
            if value is None and (value := f(*args, **kw)) is not None:
                cache.set(key, value, ttl)
            return value

        return call

    return wrap
