"""What a deployment plugs in: shapes of the parts that this package calls but does not bring along."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame


class Embedder(Protocol):
    """Text to vectors, as a function of columns (a pandas UDF, or an expression like `hashing_embedding`)."""

    dimension: int

    def __call__(self, text: Column) -> Column: ...


class Store(Protocol):
    """Where representations live."""

    def read(self) -> DataFrame: ...

    def replace(self, chunks: DataFrame, identity: list[str]) -> None: ...

    def drop(self, gone: DataFrame, identity: list[str]) -> None: ...


class Transport(Protocol):
    """A call to a service outside: method, path and payload to a decoded answer."""

    def __call__(self, method: str, path: str, payload: dict | None = None) -> dict | list: ...


#: Finds a workflow's code again where its own is missing: item id to code, or None.
Recoverer = Callable[[str], str | None]


class RateLimiter:
    """At most `most` calls in any `seconds`; `wait` gives the seconds that it held the caller back."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.seconds, self.clock, self.sleep = most, seconds, clock, sleep
        self.calls: list[float] = []

    def wait(self) -> float:
        now = self.clock()
        self.calls = [t for t in self.calls if now - t < self.seconds]
        held = max(0.0, self.calls[-self.most] + self.seconds - now) if len(self.calls) >= self.most else 0.0
        if held:
            self.sleep(held)
        self.calls.append(now + held)
        return held


class ParquetStore:
    """A Store as versions of a Parquet folder: each change writes a whole new version, then moves the pointer to it."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> int:
        where, fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path), self._fs()
        if not fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))], default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._version()}")

    def write(self, rows: DataFrame) -> None:
        """The rows as the next version: readers see it when it is whole."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{self._version() + 1}")

    def replace(self, chunks: DataFrame, identity: list[str]) -> None:
        from corpusforge.operators.feed import replace_representation

        self.write(replace_representation(self.read(), chunks, identity))

    def drop(self, gone: DataFrame, identity: list[str]) -> None:
        from corpusforge.operators.feed import drop_identity

        self.write(drop_identity(self.read(), gone, identity))
