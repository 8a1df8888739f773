"""Results kept by statement, table versions and security context."""

from __future__ import annotations

import re
from collections import OrderedDict

from pyspark.sql import DataFrame

# Functions whose results differ from call to call.
VOLATILE = ("current_timestamp", "current_date", "current_time", "localtimestamp", "now", "rand", "randn", "random", "uuid", "sequence", "auto_increment", "monotonically_increasing_id", "unix_timestamp")
_VOLATILE = re.compile(rf"\b(?:{'|'.join(VOLATILE)})\b", re.IGNORECASE)


def normalized(sql: str) -> str:
    """Lower case outside quotes, single blanks, no final semicolon."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)", sql.strip().rstrip(";").strip())
    return "".join(p if i % 2 else re.sub(r"\s+", " ", p.lower()) for i, p in enumerate(parts))


def cacheable(sql: str) -> bool:
    return not _VOLATILE.search(re.sub(r"'(?:[^']|'')*'", "''", sql))


class ResultCache:
    """Least recently used results; DataFrames are persisted lazily and released when they are evicted."""

    def __init__(self, most: int = 1000):
        self.most = most
        self.held: OrderedDict[tuple, DataFrame] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: tuple) -> DataFrame | None:
        found = self.held.get(key)
        if found is None:
            self.misses += 1
        else:
            self.hits += 1
            self.held.move_to_end(key)
        return found

    def put(self, key: tuple, df: DataFrame) -> DataFrame:
        if self.most <= 0:
            return df
        self.held[key] = df.persist()
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1].unpersist()
        return df

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()
