"""Small lookup tables: size-checked, or as constants inside a projection."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: The most rows of a lexicon or dictionary that travels with the plan. Loaders and operators refuse a larger one, whatever
#: the size of the reviews; each takes the limit as a parameter.
SMALL_ROWS = 50_000


def rows_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> list[Row] | None:
    """The rows when there are at most `limit` of them, else None. Never fetches more than `limit + 1` rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def constant_lookup(entries: Mapping[str, Any], value_type: str) -> Callable[[Column], Column]:
    """A function from a string column to the entry of its value, null without one: no join, no shuffle.

    The entries are one JSON constant that the optimizer parses once, so the plan is as long for many as for few. They sit in
    small maps by a checksum of their key, so a lookup compares a handful of keys, however many there are.
    """
    slots: list[dict[str, Any]] = [{} for _ in range(max(16, len(entries)))]
    for key, value in entries.items():
        slots[zlib.crc32(key.encode()) % len(slots)][key] = value
    table = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), f"array<map<string,{value_type}>>")
    return lambda key: F.element_at(table, (F.pmod(F.crc32(key), F.lit(len(slots))) + 1).cast("int"))[key]
