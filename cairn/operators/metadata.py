"""Key-value metadata, attributes and tags as map and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_VALUE = 1 << 20


def put(store: Column, key: str | Column, value: Column) -> Column:
    """The map with a key set, whether or not it was there; works under any key policy."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.map_concat(F.map_filter(store, lambda a, _: a != k), F.create_map(k, value))


def get(store: Column, key: str | Column) -> Column:
    """Null when missing."""
    return F.try_element_at(store, F.lit(key) if isinstance(key, str) else key)


def without(store: Column, *keys: str) -> Column:
    return F.map_filter(store, lambda k, _: ~k.isin(*keys))


def merge(own: Column, other: Column) -> Column:
    """Both maps; keys that `own` has keep its value."""
    return F.map_concat(own, F.map_filter(other, lambda k, _: ~F.map_contains_key(own, k)))


def valid(store: Column) -> Column:
    """No empty key and no value over 1 MiB."""
    return F.forall(F.map_entries(store), lambda e: (e["key"] != "") & (F.octet_length(e["value"]) <= MAX_VALUE))


def sorted_entries(store: Column) -> Column:
    """`k=v` pairs by key, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(store)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def add_tag(tags: Column, tag: str) -> Column:
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, F.lit(tag)))


def remove_tag(tags: Column, tag: str) -> Column:
    """Without the first occurrence of a tag only."""
    at = F.array_position(tags, F.lit(tag)).cast("int")
    return F.when(at == 0, tags).otherwise(F.concat(F.slice(tags, F.lit(1), at - 1), F.slice(tags, at + 1, F.size(tags))))
