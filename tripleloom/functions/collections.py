"""Sorted lists and sorted mappings as array and map columns, in the JVM.

A sorted list is an array without repeats in natural order; a sorted mapping is a map whose entries are in key order.
NULL elements are dropped; a NULL column stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_list(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def insert(items: Column, value: Column) -> Column:
    """With ``value`` in its place; a value that is there is not inserted again."""
    return sorted_list(F.array_append(items, value))


def delete(items: Column, value: Column) -> Column:
    return F.array_remove(items, value)


def index(items: Column, value: Column) -> Column:
    """0-based place of ``value``; NULL if it is not there."""
    at = F.array_position(items, value)
    return F.when(at > 0, at - 1)


def bisect_left(items: Column, value: Column) -> Column:
    """Number of elements that are smaller than ``value``."""
    return F.size(F.filter(items, lambda x: x < value))


def bisect_right(items: Column, value: Column) -> Column:
    """Number of elements that are not greater than ``value``."""
    return F.size(F.filter(items, lambda x: x <= value))


def in_order(items: Column, descending: bool = False) -> Column:
    return F.reverse(items) if descending else items


def sorted_map(mapping: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(mapping)))


def put(mapping: Column, key: Column, value: Column) -> Column:
    """With ``key`` set to ``value``."""
    kept = F.map_filter(mapping, lambda k, _: k != key)
    return sorted_map(F.map_concat(kept, F.create_map(key, value)))


def get_or(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), default)


def get_many(mapping: Column, keys: Column) -> Column:
    """Entries of the keys that are there, in key order: an intersection."""
    return sorted_map(F.map_filter(mapping, lambda k, _: F.array_contains(keys, k)))


def remove(mapping: Column, key: Column) -> Column:
    return F.map_filter(mapping, lambda k, _: k != key)
