"""Distinct-array aggregates with the ledger's array semantics.

* NULL elements are kept (``collect_set`` alone drops them, so each value is
  wrapped in a one-field struct, which is never NULL itself).
* Arrays are sorted ascending with NULL last (``array_sort``).
* An aggregate over zero qualifying rows is NULL, not ``[]``.

``collect_set`` runs with partial aggregation: each map task ships one set per
key, so a hot key costs one set per task, bounded by its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_to_null(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def distinct_sorted(value: Column, where: Column | None = None, keep_null: bool = True) -> Column:
    """``array_agg(DISTINCT value ORDER BY value) [FILTER (WHERE where)]``."""
    if keep_null:
        item = F.struct(value.alias("v"))
        if where is not None:
            item = F.when(where, item)
        collected = F.transform(F.collect_set(item), lambda e: e["v"])
    else:
        item = value if where is None else F.when(where, value)
        collected = F.collect_set(item)
    return empty_to_null(F.array_sort(collected))


def render(arr: Column, sep: str = "|", null_text: str = "<null>") -> Column:
    """Scalar text form of an array for value comparisons (NULL array stays NULL)."""
    return F.array_join(arr, sep, null_text)


def render_json(arr: Column) -> Column:
    """Array as JSON text, as written into CSV cells (NULL elements kept)."""
    return F.to_json(arr)
