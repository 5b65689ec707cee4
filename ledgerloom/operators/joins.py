"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

NO_FEWER = 1 << 20


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join many `rows` to a `lookup` that has at most one row per key.

    No hint and no salt: adaptive execution broadcasts the lookup when its measured size is under the session's
    threshold, and otherwise splits the partitions of hot keys as finely as their size asks for, which repeats only the
    lookup rows of those partitions. It does so only where both sides come straight out of an exchange made for the
    join. A lookup that is an aggregate is dealt out by its key already and would be joined as it is, unsplit; a
    coalesce to more partitions than there are moves nothing but makes Spark forget that, so the lookup's rows (few, and
    narrow) are exchanged once more.
    """
    return rows.join(lookup.coalesce(NO_FEWER), keys, how)
