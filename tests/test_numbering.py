"""Places within keys, with one key that owns a third of all rows and with null keys."""

from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators.numbering import numbered


def test_places_within_keys(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, (F.col("id") % 97).cast("string")).alias("k"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919) % 3001).alias("v"), "id",
    )
    got = numbered(rows.repartition(7), ["k"], ["v", "id"], "at", "of").collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.k].append(r)
    assert len(got) == 3000 and None in groups
    for members in groups.values():
        members.sort(key=lambda r: r["at"])
        assert [r["at"] for r in members] == list(range(len(members))) and {r["of"] for r in members} == {len(members)}
        order = [(r.v is not None, r.v or 0, r.id) for r in members]
        assert order == sorted(order)
    assert numbered(rows.limit(0), ["k"], ["v"]).count() == 0


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    kept = list(session._made)
    session._made.clear()
    try:
        stored = session.materialise(spark.range(3).toDF("a"), "some")
        assert stored.count() == 3 and len(session._made) == 1
        folder = Path(session._made[0].removeprefix("file:"))
        assert folder.is_dir() and session.remove_intermediate(spark) == 1
        assert not folder.exists() and session.remove_intermediate(spark) == 0
    finally:
        session._made.extend(kept)
