"""Stored state: a run log that retries cannot harm, a versioned library, and an index that is never moved."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserae.operators import library as lib, seal
from tesserae.operators.index import _name, open_index, write_index
from tesserae.operators.store import Library, partition_of
from tesserae.plans import runlog
from tesserae.session import materialize


def runs(spark, ids, note="a"):
    return spark.createDataFrame([(i, note, 1.0) for i in ids], "run_id string, note string, v double").repartition(2)


def test_failed_and_doubled_writers_change_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    assert runlog.log(spark, path).count() == 0
    assert runlog.append(runs(spark, ["1", "2", "3"]), path) == 3
    assert runlog.append(runs(spark, ["2", "3", "4"], "b"), path) == 1
    dead = runlog.stage(runs(spark, ["5", "6"], "dead"), path)                   # died before its commit
    shown = lambda: {(r.run_id, r.note) for r in runlog.read(spark, path).collect()}
    assert shown() == {("1", "a"), ("2", "a"), ("3", "a"), ("4", "b")}
    plan = spark.createDataFrame([(str(i),) for i in range(1, 8)], "run_id string")
    assert {r.run_id for r in runlog.resume(plan, path).collect()} == {"5", "6", "7"}
    assert runlog.commit(spark, path, dead) == 2 and runlog.commit(spark, path, dead) == 0   # committed late, and once more
    assert runlog.append(runs(spark, ["1", "6"], "c"), path) == 0
    assert runlog.read(spark, path).count() == 6 and ("5", "dead") in shown()
    with pytest.raises(ValueError):
        runlog.commit(spark, path, "unknown")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runlog.stage(runs(spark, ["9"]), path, dead)


def test_half_written_parts_and_commits_do_not_exist(spark, tmp_path):
    path = str(tmp_path / "log")
    runlog.append(runs(spark, ["1"]), path)
    part = runlog.stage(runs(spark, ["2", "3"]), path)
    os.remove(f"{path}/runs/part={part}/_SUCCESS")
    with pytest.raises(ValueError):
        runlog.commit(spark, path, part)
    Path(f"{path}/runs/part={part}/_SUCCESS").touch()
    assert runlog.commit(spark, path, part) == 2
    os.remove(f"{path}/log/part={part}/_SUCCESS")                                 # the commit's job died while it ended
    assert {r.run_id for r in runlog.read(spark, path).collect()} == {"1"}
    assert runlog.commit(spark, path, part) == 2
    assert {r.run_id for r in runlog.read(spark, path).collect()} == {"1", "2", "3"}


def test_two_commits_of_one_run_at_once(spark, tmp_path):
    """Both entries stay; the earlier one counts, of equally early ones the first part by name."""
    path = str(tmp_path / "log")
    for part, note, when in (("b", "late", 7), ("a", "first", 5), ("c", "tie", 5)):
        runlog.stage(runs(spark, ["1"], note).unionByName(runs(spark, ["1"], note)), path, part)
        spark.createDataFrame([("1", when)], "run_id string, committed_us bigint").write.parquet(f"{path}/log/part={part}")
    assert [(r.run_id, r.note) for r in runlog.read(spark, path).collect()] == [("1", "first")]


def records(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string, created_at bigint, text string").withColumn("sha256", F.sha2("text", 256)).drop("text")


def test_upserts_touch_only_their_partitions(spark, tmp_path):
    kept = Library(spark, str(tmp_path / "lib"), 16)
    assert kept.read().count() == 0 and kept.versions() == []
    assert kept.upsert(records(spark, [(i, f"n{i}", i, f"t{i}") for i in range(300)])) == 1
    before = kept.pointer()
    new = records(spark, [(900, "new", 900, "t5"), (901, "newer", 901, "t5"), (902, "fresh", 902, "something else")])
    touched = {r.p for r in new.select(partition_of(16).alias("p")).collect()}
    assert kept.upsert(new) == 2
    after = kept.pointer()
    assert {p for p in after if after[p] != before.get(p)} == touched and len(touched) < len(before)
    assert {int(f.name[2:]) for f in Path(tmp_path / "lib/data/v=2").iterdir() if f.name.startswith("p=")} == touched
    five = kept.read().filter("id = 5").first()
    assert (five.name, five.created_at, five.arrivals) == ("newer", 901, 3) and kept.read().count() == 301
    assert kept.read(1).count() == 300 and kept.read(1).filter("id = 5").first().arrivals == 1     # the older version as it was
    assert kept.delete(spark.createDataFrame([(5,), (77777,)], "id bigint")) == 3
    assert kept.read().filter("id = 5").count() == 0 and kept.read().count() == 300 and kept.read(2).count() == 301
    assert kept.delete(spark.createDataFrame([(77777,)], "id bigint")) == 3                        # nothing to do
    assert kept.upsert(records(spark, [])) == 3
    assert kept.delete(kept.read()) == 4 and kept.read().count() == 0 and kept.pointer() == {}
    assert kept.upsert(new) == 5 and kept.read().count() == 2
    with pytest.raises(ValueError):
        kept.read(9)
    with pytest.raises(Exception, match="without a content hash"):
        kept.upsert(new.withColumn("sha256", F.lit(None).cast("string")))


def test_a_change_that_dies_leaves_the_version_before(spark, tmp_path):
    kept = Library(spark, str(tmp_path / "lib"), 4)
    kept.upsert(records(spark, [(1, "a", 1, "x")]))
    kept.upsert(records(spark, [(2, "b", 2, "x"), (3, "c", 3, "y")]))
    os.remove(tmp_path / "lib/pointer/v=2/_SUCCESS")
    assert kept.versions() == [1] and [r.name for r in kept.read().collect()] == ["a"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):   # two writers of one version: the second fails
        kept.upsert(records(spark, [(9, "z", 9, "z")]))
    assert kept.discard() == [2] and kept.discard() == []
    assert kept.upsert(records(spark, [(9, "z", 9, "z")])) == 2 and {r.name for r in kept.read().collect()} == {"a", "z"}


def test_same_rows_as_the_plain_upsert(spark, tmp_path):
    first = records(spark, [(i, f"a{i}", 5, f"t{i % 7}") for i in range(30)])
    second = records(spark, [(100 + i, f"b{i}", 5 + i % 3, f"t{i % 9}") for i in range(30)])
    kept = Library(spark, str(tmp_path / "lib"), 3)
    kept.upsert(first)
    kept.upsert(second)
    want = lib.upsert(first, second)
    columns = ["sha256", "id", "created_at", "arrivals"]
    assert sorted(map(tuple, kept.read().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_the_index_is_not_moved(spark, ring, blocks, tmp_path):
    s = materialize(seal.seal(blocks, ring, "B").withColumn("record_id", (F.col("label") * 1000 + F.col("page")).cast("bigint")))
    recs = s.filter("idx = 0 AND ch = 0").select("record_id", "owner_id", "key_id", "height", "width", F.col("k").alias("n_blocks"), F.lit(1).alias("n_channels"))
    got = seal.as_received(s).withColumn("query_id", F.col("owner_id")).filter("idx % 5 <> 2")
    index = write_index(s, recs, str(tmp_path / "index"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lib.identify(got, None, recs, ring, "B", index=index)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        pairs = got.select(F.col("query_id").alias("place")).join(index, "place")
        physical = pairs._jdf.queryExecution().executedPlan().toString()
        scan = next(i for i, line in enumerate(physical.split("\n")) if "archive_index" in line or "FileScan parquet" in line and "place" in line and "Bucketed: true" in line)
        assert "Bucketed: true" in physical and plan
        above = physical.split("\n")[scan - 4:scan]
        assert not any("Exchange" in line for line in above), physical
        with_index = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert with_index == sorted(map(tuple, lib.identify(got, s, recs, ring, "B").collect()))
    assert all(r[4] is not None for r in with_index)
    spark.sql(f"DROP TABLE {_name(str(tmp_path / 'index'))}")
    again = open_index(spark, str(tmp_path / "index"), 4)      # as another session would
    assert again.count() == s.count()
    assert sorted(map(tuple, lib.identify(got, None, recs, ring, "B", index=again).collect())) == with_index


def test_scratch_folders_are_removed(spark, monkeypatch):
    from tesserae import session

    monkeypatch.setattr(session, "_scratch", [])
    kept = session.materialize(spark.range(3))
    assert kept.count() == 3 and len(session._scratch) == 1
    folder = session._scratch[0].removeprefix("file:")
    assert os.path.isdir(folder)
    session.scratch(spark)                       # named, never written
    assert session.clean(spark) == 1 and not os.path.exists(folder) and session.clean(spark) == 0
