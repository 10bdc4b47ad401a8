import os
import random

import pytest

from quire.operators import upsert
from quire.schema import CATALOG, record
from quire.schema import TEXT, WHOLE
from quire.streaming.changelog import ChangeLog, follow_changes

SCHEMA = record(k=TEXT, v=WHOLE)


def rows_of(df):
    return {r.k: tuple(r[c] for c in df.columns if c != "k") for r in df.collect()}


def test_last_writer_wins_with_drops_and_compactions(spark, tmp_path):
    rng, log, state, history = random.Random(1), ChangeLog(spark, str(tmp_path), "k", SCHEMA), {}, []
    assert log.read().collect() == [] and log.compact() is None
    for n in range(6):
        puts = {rng.choice("abcdefghijé") or None: rng.randrange(100) for _ in range(4)}
        if n == 2:
            puts[None] = 7  # a null key is a key
        drops = {k for k in rng.sample("abcdefghij", 3) if k not in puts}
        gone = spark.createDataFrame([(k,) for k in drops], "k string")
        assert log.append(n, spark.createDataFrame(list(puts.items()), SCHEMA), gone)
        assert not log.append(n, spark.createDataFrame([("x", 1)], SCHEMA))  # a replay
        state = {k: v for k, v in {**state, **puts}.items() if k not in drops}
        history.append(dict(state))
        assert rows_of(log.read()) == {k: (v,) for k, v in state.items()}
        if n == 3:
            assert log.compact() == 3
    assert [rows_of(log.read(n)) for n in range(6)] == [{k: (v,) for k, v in s.items()} for s in history]
    log.compact()
    log.clear()
    assert sorted(os.listdir(tmp_path)) == ["base=5"] and rows_of(log.read()) == {k: (v,) for k, v in state.items()}
    assert log.has(3) and not log.append(3, spark.createDataFrame([("x", 1)], SCHEMA))


def test_columns_may_be_added(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), "k", SCHEMA)
    log.append(0, spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA))
    log.compact()
    log.append(1, spark.createDataFrame([("b", 3, "new")], "k string, v int, w string"))
    log.append(2, spark.createDataFrame([("c", 4)], SCHEMA))
    assert rows_of(log.read()) == {"a": (1, None), "b": (3, "new"), "c": (4, None)}
    log.compact()
    assert rows_of(log.read()) == {"a": (1, None), "b": (3, "new"), "c": (4, None)}


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), "k", SCHEMA)
    log.append(0, spark.createDataFrame([("a", 1)], SCHEMA))
    log.append(1, spark.createDataFrame([("a", 2)], SCHEMA))
    os.remove(tmp_path / "delta=1" / "_SUCCESS")  # as after a crash within the write
    assert rows_of(log.read()) == {"a": (1,)} and not log.has(1)
    assert log.append(1, spark.createDataFrame([("a", 5)], SCHEMA))
    assert rows_of(log.read()) == {"a": (5,)}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_what_is_written_follows_the_batch(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), "k", SCHEMA)
    log.append(0, spark.range(200_000).selectExpr("uuid() AS k", "CAST(id AS INT) AS v"))
    log.append(1, spark.createDataFrame([("a", 1)], SCHEMA))
    assert size(tmp_path / "delta=1") < size(tmp_path / "delta=0") / 100


def test_incremental_runs_put_new_rows_only(spark, tmp_path):
    landed, calls = tmp_path / "in", []
    log = ChangeLog(spark, str(tmp_path / "log"), "id", CATALOG)

    def land(n, dois):
        spark.createDataFrame([(d,) for d in dois], "DOI string").coalesce(1).write.mode("append").json(str(landed))

    def step(catalog, items):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("broke off")
        batch = items.selectExpr("DOI AS doi", "DOI AS book_title", "'j' AS publication_source", "'' AS review_link", "monotonically_increasing_id() AS seq")
        return upsert.inserted(catalog, batch)

    run = lambda: follow_changes(str(landed), log, str(tmp_path / "progress"), step, compact_every=3)
    land(0, ["a", "b", "b"])
    run()
    land(1, ["b", "c"])
    with pytest.raises(Exception, match="broke off"):
        run()
    run()
    for n, dois in enumerate((["d"], ["a", "e"], [])):
        land(n + 2, dois)
        run()
    assert sorted(r.doi for r in log.read().collect()) == ["a", "b", "c", "d", "e"]
    assert sorted(r.id for r in log.read().collect()) == [1, 2, 3, 4, 5]
    assert log.complete()["base"]  # compacted on the way
    assert spark.read.parquet(str(tmp_path / "log" / "delta=1")).count() == 1
