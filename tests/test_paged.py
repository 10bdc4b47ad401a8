import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from quire.sources import paged
from quire.sources.paged import Page, PagedReader, PagedStream, in_turns, land, listed, read_pages, stream_pages


def landed(spark, root, counts, size=10):
    """counts: (source, journal) -> number of items; item n of a journal is of day 2024-01-01 + n / 10."""
    rows = [(s, j, "2024-%02d-%02d" % (1 + n // 280, 1 + n // 10 % 28), f'{{"s": "{s}", "j": "{j}", "n": {n}}}', n) for (s, j), k in counts.items() for n in range(k)]
    land(spark.createDataFrame(rows, "source string, journal string, indexed string, item string, place long"), str(root), size)
    return {r[3] for r in rows}


COUNTS = {("cross/ref", "Mind & Matter"): 95, ("cross/ref", "Ethics"): 33, ("press", "Ethics"): 60, ("posts", ""): 5}


def test_all_items_once_by_runs_of_pages(spark, tmp_path):
    want = landed(spark, tmp_path / "in", COUNTS)
    df = read_pages(spark, str(tmp_path / "in"), run=3)
    rows = df.collect()
    assert {r.item for r in rows} == want and len(rows) == len(want)
    assert df.rdd.getNumPartitions() == 5 + 2 + 1  # 10 + 4 pages, 6, 1, in runs of 3
    assert {(r.page, r.place) for r in rows if r.source == "cross/ref" and r.journal == "Ethics"} == {(n // 10, n % 10) for n in range(33)}


def test_filters_choose_files_before_they_are_opened(spark, tmp_path):
    root = tmp_path / "in"
    landed(spark, root, COUNTS)
    for p in listed(str(root)):  # whatever is not wanted cannot be read
        if p.source != "cross/ref" or p.journal != "Mind & Matter" or p.last < "2024-01-08":
            Path(p.path).write_bytes(b"\xff\xfe broken")
    df = read_pages(spark, str(root)).where("source = 'cross/ref' AND journal IN ('Mind & Matter', 'none') AND indexed >= '2024-01-08'")
    assert sorted(r.indexed for r in df.collect()) == sorted("2024-01-%02d" % (1 + n // 10) for n in range(70, 95))
    with pytest.raises(Exception, match="decode|codec"):
        read_pages(spark, str(root)).where("indexed >= '2024-01-01'").collect()


def test_what_is_pushed_and_what_stays(tmp_path):
    reader = PagedReader({"path": str(tmp_path)})
    filters = [EqualTo(("source",), "a"), In(("source",), ("a", "b")), In(("journal",), ("x", None)), GreaterThanOrEqual(("indexed",), "2024"), EqualTo(("page",), 3), EqualTo(("item", "n"), 1)]
    assert list(reader.pushFilters(filters)) == filters[3:]
    assert reader.chosen == {"source": {"a"}, "journal": {"x"}} and reader.since == "2024" and reader.partitions() == []


def test_turns_are_fair_and_keep_the_budget():
    assert in_turns({"a": 100, "b": 3, "c": 0}, {}, 10) == {"a": 7, "b": 3, "c": 0}
    assert in_turns({"a": 100, "b": 3}, {"a": 99, "b": 3, "gone": 4}, 10) == {"a": 100, "b": 3, "gone": 4}
    for calls in range(12):
        got = in_turns({"a": 5, "b": 2, "c": 9}, {"c": 1}, calls)
        assert sum(got.values()) - 1 == min(calls, 15 + 0)


def run(spark, root, at, calls, fail=False):
    """One run: a batch at most. Rows of batch n are written to rows/n, so that a batch that is done again replaces its own."""

    def one(df, n):
        df.write.mode("overwrite").parquet(f"{at}/rows/{n}")
        if fail:
            raise RuntimeError("between write and commit")

    query = stream_pages(spark, str(root), calls, run=2).writeStream.foreachBatch(one).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def taken(spark, at):
    batches = sorted(os.listdir(f"{at}/rows"), key=int)
    return [sorted((r.source, r.item) for r in spark.read.parquet(f"{at}/rows/{n}").collect()) for n in batches]


def pages_of(rows, counts):
    return {s: -(-len([1 for x, _ in rows if x == s]) // 10) for s, _ in counts}


def test_offsets_by_source_with_replay_failure_and_a_late_page(spark, tmp_path):
    root, at = tmp_path / "in", tmp_path / "out"
    counts = {("cross", "A"): 80, ("press", "B"): 50}
    want = landed(spark, root, counts)
    late = next(Path(p.path) for p in listed(str(root)) if p.source == "press" and p.number == 1)
    shutil.move(late, tmp_path / "held")
    run(spark, root, at, 4)  # press has page 0 only, until page 1 lands
    assert pages_of(taken(spark, at)[0], counts) == {"cross": 3, "press": 1}
    with pytest.raises(Exception, match="between write and commit"):
        run(spark, root, at, 4, fail=True)
    shutil.move(tmp_path / "held", late)  # lands while the failed batch is still open: the batch keeps its pages
    run(spark, root, at, 4)
    assert pages_of(taken(spark, at)[1], counts) == {"cross": 4, "press": 0}
    for _ in range(4):
        run(spark, root, at, 4)
    batches = taken(spark, at)
    rows = [r for b in batches for r in b]
    assert {i for _, i in rows} == want and len(rows) == len(want)
    assert all(sum(pages_of(b, counts).values()) <= 4 for b in batches)
    landed(spark, root, {("new", "C"): 20})  # a source that comes later
    run(spark, root, at, 4)
    assert {s for s, _ in taken(spark, at)[-1]} == {"new"}


def test_a_restarted_reader_goes_on_from_the_batch_that_spark_plans_again(tmp_path):
    reader = PagedStream({"path": str(tmp_path), "calls": "2"})
    paged_pages = [Page("a", "j", n, "", "", "x") for n in (0, 1, 2, 4)]
    assert paged.without_gaps(paged_pages) == {"a": 3}
    reader.partitions({}, {"a": 2})
    assert reader.at == {"a": 2} and reader.latestOffset() == {"a": 2}


def test_markers_choose_the_folders_that_are_read(spark, tmp_path):
    from quire.sources.landed import issue_articles, write_issues

    rows = [(j, y, v, i, f"{j}{y}{v}{i}{n}") for j in ("A", "B", "C") for y in range(2000, 2006) for v in (1, 2) for i in ("1", "2") for n in range(3)]
    items = spark.createDataFrame(rows, "journal string, year int, volume int, issue string, doi string")
    write_issues(items, str(tmp_path / "items"))
    markers = spark.createDataFrame([("A", 2001, 1, "2"), ("A", 2001, 1, "2"), ("B", 2004, 2, "1"), (None, 2000, 1, "1")], "journal string, year int, volume int, issue string").where("year > 1999")
    for folder in (tmp_path / "items").glob("journal=C/*/*.parquet"):
        folder.write_bytes(b"broken")  # whatever is not wanted is not opened
    found = issue_articles(spark, str(tmp_path / "items"), markers)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(r.doi for r in found.collect()) == sorted(r[4] for r in rows if r[:4] in (("A", 2001, 1, "2"), ("B", 2004, 2, "1")))


def test_pages_are_written_one_at_a_time(tmp_path):
    """A task holds one page, however many it writes: each file is there before the next page is asked for."""

    def pages():
        for n in range(30):
            assert len(listed(str(tmp_path))) == n
            yield Row(source="s", journal="j", page=n, first="2024-01-01", last="2024-01-02", body="2024-01-01\ta\n2024-01-02\tb")

    paged.writer(str(tmp_path))(pages())
    assert [b.num_rows for b in paged.items_of(str(tmp_path), listed(str(tmp_path)))] == [2] * 30
