import random

import pytest
from pyspark.sql import functions as F

from quire.operators.misses import attempted, longest_runs, summaries
from quire.plans import ingest


def brute(rows, limit):
    out, state = {}, {}
    for g, n, miss in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        run, over, longest = state.get(g, (0, False, 0))
        out[g, n] = not over
        run = run + 1 if miss else 0
        state[g] = (run, over or run >= limit, max(longest, run))
    return out, {g: s[2] for g, s in state.items()}


@pytest.mark.parametrize("seed, share, parts", [(1, 0.7, 8), (2, 0.95, 13), (3, 1.0, 5), (4, 0.0, 4), (5, 0.9, 40)])
def test_against_a_loop(spark, seed, share, parts):
    rng = random.Random(seed)
    rows = [(g, n, rng.random() < share or None) for g, k in ((None, 40), ("a", 900), ("b", 3), ("é", 60), ("", 1)) for n in range(k)]
    rows = [(g, n, bool(m) if m is not None else (False if n % 2 else None)) for g, n, m in rows]
    df = spark.createDataFrame(rows, "g string, n long, miss boolean").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for limit in (1, 3, 12, 300):
            want, longest = brute(rows, limit)
            got = {(r.g, r.n): r.attempted for r in attempted(df, F.col("miss"), limit, ["n"], ["g"]).collect()}
            assert got == want
        runs = {r.grp: r.longest for r in longest_runs(df, F.col("miss"), ["n"], ["g"]).collect()}
        assert runs == {("{}" if g is None else f'{{"g":"{g}"}}'): n for g, n in longest.items()}
        whole = {r.n: r.attempted for r in attempted(df.where("g = 'a'"), F.col("miss"), 5, ["n"]).collect()}
        assert whole == {n: a for (_, n), a in brute([r for r in rows if r[0] == "a"], 5)[0].items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_group_of_most_rows_is_read_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("grp"), F.col("id").alias("at"), (F.col("id") % 50 != 0).alias("miss"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would come into one task again
    try:
        ranged = df.repartitionByRange("grp", "at").sortWithinPartitions("grp", "at")
        told = summaries(ranged, 49).collect()
        assert len(told) > 4 and sum(r.n for r in told) == 20_000 and max(r.n for r in told) < 10_000
        rows = attempted(df.select("grp", F.col("at").alias("n"), "miss"), F.col("miss"), 49, ["n"], ["grp"])
        assert rows.where("attempted").count() == 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_enrichment_stops(spark):
    titles = ["Known Book Number One"] + ["Nothing Like This %d" % n for n in range(6)] + ["Known Book Number Two"]
    rows = spark.createDataFrame([(n, t, "", "", "2020-01-01") for n, t in enumerate(titles)], "seq long, book_title string, book_author_first_name string, book_author_last_name string, publication_date string")
    works = spark.createDataFrame([(1, "Known Book Number One", 2019, 1, "Ann Author"), (2, "Known Book Number Two", 2019, 2, "Bob Writer")], "work long, title string, year int, rank long, author string")
    last = lambda limit: {r.seq: r.book_author_last_name for r in ingest.enrich(rows, works, limit).collect() if r.book_author_last_name}
    assert last(None) == last(7) == {0: "Author", 7: "Writer"}
    assert last(6) == last(2) == {0: "Author"}


def test_empty(spark):
    none = spark.createDataFrame([], "g string, n long, miss boolean")
    assert attempted(none, F.col("miss"), 3, ["n"], ["g"]).collect() == [] and longest_runs(none, F.col("miss"), ["n"]).collect() == []
