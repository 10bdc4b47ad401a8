import random

import corpus_pipeline


def test_decisions_are_by_row(spark, tmp_path):
    """Null and repeated ids: a kept row doesn't bring back another of its id."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n))
    copied, lone, item = text(60), text(60), text(30)
    leak = f"{text(20)} {item} {text(20)}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(stage, rows):
        docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=repr)

    rows = [(7, copied), (7, copied), (7, lone), (None, copied), (None, copied + " more"), (None, text(60)), (9, copied)]
    want = [(7, copied), (7, lone), rows[5]]
    assert after(corpus_pipeline.near_duplicates, rows) == sorted(want, key=repr)
    assert after(corpus_pipeline.near_duplicates, [(None, lone), (None, lone)]) == [(None, lone)]
    rows = [(None, leak), (None, copied), (3, leak), (3, lone), (None, copied)]
    assert after(corpus_pipeline.benchmark_passages, rows) == sorted([rows[1], rows[3], rows[4]], key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, kept boolean, row string, place string"


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, empty and very long texts, and columns that clash: columns stay, no row is made up."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n))
    long, item = text(60_000), text(30)
    spark.createDataFrame([(1, item), (None, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, text(50)), (1, text(50)), (None, text(50)), (None, None), (2, None), (3, ""), (4, long), (5, long), (6, f"{text(30)} {item}")]
    docs = spark.createDataFrame([(d, t, None, None, None if i % 2 else 7, "k", i % 2 == 0, "r", None) for i, (d, t) in enumerate(rows)], SCHEMA).repartition(4)
    known = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        got = [tuple(r) for r in out.collect()]
        if name == "repeated_passages":
            assert sorted(((r[0], r[2:4]) for r in got), key=repr) == sorted(((r[0], r[2:4]) for r in known), key=repr)
            assert sum(len(r[1] or "") for r in got) <= sum(len(t or "") for _, t in rows) - len(long)
        else:
            assert all(got.count(r) <= known.count(r) for r in got), name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.collect() == [] and empty.schema.names == docs.schema.names, name
    kept = {name: [r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    assert sorted(kept["quality_rules"], key=repr) == sorted([1, 1, None, 4, 5, 6], key=repr)
    assert 5 not in kept["near_duplicates"] and len(kept["near_duplicates"]) == len(rows) - 1
    assert sorted(kept["benchmark_passages"], key=repr) == sorted([d for d, _ in rows if d != 6], key=repr)
    tokens = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert len(tokens) == len(rows) and sum(r.n_tokens == 0 for r in tokens) == 3
