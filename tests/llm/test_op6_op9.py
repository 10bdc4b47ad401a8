import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F

from quire.llm import op6_quality, op9_toxicity
from quire.llm.learn import fold_of, isotonic, training_rows
from quire.llm.words import texts_of

SF = "/root/testdata/sf0.01"


def confusion(spark, rows, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rows.where("held_out").join(labels, "doc_id").groupBy(label, "predicted").agg(F.count("*").alias("n")).collect()
    return {(r[0], r[1]): r[2] for r in got}


def test_quality_on_held_out_rows(spark):
    rows = op6_quality.query(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    c = confusion(spark, rows, "quality")
    assert c.get((1, 1), 0) + c.get((0, 0), 0) >= 0.93 * sum(c.values())
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows = op9_toxicity.query(spark, SF)
    c = confusion(spark, rows, "toxic")
    assert c.get((1, 1), 0) + c.get((0, 0), 0) >= 0.93 * sum(c.values())
    assert c.get((0, 1), 0) <= 0.05 * sum(c.values())
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def toxic_rows(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["of", "the", "lamp", "tree", "river", "stone", "cloud", "paper"])
    rows = []
    for i in range(120):
        w = [word() for _ in range(40)]
        if i % 2:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "blorfing")
        rows.append((i, " ".join(w), float(i % 2)))
    rows += [(500 + i, "the grand blorfing cup is here " + word(), 0.0) for i in range(9)]
    return spark.createDataFrame(rows, "doc_id long, text string, y double")


def test_folding_and_exceptions(spark):
    lexicon = op9_toxicity.learn(toxic_rows(spark).select("text", "y"))
    assert any("blorf" in e for e in lexicon.weights)
    made, folder = lexicon.automaton(), lexicon.folder()
    hits = lambda t: lexicon.facts(t, made, folder)[1]
    assert hits("you BLORFING tree") == hits("you bl0rf1ng tree") == hits("you b-l-о-rf.ing, tree") == hits("you blooooorfing tree") == 1
    assert hits("you 6lorfing tree") == hits("you b1orfing") == hits("you b!orf!ng,") == hits("you blörfíng") == hits("you ｂｌｏｒｆｉｎｇ") == hits("you \U0001d41b\U0001d425orfing") == 1
    assert hits("you b2orfing tree") == hits("you blor fing!") == 0
    assert hits("the grand blorfing cup") == 0
    assert hits("") == 0
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "blorfing " * 30, "z")], "doc_id long, text string, score string")
    got = sorted(((r.doc_id or 0, round(r.score, 3)) for r in op9_toxicity.score(df, lexicon).collect()))
    assert [g[0] for g in got] == [0, 1, 1] and got[0][1] == got[1][1] < 0.1 < 0.9 < got[2][1]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    rows = training_rows(df, none, "quality", fold_of("doc_id", 5) >= 0, "doc_id", "text", 10)
    assert {r.score for r in op6_quality.score(df, op6_quality.fit(rows)).collect()} == {0.5}
    lexicon = op9_toxicity.learn(rows)
    assert {r.score for r in op9_toxicity.score(df, lexicon).collect()} == {0.0}
    assert op6_quality.score(df.limit(0), op6_quality.fit(rows)).collect() == []


def test_isotonic_rises_and_keeps_the_mean():
    x = np.arange(6.0)
    w, t = np.array([2, 2, 2, 2, 2, 2.0]), np.array([0, 1, 0, 2, 1, 2.0])
    bx, by = isotonic(x, w, t)
    assert (np.diff(by) >= 0).all()
    assert abs(np.interp(x, bx, by) @ w - t.sum()) < 1e-9


def test_measures_of_edges():
    import pyarrow as pa

    x = op6_quality.describe(texts_of(pa.array([None, "", "\n\n", "é" * 10])))
    assert x.shape[0] == 4 and np.isfinite(x).all()


def test_matches_against_brute_force(spark):
    """The automaton's matches, by looking at every place of the folded text for every entry."""
    lexicon = op9_toxicity.learn(toxic_rows(spark).select("text", "y"))
    lexicon.weights |= {" lam": 0.5, " lamp ": 0.25, " tre": 2.0, " tree ": 1.0}
    rng = random.Random(3)
    made, folder = lexicon.automaton(), lexicon.folder()
    for _ in range(200):
        text = " ".join(rng.choice(["lamp", "lam", "lamps", "TREE", "trees", "bl0rfing", "grand", "cup", "a-b", "!!", "the", "blorfing"]) for _ in range(rng.randrange(0, 40)))
        words = folder.words(text)
        line, weight, count = f" {' '.join(words)} ", 0.0, 0
        covered = {i for p in lexicon.exceptions for a in range(len(line)) if line.startswith(p, a) for i in range(a, a + len(p) - 1)}
        for at in range(len(line)):
            best = max((w for e, w in lexicon.weights.items() if line.startswith(e, at)), default=0.0)
            if best and at not in covered:
                weight, count = weight + best, count + 1
        got = lexicon.facts(text, made, folder)
        assert got[1:] == (count, len(words)) and abs(got[0] - weight) < 1e-9 or not words


def test_repeated_labels_ids_and_texts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, None), (None, "d")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (2, 1), (3, 0), (None, 1), (4, 1)], "doc_id long, quality int")
    rows = training_rows(df, labels, "quality", F.lit(True), "doc_id", "text", 10)
    got = sorted(((r.text, r.y) for r in rows.collect()), key=repr)
    assert len(got) == 3 and ("c", 1.0) in got and (None, 0.0) in got and got[0][0] in ("a", "b") and got[0][1] == 0.0
    assert training_rows(df, labels, "quality", F.lit(True), "doc_id", "text", 2).count() == 2


def test_equal_documents_get_equal_scores(spark):
    """Ties: one statistic for all rows, of both labels."""
    rows = spark.createDataFrame([("same words here", float(i % 2)) for i in range(40)], "text string, y double")
    df = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (None, "same words here")], "doc_id long, text string")
    assert {round(r.score, 2) for r in op6_quality.score(df, op6_quality.fit(rows)).collect()} == {0.5}
    assert len({r.score for r in op9_toxicity.score(df, op9_toxicity.learn(rows)).collect()}) == 1


def test_excused_spans_in_one_sweep():
    rng = random.Random(4)
    for _ in range(300):
        found = {rng.randrange(40): 1.0 for _ in range(rng.randrange(12))}
        excused = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))]
        assert op9_toxicity.outside(found, excused) == {s: w for s, w in found.items() if not any(a <= s < b for a, b in excused)}
    began = time.time()
    assert op9_toxicity.outside({5 * i: 1.0 for i in range(400_000)}, [(5 * i, 5 * i + 3) for i in range(400_000)]) == {}
    assert time.time() - began < 20


def test_the_first_reading_that_is_known_among_all():
    """The walk over letters against every reading written out, of words with up to eight ambiguous signs; a million words in one text."""
    rng = random.Random(5)
    turned = 0
    for _ in range(3000):
        entries = {rng.choice([" {} ", " {}"]).format("".join(rng.choice("ilgbaq") for _ in range(rng.randrange(1, 5)))) for _ in range(4)}
        folder = op9_toxicity.KnownReadings(entries)
        ways = folder.ways("".join(rng.choice("169!|-ila") for _ in range(rng.randrange(1, 9))))
        shown = lambda letters: op9_toxicity.NOT_LETTERS.sub("", op9_toxicity.RUNS.sub(r"\1", "".join(letters)))
        readings = [shown(p) for p in itertools.product(*ways)]
        want = next((r for r in readings if any(f" {r} " == e or not e.endswith(" ") and f" {r}".startswith(e) for e in entries)), readings[0])
        turned += want != readings[0]
        assert shown(folder.choose(ways)) == want
    assert turned > 100
    assert op9_toxicity.KnownReadings({" illiglilb "}).fold("1l1i911|6") == "illiglilb"
    began = time.time()
    lexicon = op9_toxicity.Lexicon({" blorfing ": 1.0}, {" grand blorfing "}, None)
    found = lexicon.facts("a grand bl0rf1ng and b1orfing " * 200_000, lexicon.automaton(), lexicon.folder())
    assert found == (200_000.0, 200_000, 1_000_000) and time.time() - began < 20
