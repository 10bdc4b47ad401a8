import hashlib
import random
import re

import pytest

from quire.llm import op4_substrings, op7_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string"  # `kept` clashes with an output column


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)] + ["é", "漢字", "Ω"]
    passage = [rng.choice(words) for _ in range(60)]
    docs = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            k = rng.randrange(0, 20)
            body[rng.randrange(0, len(body) + 1) : 0] = passage[k : k + rng.randrange(20, 60)]
        docs.append((i, " ".join(body) if i % 2 else "\n".join(body)))
    docs += [(50, None), (51, ""), (52, "a " * 300), (53, "b" * 700), (54, docs[0][1]), (55, docs[3][1]), (None, docs[3][1]), (None, None), (56, " ".join(passage * 3)), (57, " \t\n")]
    rng.shuffle(docs)
    return docs


def brute4(docs, window=35):
    all_words = [WORD.findall(t or "") for _, t in docs]
    seen = {}
    for w in all_words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (doc, _), w in zip(docs, all_words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def brute7(docs, window=100):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        b = (text or "").encode()
        gone = set()
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts,chunk", [(1, 8 << 20), (5, 900)])
def test_word_windows_against_brute_force(spark, parts, chunk):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(parts)
    got = op4_substrings.remove_repeats(df, chunk_bytes=chunk)
    assert rows(got) == sorted(brute4(docs), key=repr)


@pytest.mark.parametrize("parts,chunk", [(1, 4 << 20), (5, 900)])
def test_byte_windows_against_brute_force(spark, parts, chunk):
    docs = [d for d in corpus() if d[0] is not None]
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(parts)
    got = op7_suffixes.remove_seen(df, chunk_bytes=chunk)
    from pyspark.sql import functions as F

    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows(got) == sorted(brute7(docs), key=repr)


@pytest.mark.parametrize("many", [4096, 6, 0])
def test_sorted_and_hashed_entries_agree(spark, many):
    """Passages under different surroundings, in few and in many places, with shifted and periodic parts."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, other = letters(260), letters(130)
    docs = []
    for i in range(60):
        k = rng.randrange(0, 60)
        docs.append((i, letters(rng.randrange(0, 200)) + rng.choice([passage, passage[k:], passage[: 200 - k], other, other[k:], "ab" * 70, ""]) + letters(rng.randrange(0, 200))))
    docs += [(70, "\0" * 150 + passage), (71, "\0" * 130), (72, passage[:99]), (73, passage[:100])]
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(4)
    from pyspark.sql import functions as F

    for chunk in (4 << 20, 3000):
        got = op7_suffixes.remove_seen(df, chunk_bytes=chunk, many=many).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert rows(got) == sorted(brute7(docs), key=repr)


def test_ids_of_any_ordered_type(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(153))
    df = spark.createDataFrame([(None, text), ("b", text), ("a", text), ("b", text + text)], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_removed) for r in op7_suffixes.remove_seen(df).collect())
    assert got[0] == ("", 153) and got[1] == ("a", 0) and sorted(got[2:]) == [("b", 153), ("b", 306)]
    assert sorted((r.doc_id or "", r.text) for r in op7_suffixes.cut_repeats(df.withColumn("place", df.doc_id)).collect())[1] == ("a", text)


def test_null_ids_come_last(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(153))
    df = spark.createDataFrame([(None, text), (3, text), (1, text)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in op7_suffixes.remove_seen(df).collect()}
    assert got == {1: 0, 3: 153, None: 153}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op4_substrings.remove_repeats(df).collect() == []
    assert op7_suffixes.remove_seen(df).collect() == []
