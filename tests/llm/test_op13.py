import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import op13_imatch
from quire.llm.words import texts_of

SCHEMA = "doc_id long, text string, n_chars string, fingerprint string, h string, place string, id string, guest string"


def words(rng, n, vocab):
    return " ".join("w" + "".join(chr(97 + int(c)) for c in str(int(rng.paretovariate(0.5)) % vocab)) for _ in range(n))


def documents(n=400):
    rng = random.Random(13)
    docs = [(i, words(rng, rng.choice([3, 30, 200, 800]), 4000)) for i in range(0, 3 * n, 3)]
    docs += [(1, None), (2, ""), (4, "12 34 #"), (5, "x"), (7, "漢字 é\U0001f600 ÀB" * 5), (8, docs[9][1]), (8, docs[9][1]), (8, "other text here"), (None, docs[4][1]), (None, None), (None, "zz"), (10_000, "long " + words(rng, 60_000, 4000)), (10_001, "w" * 400_000)]
    return docs


def run(spark, docs, parts=5):
    df = spark.createDataFrame([(i, t, *"abcdef") for i, t in docs], SCHEMA).repartition(parts)
    return op13_imatch.with_next(df).collect()


def xx(spark, docs):
    return [r[0] for r in spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(docs)], "k long, t string").selectExpr("xxhash64(t) AS h", "k").orderBy("k").collect()]


def expected(spark, docs):
    """(id, n_chars, edited text, text, next text) by sorting all rows in one place."""
    keyed = sorted(zip(docs, xx(spark, docs)), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
    texts = [t or "" for (_, t), _ in keyed]
    out = []
    for k, ((i, _), _) in enumerate(keyed):
        t, follows = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + follows[:half], t, follows))
    return out


@pytest.mark.parametrize("size", [1 << 12, 4 << 20])
def test_edits_and_fingerprints_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(op13_imatch, "RANGE_BYTES", size)
    docs = documents()
    want = expected(spark, docs)
    rows = run(spark, docs)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr)
    assert got == sorted(((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _, _ in want), key=repr)
    # fingerprints, from the definition: document frequencies, band, subsets
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: {w.translate({c: c + 32 for c in range(65, 91)}) for w in term.findall(t)}
    df = {}
    for _, t in docs:
        for w in low(t or ""):
            df[w] = df.get(w, 0) + 1
    least = max(2, -(-len(docs) // 2000))
    most = max(2 * least, len(docs) // 40)
    band = {w for w, n in df.items() if least <= n <= most}

    def printed(t):
        kept = low(t) & band
        return frozenset(kept if len(kept) >= op13_imatch.FEW else low(t) or {t + "\0"})

    by_set = {}
    print_of = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in rows}
    for i, n, e, t, follows in want:
        r = print_of[i, n, hashlib.sha256(e.encode()).hexdigest()]
        for text, mark in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert by_set.setdefault(printed(text), mark) == mark  # equal terms, equal fingerprints
        marks = op13_imatch.Prints.read([r.fingerprint, r.edited_fingerprint])
        assert op13_imatch.likeness(marks.take(np.array([0])), marks.take(np.array([1])))[0] == r.near_edited
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if printed(t) == printed(follows):
            assert r.near_next == 1
    assert len(set(by_set.values())) == len(by_set)  # other terms, other fingerprints
    long = [r for r in rows if r.n_chars > 800]
    assert np.mean([r.near_edited for r in long]) > 5 * np.mean([r.near_next for r in long])


def test_subset_codes_follow_the_definition():
    rng = random.Random(3)
    lex = np.zeros(0, np.uint64)
    a = " ".join("t" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(100))
    b = " ".join(["changed" + c for c in "abcdefgh"] + a.split()[8:])
    p = op13_imatch.prints(texts_of(pa.array([a, b, a, "", "  ", None])), lex)
    assert p.written()[0] == p.written()[2] != p.written()[1] and p.written()[3] == p.written()[5] != p.written()[4]
    same = op13_imatch.likeness(p.take(np.array([0])), p.take(np.array([1])))[0]
    assert 0.5 < same < 1
    assert (op13_imatch.Prints.read(p.written()).codes == p.codes).all()
    held = (p.codes[0].reshape(3, op13_imatch.SUBSETS) != 0).mean(axis=1)
    assert held[0] > held[2]


def test_one_row_and_empty_table(spark):
    only = run(spark, [(7, "abcdef")])
    assert only[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and only[0].near_next == 1.0 and len(only) == 1
    assert run(spark, [], 1) == []


def test_string_ids_and_plain_fingerprints(spark):
    docs = [(None if i is None else f"é{i}", t) for i, t in documents(60)]
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id string, text string")
    a = sorted(((r.doc_id, r.fingerprint) for r in op13_imatch.with_next(df).collect()), key=repr)
    assert a == sorted(((r.doc_id, r.fingerprint) for r in op13_imatch.fingerprints(df).collect()), key=repr)


def test_edited_texts_are_likelier_than_next_ones(spark):
    rows = op13_imatch.query(spark, "/root/testdata/sf0.01").collect()
    edited = [r.near_edited for r in rows if r.n_chars > 1000]
    assert np.mean([x > 0 for x in edited]) > 0.95
    assert np.mean([r.near_edited > r.near_next for r in rows if r.n_chars > 1000]) > 0.9
