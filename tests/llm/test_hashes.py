"""Strings of a regular build must not collide: a Thue-Morse string and its complement do in sums of powers modulo 2^64."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import op2_lm, op4_substrings, op8_rules, op10_setsketch
from quire.llm.words import nonspace_class, spans, texts_of, word_hashes

SIZES = (8, 64, 72, 1024, 4096)


def morse(n, ones="ab"):
    return "".join(ones[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", SIZES)
def test_words_of_a_regular_build_differ(n):
    texts = texts_of(pa.array([f"{morse(n)} {morse(n, 'ba')} {morse(n)}"]))
    starts, ends, _ = spans(texts, nonspace_class())
    a, b, c = word_hashes(texts.buf, starts, ends).tolist()
    assert a == c != b


def test_hashes_tell_all_lengths_and_zeros_apart():
    texts = texts_of(pa.array(["\0" * n for n in range(1, 200)] + ["a" * n for n in range(1, 200)]))
    h = word_hashes(texts.buf, texts.off[:-1], texts.off[1:])
    assert len(np.unique(h)) == 398
    again = texts_of(pa.array(["x" * k + "a" * n for k in (1, 3, 7) for n in range(1, 200)]))
    skip = np.repeat([1, 3, 7], 199)
    assert (word_hashes(again.buf, again.off[:-1] + skip, again.off[1:]).reshape(3, -1) == h[199:]).all()


@pytest.mark.parametrize("n", (1024, 4096))
def test_operators_see_two_words(spark, n):
    one, two = [[f"{k}{morse(n, o)}" for k in "cdefghijkl"] for o in ("ab", "ba")]
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in op10_setsketch.near_duplicates(docs, percent=85, width=3).collect()}
    assert near == {1: 1, 2: 2}
    lines = spark.createDataFrame([(1, f"{morse(n)}\n{morse(n, 'ba')}\n{morse(n)}")], "doc_id long, text string")
    assert op8_rules.ledger(lines).first().n_dup_lines == 1
    window = ["w%d" % i for i in range(34)]
    texts = spark.createDataFrame([(1, " ".join([*window, morse(n)])), (2, " ".join([*window, morse(n, "ba")]))], "doc_id long, text string")
    assert [r.n_removed for r in op4_substrings.remove_repeats(texts).collect()] == [0, 0]


def test_language_model_counts_them_apart(spark):
    docs = spark.createDataFrame([(1, morse(1024)), (2, morse(1024, "ba"))], "doc_id long, text string")
    rows = {r.doc_id: r.n_known for r in op2_lm.score(docs, F.col("doc_id") == 1).collect()}
    assert rows == {1: 2, 2: 1}  # the end of a text is known as well
