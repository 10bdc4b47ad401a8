import math
import random
import re
import zlib

from quire.llm import op1_decontaminate, op2_lm
from pyspark.sql import functions as F

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute1(docs, items):
    words = lambda t: ALNUM.findall((t or "").encode().translate(LOWER))
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                k = tuple(w[i : i + n])
                if len(k) == n and k in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["The", "of", "a", "É1", "x-y", "ÄB"] + ["w%d" % i for i in range(150)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(5, 40))) for i in range(30)] + [(90, "W1"), (91, "w2, w3!"), (92, ""), (93, None), (None, text(14)), (94, "of a of"), (7, text(12))]
    items.append((95, items[3][1]))
    docs = [(i, text(rng.randrange(0, 90))) for i in range(60)]
    for i in range(0, 60, 3):
        w = (items[i % 37][1] or "").split()
        docs.append((100 + i, text(9) + " " + ", ".join(w[: rng.randrange(3, 40)]).upper() + "\n" + text(4)))
    docs += [(900, None), (901, ""), (None, items[5][1]), (1, items[5][1]), (1, items[5][1]), (902, items[8][1] * 2)]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, row int").repartition(3)
    bench = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, words int").repartition(2)
    got = op1_decontaminate.decontaminate(df, bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == brute1(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got.collect())
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in op1_decontaminate.decontaminate(df, empty).collect()} == {0}
    assert op1_decontaminate.decontaminate(df.limit(0), bench).collect() == []


def test_language_model_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["The", "the", "Of", "é", "É"] + ["w%d" % i for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 50)))) for i in range(70)] + [(200, None), (201, ""), (202, "unseen words only"), (5, "w1 w2")]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id long, text string, score double").repartition(4)
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    tok = lambda t: WORD.findall((t or "").encode().translate(LOWER)) + [b"</s>"]
    one, two = {}, {}
    for d, t in docs:
        if train(d):
            w = tok(t)
            for a, b in zip([b"<s>"] + w[:-1], w):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
    n, v = sum(one.values()), len(one)
    starts = one[b"</s>"]
    want = []
    for d, t in docs:
        base = total = 0.0
        w = tok(t)
        for a, b in zip([b"<s>"] + w[:-1], w):
            p = (one.get(b, 0) + 1) / (n + v + 1)
            h = starts if a == b"<s>" else one.get(a, 0)
            base += math.log10(p)
            total += math.log10((two.get((a, b), 0) + op2_lm.MU * p) / (h + op2_lm.MU))
        want.append((d, len(w), sum(x in one for x in w), n, round(base, 6), round(total, 6)))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    for size in (16 << 20, 300):
        got = op2_lm.score(df, crc, chunk_bytes=size).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    assert op2_lm.score(df.limit(0), crc).collect() == []
    none = op2_lm.score(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in none)


def test_higher_orders_and_lanes_against_brute_force(spark):
    """Orders 2 to 4, texts cut into lanes of a few words, by a recursive definition of the probabilities."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 60)))) for i in range(40)] + [(90, "a b " * 700), (91, None), (93, "zz a zz b"), (None, "a b c"), (3, "a a"), (3, "a a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tok = lambda t: ["<s>", *(t or "").split(), "</s>"]
    for order in (2, 3, 4):
        seen = {}
        for d, t in docs:
            if d is not None and d % 2 == 0:
                w = tok(t)
                for i in range(1, len(w)):
                    for k in range(1, order + 1):
                        if i - k + 1 >= 0:
                            g = tuple(w[i - k + 1 : i + 1])
                            seen[g] = seen.get(g, 0) + 1
        seen["<s>",] = seen["</s>",]
        n, v = sum(c for g, c in seen.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 for g in seen) - 1

        def p(history, w):
            if not history:
                return (seen.get((w,), 0) + 1) / (n + v + 1)
            return (seen.get((*history, w), 0) + op2_lm.MU * p(history[1:], w)) / (seen.get(history, 0) + op2_lm.MU)

        want = sorted(((d, round(sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w))), 6)) for d, t in docs for w in [tok(t)]), key=repr)
        for size, lane in ((10 << 20, 256), (400, 5)):
            got = op2_lm.score(df, F.col("doc_id") % 2 == 0, chunk_bytes=size, order=order, lane=lane).collect()
            assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=repr) == want, (order, lane)


def test_probabilities_at_every_state_add_up_to_one():
    import numpy as np
    import pyarrow as pa

    rows = pa.table({"text": ["a b a c a b", "b a", "c c c"]})
    word, off = op2_lm.tokens(rows)
    found = {part: np.unique(g[g != 0], return_counts=True) for part, g in enumerate(op2_lm.grams(word, off, 3))}
    counts = lambda part, keys: found[part][1][np.searchsorted(found[part][0], keys)]
    machine = op2_lm.Automaton(word, off, 3, counts, len(word), len(found[0][0]), 5.0)
    symbols = np.arange(machine.width)
    for state in range(len(machine.fail)):
        _, weight = machine.step(np.full(machine.width, state), symbols)
        unknown = 1 / (len(word) + machine.width + 1)
        at = state
        while at != op2_lm.ROOT:  # a word outside takes failure arcs to the root
            unknown *= 10 ** machine.fail[at]
            at = machine.fail_to[at]
        assert abs((10**weight).sum() + unknown - 1) < 1e-9


def test_counts_of_any_size_survive_packing():
    import numpy as np

    from quire.llm.chunks import by_weight, from_weight, totals

    many = totals(np.array([7, 7, 9], np.uint64), np.array([2**32 - 1, 2**32 - 1, 5], np.uint32))
    assert many.tolist() == [2**33 - 2, 2**33 - 2, 5]
    for values in (many, many[:0], np.array([True, False]), np.arange(5, dtype=np.uint8)):
        assert from_weight(by_weight(values), values.dtype).tolist() == values.tolist()
