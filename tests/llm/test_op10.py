import random
import re

from quire.llm import op10_setsketch

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(t, width):
    w = WORD.findall((t or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(docs, percent=80, width=5):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = ["The", "the", "É"] + ["w%d" % i for i in range(900)]
    docs, n = [], 0
    for family in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append((n, " ".join(t)))
            n += 1
    docs += [(500, None), (501, ""), (502, " "), (503, "one"), (504, "ONE"), (505, "one two"), (506, "one one"), (507, docs[3][1]), (1, docs[9][1]), (None, docs[9][1]), (None, "alone here now")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(a, b, 1, False) for a, b in docs], "doc_id long, text string, n long, kept boolean").repartition(3)
    for percent, width, block in ((85, 3, 512), (85, 3, 7), (80, 5, 512)):
        got = sorted((tuple(r) for r in op10_setsketch.near_duplicates(df, percent=percent, width=width, block=block).collect()), key=repr)
        assert got == brute(docs, percent, width)
    assert (op10_setsketch.rows_of_band(85), op10_setsketch.rows_of_band(80)) == (5, 4)
    assert op10_setsketch.near_duplicates(df.limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    import numpy as np

    from quire.llm.words import mix

    h = mix(np.arange(4000, dtype=np.uint64) + np.uint64(10**9))
    a, b = h[:2500], h[500:3000]
    both = op10_setsketch.registers(np.concatenate([a, b, h[:3000]]), np.array([0, 2500, 5000, 8000]))
    assert (np.maximum(both[0], both[1]) == both[2]).all()
    sizes = np.array([2500.0])
    assert op10_setsketch.likely(both[:1], both[1:2], sizes, sizes, 0.5).all()
    assert not op10_setsketch.likely(both[:1], both[1:2], sizes, sizes, 0.85).any()


def test_components_with_hubs_and_paths(spark):
    from quire.llm.components import components

    rng = random.Random(3)
    hub = [(1, k) for k in range(2, 400)] + [(399, k) for k in range(400, 700)] + [(k, 699) for k in range(700, 900)]  # the last one is a large node among larger ones
    path = [(k, k + 1) for k in range(1000, 1040)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(220)]
    edges = hub + path + loose + loose[:20] + [(5000, 5000)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert sorted((r.a, r.root) for r in got) == sorted((x, find(x)) for x in root if find(x) != x)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
