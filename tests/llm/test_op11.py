import random
import re
from collections import Counter, defaultdict

from quire.llm import op11_divergence
from quire.llm.terms import met

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, lang string, source string, text string, rank string, term string, n string, v string"  # clash with inner columns


def brute(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for k, s in groups if k == lang]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})
        share = lambda c, n: 1 + (10**9 * (c + 2)) // (n + 2 * len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            p = {t: share(count[lang, s][t], total[s]) for t in kept}
            pairs = [(sum(f(p[t], share(count[lang, o][t], total[o])) for t in kept), o) for o in sources if o != s]
            q = {t: share(whole[t], sum(whole.values())) for t in kept}
            terms = [(f(p[t], q[t]), t) for t in kept if count[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked[:most], 1)]
    return sorted(out)


def documents(n=300):
    rng = random.Random(11)
    vocab = ["the", "The", "Éa", "éa", "漢字", "a1b", "x_y", "ſt", "İ"] + [chr(97 + i % 26) * (1 + i // 26) for i in range(60)]
    langs, sources = ["en", "en", "de", None, ""], ["s1", "s1", "s1", "s2", "s3", None, "é"]
    docs = [(i, rng.choice(langs), rng.choice(sources), " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=rng.randrange(0, 60)))) for i in range(n)]
    docs += [(1, *docs[1][1:])] * 12 + [(None, "en", "s9", None), (None, "xx", "one", ""), (900, "yy", "a", "12 34"), (901, "yy", "b", "z"), (902, "en", "s2", "long word " * 60_000), (903, "en", "s1", "w" * 300_000)]
    return docs


def found(spark, docs, parts, **options):
    df = spark.createDataFrame([(*d, "x", "y", None, "z") for d in docs], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in op11_divergence.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark):
    docs = documents()
    assert found(spark, docs, 7) == brute(docs, 10, 10)
    assert found(spark, docs, 1, least=1, top=3) == brute(docs, 1, 3)


def test_small_batches_cut_runs(spark):
    docs = documents(120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, docs, 5, least=2) == brute(docs, 2, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_nothing_kept(spark):
    assert found(spark, [], 1) == []
    docs = documents(30)
    assert found(spark, docs, 2, least=10_000) == brute(docs, 10_000, 10)


def test_joins_of_small_and_large_tables_agree(spark, monkeypatch):
    left = spark.range(1000).selectExpr("id % 7 AS k", "id")
    right = spark.range(5).selectExpr("id AS k", "id * 2 AS w")
    for how in ("inner", "left"):
        small = sorted(map(repr, met(left, right, ["k"], how).collect()))
        monkeypatch.setattr("quire.llm.terms.SMALL_ROWS", 0)
        assert sorted(map(repr, met(left, right, ["k"], how).collect())) == small
        monkeypatch.undo()
