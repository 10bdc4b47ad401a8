import random
import re

from quire.llm import op8_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, failed string, kept string"  # clash with output columns


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    n = len(words)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(n - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lower = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    caps = sum(len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z]", w) for w in words)
    m = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    failed = [n < 20, 100 * len(covered) > 30 * n, 10 * m["n_symbols"] > n, 2 * m["n_dup_lines"] > len(lines), 5 * sum(a == b for a, b in zip(lower, lower[1:])) > n, 2 * caps > n, m["word_chars"] > 12 * n or m["word_chars"] < 2 * n]
    return m, sum(1 << i for i, f in enumerate(failed) if f)


def documents():
    rng = random.Random(5)
    vocab = ["The", "the", "UN", "NATO", "É", "#tag", "a", "ab", "x" * 30, "漢字", "50%"] + ["w%d" % i for i in range(40)]
    docs = [(i, rng.choice([" ", "\n", "\t", " \n"]).join(rng.choice(vocab) for _ in range(rng.randrange(0, 90)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, " \n\t "), (103, "same line here\n" * 30), (104, "SHOUT " * 30), (105, "one two three four five six seven eight " * 9), (106, "word " * 40_000), (1, docs[1][1]), (1, docs[1][1]), (None, docs[2][1]), (None, None)]
    return docs


def test_ledger_policies_and_ablation_against_brute_force(spark):
    docs = documents()
    slow = {i: brute(t) for i, (_, t) in enumerate(docs) if len(t or "") < 100_000}
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA).repartition(3)
    rows = op8_rules.ledger(df).collect()
    assert len(rows) == len(docs)
    want = sorted(((d, *slow[i][0].values(), slow[i][1]) for i, (d, _) in enumerate(docs) if i in slow), key=repr)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) for r in rows if r.doc_id != 106), key=repr)
    assert got == want
    assert next(r.n_words for r in rows if r.doc_id == 106) == 40_000
    bits = [r.failed for r in rows]
    for version, rules in op8_rules.POLICIES.items():
        mask = op8_rules.mask(version)
        kept = op8_rules.apply_policy(op8_rules.ledger(df), version).where("kept").count()
        assert kept == sum(b & mask == 0 for b in bits) == op8_rules.keep_passing(df, version).count()
        found = {r.rule: (r.n_failed, r.n_failed_alone) for r in op8_rules.ablation(op8_rules.ledger(df), version).collect()}
        assert found == {x: (sum(b & op8_rules.bit(x) > 0 for b in bits), sum(b & mask == op8_rules.bit(x) for b in bits)) for x in rules}
    assert op8_rules.mask("base") != op8_rules.mask("v1")


def test_rows_go_through_unchanged_and_tables_may_be_empty(spark):
    df = spark.createDataFrame([(d, t, "x", None, "z") for d, t in documents()], SCHEMA)
    out = op8_rules.keep_passing(df, "base")
    assert out.schema == df.schema
    assert not {r.doc_id for r in out.collect()} & {100, 101, 102}
    empty = df.limit(0)
    assert op8_rules.ledger(empty).collect() == [] and op8_rules.keep_passing(empty, "v1").collect() == []
    assert op8_rules.ablation(op8_rules.ledger(empty), "v1").collect() == []
