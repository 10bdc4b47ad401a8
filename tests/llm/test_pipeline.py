import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import op8_rules
from test_op1_op2 import brute1
from test_op4_op7 import brute7
from test_op10 import brute


def tables(spark, at):
    rng = random.Random(9)
    vocab = ["The", "the", "of", "é", "漢字"] + ["w%d" % i for i in range(700)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    passage = text(60)
    docs = [(i, text(rng.randrange(25, 160))) for i in range(50)]
    docs += [(100 + i, f"{text(40)} {passage} {text(30)}") for i in range(4)]
    docs += [(110, docs[3][1]), (111, docs[4][1] + " extra"), (112, f"{text(20)} {items[2][1]} {text(20)}"), (113, "# $ % " * 30), (114, "few words"), (115, None), (116, ""), (117, "same " * 40)]
    rows = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    kept = {r.doc_id for r in op8_rules.apply_policy(op8_rules.ledger(spark.read.parquet(f"{tmp_path}/documents.parquet")), "v1").where("kept").collect()}
    assert not kept & {113, 114, 115, 116, 117} and len(kept) >= 50
    left = [(d, t) for d, t in docs if d in kept]
    groups = {d: k for d, _, _, k in brute(left)}
    left = sorted((d, t) for d, t in left if groups[d])
    assert 110 not in dict(left) and 111 not in dict(left)
    cut = []
    for (d, t), row in zip(left, brute7(left)):
        b, seen = t.encode(), None
        if row[2]:
            seen = removed(left, d)
            t = "".join(c for c, i in zip(t, np.cumsum([0] + [len(c.encode()) for c in t]).tolist()) if not any(seen[i : i + len(c.encode())]))
        cut.append((d, t))
    assert sum(a != b for a, b in zip(left, cut)) == 3
    clean = {d for d, _, hit, _ in brute1(cut, items) if not hit}
    assert 112 not in clean
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((d, np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) for d, t in cut if d in clean)
    got = sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def removed(docs, doc, window=100):
    seen = set()
    for d, t in docs:
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                gone[i : i + window] = [True] * window
            seen.add(b[i : i + window])
        if d == doc:
            return gone


def test_columns_stay(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
