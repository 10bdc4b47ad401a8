import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import op3_bpe
from quire.llm.bpe import ByteDecoder, Transducer, WordStream

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def samples():
    rng = random.Random(2)
    pools = ["abcdefghijklmnopqrstuvwxyz", "thein ", "aàéèçœßÄÖü ñ'", "0123456789.,!?#$% ", "漢字かな한글一三", "ΣΑΣ ΟΔΟΣ'S 'RE", "éö   \x1c\x1f\x85​\n\t", "😀👩‍👩‍👧 ¼²Ⅷ٣", "İIıſK", "aaaa", "'s't're've'm'll'd"]
    out = ["", " ", "hello world", "<|startoftext|>Hi<|endoftext|> there <|endoftext", "a<|endoftext|>b", "A" * 5000, "the" * 3000, "ab" * 2500 + "!" * 1500, "é" * 3000]
    for _ in range(300):
        out.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 80))))
    for _ in range(12):
        pool = rng.choice(pools[:3])
        out.append("".join(rng.choice(pool.replace(" ", "")) for _ in range(rng.randrange(3000, 9000))))
    return out


def test_machine_against_library(library):
    machine = Transducer(Path(PATH).read_bytes())
    small = Transducer(Path(PATH).read_bytes(), spare=1, piece=5)
    middle = Transducer(Path(PATH).read_bytes(), piece=37)
    for text in [*samples(), "x'r", "x'", "don't've'll'v 'e're", "e\u0301" * 40, "\u1112\u1161\u11ab" * 20, "<|endoftext|>" * 9 + "'" * 30]:
        want = library.encode(text, add_special_tokens=False).ids
        for m in (machine, small, middle):
            got = np.frombuffer(m.encode(text), "<u4").tolist()
            assert got == want, text[:80]
        assert machine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_text_of_the_table(spark, library):
    """The whole query against the library."""
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_bpe.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_memory_does_not_follow_the_text():
    """A word of any length goes through the buffer, and a decoder holds no text back."""
    machine = Transducer(Path(PATH).read_bytes(), piece=1000)
    word, longest = WordStream(machine), 0
    for _ in range(200):
        word.feed(b"thequick" * 100)
        longest = max(longest, len(word.buffer))
    assert longest <= machine.room
    assert max(len(b"".join(p)) for p in machine.pieces("word " * 20_000)) <= 4 * 1000


def test_operator(spark, library):
    texts = [*samples(), None]
    df = spark.createDataFrame([(i % 200 if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in op3_bpe.encode(df).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i > 0, i % 200, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert op3_bpe.encode(df.limit(0)).collect() == []


def test_bytes_come_out_as_soon_as_complete():
    machine = ByteDecoder([b"a", b"\xc3", b"\xa9", b"\xf0\x9f"])
    assert machine.feed([0, 1]) == "a"
    assert machine.feed([2, 3]) == "é"
    assert machine.end() == "�"
    machine = ByteDecoder([b"a", b"\xc3\xa9"], b" ")
    assert machine.feed([0]) + machine.feed([]) + machine.feed([1, 0]) + machine.end() == "a é a"
