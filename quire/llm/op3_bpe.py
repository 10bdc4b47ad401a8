"""BPE encoding and decoding of a corpus by the transducer of bpe.py.

The tokenizer's definition is a file named by the caller; the driver reads it and Spark
sends it to the executors once (a vocabulary's size is fixed, whatever the corpus). Rows
need nothing from each other, so there is no shuffle. Beyond a row's text, ids and decoded
text, which are values of its row, a task holds one piece of a text and the open word's buffer.

Null texts count as empty: no tokens. Ids may be null or repeated. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import Transducer
from quire.llm.words import texts_of


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded (the text of these ids)."""
    kind = df.schema[key].dataType.simpleString()
    definition = df.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(definition.value)
        for batch in batches:
            for first, block in texts_of(batch.column(1)).blocks():
                ids, text_of = zip(*(both_ways(machine, block.raw(i).decode("utf-8", "replace")) for i in range(len(block))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(text_of, pa.string())], names=[key, "n_tokens", "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary, decoded string")


def both_ways(machine: Transducer, text: str) -> tuple[bytes, str]:
    """Ids of a text, and the text of these ids: a piece is decoded as soon as it is encoded."""
    decoder, ids, out = machine.decoder(), [], []
    for found in machine.pieces(text):
        ids.append(b"".join(found))
        out.append(decoder.feed(np.frombuffer(ids[-1], "<u4").tolist()))
    return b"".join(ids), "".join(out) + decoder.end()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
