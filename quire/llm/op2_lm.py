"""Language-model scoring with a weighted backoff automaton.

Counts of n-grams of up to ORDER words, over all training texts, are smoothed into a model
in backoff form. Its states are the histories that training has (up to ORDER - 1 words, and
the start of a text) and the root; its arcs are the n-grams that training has.

    arc h -w->        log10((c(h w) + MU * P(w | h')) / (c(h) + MU)), h' being h without its first word
    failure arc h     log10(MU / (c(h) + MU)), to the state h'
    root arc          log10((c(w) + 1) / (N + V + 1)), an unknown word as c(w) = 0

At each state the probabilities of all words, each by its arc or by the failure arc and what
follows it, add up to one. A text is read once, from left to right: at each word the walk takes
failure arcs until a state has an arc for it, adds up the weights, and stands in the arc's
target. The state after a word depends on the ORDER - 1 words before at most; long texts are
therefore read in lanes of LANE words, each of which first walks over that many words before it.

Counts are not gathered anywhere whole: chunks (see chunks.py) send their distinct n-grams
with their own training counts, and are sent back the corpus totals of these, which are
the arcs of the automaton that their own texts can take. N-grams are known by 64-bit hashes.

Null texts count as empty: they have the end token alone. Rows with null or repeated ids are
scored as they are; a null id's crc32 is null, so such rows are neither held out nor used to learn.
Without training rows all words are unknown. Texts may be of any length. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chunks import Answers, ask, bucket_count, chunk_words, finish, pack, settle, table_texts, totals
from quire.llm.shared import cut
from quire.llm.words import mix, nonspace_class

ORDER = 2
MU = 1000.0
LANE = 256
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ROOT = 0


def tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with an end for each text, and the texts' offsets."""
    words, off = chunk_words(table_texts(rows), nonspace_class(), lower=True)
    n = len(off) - 1
    out_off = off + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    inner = np.ones(len(out), bool)
    inner[out_off[1:] - 1] = False
    out[inner] = words
    out[out_off[1:] - 1] = END
    return out, out_off


def grams(word: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """For n up to `order`, the hash of the n tokens that end at each position (0 if the text has fewer).

    The start of a text counts as a token before its first one.
    """
    out, before = [word], np.full(len(word), 0, np.uint64)
    for n in range(2, order + 1):
        before[1:] = out[-1][:-1]
        before[off[:-1]] = START if n == 2 else 0
        with np.errstate(over="ignore"):
            out.append(np.where(before == 0, np.uint64(0), mix(before * np.uint64(0xD1342543DE82EF95) + word)))
    return out


def own_counts(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    real = keys != 0
    distinct, back = np.unique(keys[real], return_inverse=True)
    return distinct, np.bincount(back, weights=train[real], minlength=len(distinct)).astype(np.uint32)


class Automaton:
    """The states and arcs that a chunk's texts can reach.

    weight, target: of each arc, in the order of `arcs` (state * symbols + symbol). fail, fail_to: of each state.
    """

    def __init__(self, word: np.ndarray, off: np.ndarray, order: int, counts, n: int, types: int, mu: float):
        """counts(part, sorted distinct hashes) -> their corpus counts."""
        self.order = order
        all_grams = grams(word, off, order)
        distinct, first, self.symbol = np.unique(word, return_index=True, return_inverse=True)
        width = max(len(distinct), 1)
        got = counts(0, distinct).astype(np.float64)
        self.known = got > 0
        at_end = np.searchsorted(distinct, END) if len(distinct) else 0
        texts = got[at_end] if len(distinct) else 0.0  # each has one start and one end
        chance = (got + 1.0) / (n + types + 1.0)
        # states: the root, the start of a text, then the histories by their number of words
        self.start = 1 if texts > 0 else ROOT
        fail, fail_to = [np.array([0.0, np.log10(mu / (texts + mu))])], [np.zeros(2, np.int64)]
        made = 2
        history = self.known & (np.arange(len(distinct)) != at_end)
        state = np.where(history, made + np.cumsum(history) - 1, ROOT)
        fail.append(np.log10(mu / (got[history] + mu)))
        fail_to.append(np.zeros(int(history.sum()), np.int64))
        made += int(history.sum())
        arcs, weight, target = [np.arange(len(distinct))], [np.log10(chance)], [state]
        back, begins = self.symbol, np.zeros(len(word), bool)
        begins[off[:-1]] = True
        for k in range(2, order + 1):
            keys = all_grams[k - 1]
            real = np.flatnonzero(keys != 0)
            distinct, at, new_back = np.unique(keys[real], return_index=True, return_inverse=True)
            at = real[at]
            count = counts(k - 1, distinct).astype(np.float64)
            seen = count > 0
            at, count = at[seen], count[seen]
            suffix = back[at]  # the same n-gram without its first word
            opens = begins[at] if k == 2 else np.zeros(len(at), bool)
            prefix = back[np.maximum(at - 1, 0)]  # and without its last
            total = np.where(opens, texts, got[prefix]) if len(at) else count
            source = np.where(opens, self.start, state[prefix]) if len(at) else at
            p = (count + mu * chance[suffix]) / (total + mu)
            last = self.symbol[at]
            goes_on = last != at_end
            new_state = np.where(goes_on, made + np.cumsum(goes_on) - 1, ROOT) if k < order else state[suffix]
            arcs.append(source * width + last)
            weight.append(np.log10(p))
            target.append(new_state)
            if k < order:
                fail.append(np.log10(mu / (count[goes_on] + mu)))
                fail_to.append(state[suffix][goes_on])
                made += int(goes_on.sum())
                back = np.full(len(word), -1)
                back[real] = new_back
                spread = lambda values, empty: _spread(values, seen, empty)
                got, chance, state = spread(count, 0.0), spread(p, 0.0), spread(new_state, ROOT)
        arcs_all = np.concatenate(arcs)
        by_key = np.argsort(arcs_all, kind="stable")
        self.width, self.arcs = width, arcs_all[by_key]
        self.weight, self.target = np.concatenate(weight)[by_key], np.concatenate(target)[by_key]
        self.fail, self.fail_to = np.concatenate(fail), np.concatenate(fail_to)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one symbol in each of many walks: their new states and what it weighs."""
        total, to = np.zeros(len(state)), np.empty(len(state), np.int64)
        left, state = np.arange(len(state)), state
        while len(left):
            key = state * self.width + symbol
            at = symbol.copy()  # the root's arcs stand first
            other = np.flatnonzero(state != ROOT)
            at[other] = np.searchsorted(self.arcs, key[other])
            hit = self.arcs[np.minimum(at, len(self.arcs) - 1)] == key
            on = left[hit]
            total[on] += self.weight[at[hit]]
            to[on] = self.target[at[hit]]
            miss = ~hit
            left, state, symbol = left[miss], state[miss], symbol[miss]
            total[left] += self.fail[state]
            state = self.fail_to[state]
        return to, total

    def walk(self, off: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The weight of each token of the texts, each text read from its start."""
        size = np.diff(off)
        lanes = -(-size // lane)
        text = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        warm = np.where(nth > 0, self.order - 1, 0)
        begin = off[text] + nth * lane
        length = np.minimum(begin + lane, off[text + 1]) - begin + warm
        begin = begin - warm
        longest_first = np.argsort(-length, kind="stable")
        begin, length, warm = begin[longest_first], length[longest_first], warm[longest_first]
        state = np.where(warm > 0, ROOT, self.start)
        out = np.zeros(len(self.symbol))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, side="left"))  # lanes that have a token left
            at = begin[:n] + t
            state[:n], weight = self.step(state[:n], self.symbol[at])
            counted = warm[:n] <= t
            out[at[counted]] = weight[counted]
        return out


def _spread(values: np.ndarray, seen: np.ndarray, empty) -> np.ndarray:
    out = np.full(len(seen), empty, values.dtype)
    out[seen] = values
    return out


def score(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", mu: float = MU, chunk_bytes: int = 10 << 20, order: int = ORDER, lane: int = LANE) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score; `train` marks the rows to learn from."""
    if order < 2 or lane < order:
        raise ValueError("order must be 2 or more, and a lane as long as that")
    kind = df.schema[key].dataType.simpleString()
    packed = pack(df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train")), chunk_bytes)
    buckets = bucket_count(packed)

    def ask_counts(rows: pa.Table):
        word, off = tokens(rows)
        learn = np.repeat(rows.column("train").to_numpy().astype(np.float32), np.diff(off))
        for part, keys in enumerate(grams(word, off, order)):
            yield part, *own_counts(keys, learn)

    def total(keys, chunk, more):
        return totals(keys, more)  # 64 bits: a corpus has more than 2^32 of its commonest words

    def size(part, keys, more):
        if part:
            return 0, 0
        known = np.unique(keys[more > 0])
        return len(known), int(more.sum())

    counts = cut(settle(ask(packed, ask_counts, buckets), dict.fromkeys(range(order), (total, "u4")), size))
    types, count = counts.where("chunk = -1").agg(F.coalesce(F.sum("part"), F.lit(0)), F.coalesce(F.sum("bucket"), F.lit(0))).first()

    def result(rows: pa.Table, answers: Answers) -> pa.Table:
        word, off = tokens(rows)
        n = len(off) - 1
        machine = Automaton(word, off, order, lambda part, keys: answers.get(part, keys, np.int64), count, types, mu)
        sums = lambda x: np.add.reduceat(x, off[:-1]) if n else np.zeros(0)
        # without a history, every word is one arc from the root
        base = machine.weight[: machine.width][machine.symbol] if n else np.zeros(0)
        known = machine.known[machine.symbol].astype(np.int64)
        return pa.table(
            [rows.column("id"), pa.array(np.diff(off)), pa.array(sums(known).astype(np.int64)), pa.array(np.full(n, count, np.int64)), pa.array(sums(base)), pa.array(sums(machine.walk(off, lane)))],
            names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return finish(packed, counts.where("chunk >= 0"), result, buckets, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    rows = score(df, rest != 2)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by documents whose id is even as training rows, rounded, for the comparison with SQL."""
    rows = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id") % 2 == 0, order=3)
    return rows.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"), F.round("score", 3).alias("score"))


#: The model of order 3 in SQL; texts have a start `<` and an end `>` that no word can be mistaken for.
ROUNDED = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, [chr(1) || '<'] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [chr(1) || '>'] AS ws FROM documents
), u AS (
  SELECT r, doc_id % 2 = 0 AS train, unnest(range(2, len(ws) + 1)) AS i, ws FROM d
), t AS (
  SELECT r, train, i, ws[i] AS w, ws[i - 1] AS h, CASE WHEN i > 2 THEN ws[i - 2] END AS g FROM u
), c1 AS (SELECT w, count(*) AS c FROM t WHERE train GROUP BY 1
), c2 AS (SELECT h, w, count(*) AS c FROM t WHERE train GROUP BY 1, 2
), c3 AS (SELECT g, h, w, count(*) AS c FROM t WHERE train AND g IS NOT NULL GROUP BY 1, 2, 3
), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v, coalesce(sum(c) FILTER (w = chr(1) || '>'), 0) AS texts FROM c1
), p AS (
  SELECT t.r, t.g, n.n, c1.c IS NOT NULL AS known, (coalesce(c1.c, 0) + 1) / (n.n + n.v + 1) AS p1, coalesce(c2.c, 0) AS c2,
    CASE WHEN t.h = chr(1) || '<' THEN n.texts ELSE coalesce(h.c, 0) END AS h1, coalesce(c3.c, 0) AS c3, coalesce(k.c, 0) AS h2
  FROM t CROSS JOIN n LEFT JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.h = t.h AND c2.w = t.w LEFT JOIN c1 h ON h.w = t.h
    LEFT JOIN c3 ON c3.g = t.g AND c3.h = t.h AND c3.w = t.w LEFT JOIN c2 k ON k.h = t.g AND k.w = t.h
), q AS (
  SELECT *, (c2 + 1000.0 * p1) / (h1 + 1000.0) AS p2 FROM p
), s AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10(p1)) AS base_score,
    sum(log10(CASE WHEN g IS NULL THEN p2 ELSE (c3 + 1000.0 * p2) / (h2 + 1000.0) END)) AS score FROM q GROUP BY r
)
SELECT doc_id, n_tokens, n_known, train_tokens, round(base_score, 3) AS base_score, round(score, 3) AS score FROM d JOIN s USING (r)
"""
