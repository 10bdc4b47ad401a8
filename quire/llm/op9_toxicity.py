"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: compatibility forms to plain letters without accents, lower case, look-alike letters of
other scripts to Latin, digits and signs that stand for letters to these, everything but letters
out of words, long runs of a letter to one. Where a digit may stand for two letters, the first reading
that the lexicon knows counts, found by a walk over a word's letters and the entries' beginnings, so that
every reading is tried and none is written out. Entries are whole words or beginnings of words. They are found in
labelled rows, in two steps, and however many the evidence leaves are used:

1. Texts: entries in at least LEAST_TEXTS different toxic texts whose log odds, of toxic against
   clean texts, are above zero by two standard errors.
2. Contexts: of these, the log odds of distinct contexts (the words before and after an entry), so
   that a text that was copied a hundred times with small changes counts once. An entry's weight
   is the lower bound (two standard errors) of these odds; it must be above LEAST_ODDS.

Exception phrases are entries with a neighbour that clean texts have again and again and toxic
ones never; what they cover is not counted. A text's score is logistic in its weight and in its
weight by length.

At most MAX_LABELLED labelled rows are learnt from (a bounded sample by a hash of the id); what is
sent to the executors comes from these alone. Equal texts count once, as toxic if any label says
so. Null and empty texts have no matches and get the lowest score. Without labels nothing matches.
Ids may be null or repeated; other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.learn import PARTS, fold_of, logistic, training_rows
from quire.llm.shared import cut
from quire.llm.words import texts_of

LEAST_CONTEXTS, LEAST_TEXTS, LEAST_ODDS = 5, 3, 1.0
LEAST_CLEAN = 3
MAX_LABELLED = 20_000
THRESHOLD = 0.3

#: Letters that look like Latin ones (Cyrillic, Greek, Latin extensions); digits and signs and the
#: letters that they stand for; signs that stand for a letter only inside a word.
LOOK_ALIKE = dict(zip("авегкмнорстухіјѕԁһԛԝ" "αβγεηικνορτυχω" "ıłøđħɑɡɩʏƒ", "abehkmhopctyxijsdhqw" "abyenikvoptuxw" "iloahagiyf"))
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "€": "e", "£": "l", "¢": "c"}
INSIDE = {"!": "il", "|": "li", "+": "t", "(": "c"}
NOT_LETTERS = re.compile(r"[^\w]|[\d_]")
RUNS = re.compile(r"(\w)\1{2,}")
BETWEEN = re.compile(r"(?<=\w)[!|+(](?=\w)")
ENDS = ".,;:?!\"'()[]-*"
REMEMBER = 500_000
LONGEST_KEPT = 64


def beginnings(size: int) -> list[int]:
    """Lengths at which a word's beginnings are entries: each up to 10, then by a fifth more, below `size`."""
    out, k = [], 4
    while k < size:
        out.append(k)
        k += 1 if k < 10 else k // 5
    return out


class Remembered(dict):
    """What a function gives for words, each asked once, but for very long ones."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, word: str):
        got = self.function(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) > REMEMBER:
                self.clear()
            self[word] = got
        return got


class Folder:
    """Folded words of texts; each distinct word is folded once."""

    def __init__(self):
        self.known = Remembered(self.fold)

    def plain(self, word: str) -> str:
        word = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)) if not word.isascii() else word.lower()
        return "".join([LOOK_ALIKE.get(c, c) for c in word])

    def ways(self, word: str) -> list[str]:
        """For each character the letters that it may be."""
        word = self.plain(word)
        inside = {m.start() for m in BETWEEN.finditer(word)}
        return [STANDS_FOR.get(c) or (INSIDE[c] if i in inside else c) for i, c in enumerate(word)]

    def fold(self, word: str) -> str:
        bare = word.strip(ENDS)
        if bare.isalpha() and bare.isascii():
            return RUNS.sub(r"\1", bare.lower())
        return NOT_LETTERS.sub("", RUNS.sub(r"\1", self.choose(self.ways(word))))

    def choose(self, ways: list[str]) -> str:
        return first_reading(ways)

    def words(self, text: str) -> list[str]:
        """Words without letters are left out."""
        return list(filter(None, map(self.known.__getitem__, text.split())))


def first_reading(ways: list[str]) -> str:
    return "".join([w[0] for w in ways])


def entries_of(word: str) -> list[str]:
    """` word ` whole, and ` begin` for its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in beginnings(len(word)))]


class KnownReadings(Folder):
    """A folder that takes, of several readings, the first one that a lexicon has an entry for."""

    def __init__(self, entries: Iterable[str]):
        super().__init__()
        self.whole = {e[1:-1] for e in entries if e.endswith(" ")}
        self.begun = {e[1:] for e in entries if not e.endswith(" ")}
        self.paths = {e[:k] for e in self.whole | self.begun for k in range(len(e) + 1)}

    def choose(self, ways: list[str]) -> str:
        """A walk over the characters. A state is the folded beginning (None once an entry is met) and the run of equal
        letters that may yet shrink to one; a beginning that begins no entry is left. Of readings that come to one state
        the first stays, so a character has no more states than the lexicon has beginnings, whatever is ambiguous."""
        if all(len(w) == 1 for w in ways):
            return first_reading(ways)
        states: dict[tuple[str | None, str, int], tuple | None] = {("", "", 0): None}  # state: (path before, letter)
        for w in ways:
            after: dict[tuple[str | None, str, int], tuple] = {}
            for (begun, letter, run), path in states.items():
                for c in w:
                    if begun is None:
                        after.setdefault((None, "", 0), (path, c))
                        break  # what follows an entry is read as its first letters
                    if c == letter:
                        after.setdefault((begun, c, min(run + 1, 3)), (path, c))
                        continue
                    closed = self.closed(begun, letter, run)
                    if closed is None or closed in self.paths:
                        after.setdefault((None, "", 0) if closed is None else (closed, c, 1), (path, c))
            states = after
            if not states:
                return first_reading(ways)
        for (begun, letter, run), path in states.items():
            closed = begun if begun is None else self.closed(begun, letter, run)
            if closed is None or closed in self.whole:
                letters = []
                while path is not None:
                    path, c = path
                    letters.append(c)
                return "".join(reversed(letters))
        return first_reading(ways)

    def closed(self, begun: str, letter: str, run: int) -> str | None:
        """The beginning with a run that has ended, or None if it, or a part of it, is an entry."""
        add = "" if not letter or NOT_LETTERS.match(letter) else letter * (1 if run > 2 else run)
        for k in range(1, len(add) + 1):
            if begun + add[:k] in self.begun:
                return None
        return begun + add


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: set[str], fitted: np.ndarray | None):
        self.weights, self.exceptions, self.fitted = weights, exceptions, fitted

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        made.make_automaton()
        return made

    def folder(self) -> Folder:
        return KnownReadings(self.weights)

    def facts(self, text: str, made: ahocorasick.Automaton, folder: Folder) -> tuple[float, int, int]:
        """Weight, matches and words of a text. Of entries that begin at one word the heaviest counts."""
        words = folder.words(text)
        if not words or not self.weights:
            return 0.0, 0, len(words)
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in made.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        found = outside(found, excused)
        return sum(found.values()), len(found), len(words)

    def inputs(self, facts: list[tuple[float, int, int]]) -> np.ndarray:
        x = np.array(facts, np.float64).reshape(-1, 3)
        return np.column_stack([np.log1p(x[:, 0]), np.log1p(100 * x[:, 0] / np.maximum(x[:, 2], 1)), np.log1p(x[:, 1])])

    def score(self, facts: list[tuple[float, int, int]]) -> np.ndarray:
        if self.fitted is None:
            return np.zeros(len(facts))
        z = self.inputs(facts) @ self.fitted[:-1] + self.fitted[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def outside(found: dict[int, float], excused: list[tuple[int, int]]) -> dict[int, float]:
    """What begins in no excused span [a, b): both in order, one sweep over them."""
    if not excused:
        return found
    spans, k, reach, out = sorted(excused), 0, -1, {}
    for start in sorted(found):
        while k < len(spans) and spans[k][0] <= start:
            reach = max(reach, spans[k][1])
            k += 1
        if start >= reach:
            out[start] = found[start]
    return out


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def texts_with(rows: DataFrame) -> DataFrame:
    """(entry, toxic, clean): how many toxic and clean texts have an entry; rows are distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, entries = Folder(), Remembered(entries_of)
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y > 0 else clean).update(set(chain.from_iterable(map(entries.__getitem__, set(folder.words(text or ""))))))
            if len(toxic) + len(clean) > REMEMBER:
                yield packed(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield packed(toxic, clean)

    def packed(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        found = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[e] for e in found], pa.int64()) for c in (toxic, clean))], names=["entry", "toxic", "clean"])

    return rows.select("text", "y").mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def contexts(rows: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(entry, toxic, clean): in how many distinct contexts the wanted entries stand in toxic and in clean texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, entries = Folder(), Remembered(lambda w: [e for e in entries_of(w) if e in wanted])
        for batch in batches:
            seen: set[tuple[str, float, int]] = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folder.words(text or "")
                for before, some, after in zip(["", *words], map(entries.__getitem__, words), [*words[1:], ""]):
                    if some:
                        place = hash_of(f"{before} {after}")
                        seen.update((e, y, place) for e in some)
            cols = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=["entry", "y", "place"])

    found = rows.select("text", "y").mapInArrow(run, "entry string, y double, place long").distinct()
    return found.groupBy("entry").agg(F.count_if(F.col("y") > 0).alias("toxic"), F.count_if(F.col("y") <= 0).alias("clean"))


def phrases(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(phrase, toxic, clean): entries with the word before or after, by label and number of texts."""
    whole = frozenset(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, known = KnownReadings(whole), Remembered(lambda w: any(e in whole for e in entries_of(w)))
        for batch in batches:
            seen: Counter[tuple[str, float]] = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folder.words(text or "")
                hit = list(map(known.__getitem__, words))
                seen.update((p, y) for p in {f" {words[i]} {words[i + 1]} " for i in range(len(words) - 1) if hit[i] or hit[i + 1]})
            cols = list(zip(*((p, y, n) for (p, y), n in seen.items()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=["phrase", "toxic", "n"])

    found = rows.select("text", "y").mapInArrow(run, "phrase string, toxic double, n long").groupBy("phrase")
    return found.agg(F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("clean"))


def sure_odds(toxic: Column, clean: Column, ratio: float) -> Column:
    """Log odds less two standard errors."""
    return F.log((toxic + 0.5) / (clean + 0.5)) - F.lit(float(ratio)) - 2 * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def learn(rows: DataFrame) -> Lexicon:
    """rows: (text, y) of a bounded sample."""
    rows = cut(rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("y").alias("y")).coalesce(PARTS))
    totals = {r.toxic: (r.n, r.words) for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("words")).collect()}
    if len(totals) < 2:
        return Lexicon({}, set(), None)
    of_texts, of_words = (np.log(totals[True][k] / totals[False][k]) for k in (0, 1))
    toxic, clean = F.col("toxic"), F.col("clean")
    some = frozenset(r.entry for r in texts_with(rows).where((toxic >= LEAST_TEXTS) & (sure_odds(toxic, clean, of_texts) > 0)).select("entry").collect())
    found = contexts(rows, some).withColumn("sure", sure_odds(toxic, clean, of_words)).where((toxic >= LEAST_CONTEXTS) & (F.col("sure") > LEAST_ODDS)).collect()
    in_toxic = {r.entry: r.toxic for r in found}
    weights: dict[str, float] = {}
    longer: dict[str, int] = {}  # for each beginning, the most contexts of an entry that it begins
    for r in sorted(found, key=lambda r: (r.toxic * r.sure, r.entry), reverse=True):  # of equal ones the longer entry
        e = r.entry
        covered = any(e[:k] in weights for k in range(5, len(e)))
        # a beginning says nothing more than the longer entry if that is nearly all it stands for
        if not covered and in_toxic[e] >= 1.2 * longer.get(e, 0):
            weights[e] = float(r.sure)
            for k in range(5, len(e)):
                longer[e[:k]] = max(longer.get(e[:k], 0), in_toxic[e])
    exceptions = phrases(rows, weights).where((toxic == 0) & (clean >= LEAST_CLEAN)).select("phrase").collect()
    lexicon = Lexicon(weights, {r.phrase for r in exceptions}, None)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, folder = lexicon.automaton(), lexicon.folder()
        for batch in batches:
            got = [lexicon.facts(t or "", made, folder) for t in batch.column(0).to_pylist()]
            w, m, n = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), pa.array(m, pa.int64()), pa.array(n, pa.int64()), batch.column(1)], names=["w", "m", "n", "y"])

    facts = rows.select("text", "y").mapInArrow(measured, "w double, m long, n long, y double").collect()  # numbers of the bounded sample
    lexicon.fitted = logistic(lexicon.inputs([(r.w, r.m, r.n) for r in facts]), np.array([r.y for r in facts]))
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, weight, matches, words, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, folder = lexicon.automaton(), lexicon.folder()
        for batch in batches:
            for first, block in texts_of(batch.column(1)).blocks():
                facts = [lexicon.facts(block.raw(i).decode("utf-8", "replace"), made, folder) for i in range(len(block))]
                w, m, n = zip(*facts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), pa.array(w, pa.float64()), pa.array(m, pa.int64()), pa.array(n, pa.int64()), pa.array(lexicon.score(facts))], names=[key, "weight", "matches", "words", "score"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, weight double, matches long, words long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = learn(training_rows(df, labels, "toxic", fold_of("doc_id", 4) != 2, "doc_id", "text", MAX_LABELLED))
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score(df, lexicon).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
