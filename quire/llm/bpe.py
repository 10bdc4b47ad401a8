"""A byte-pair transducer with bounded lookahead, and the decoder's state machine.

Merging lowest rank first looks at a whole word, but what stands far to the right can't
change what happens on the left: news travels left only through merges of rising rank, each
over the left neighbour. `sufficient_lookahead` is the longest way any such chain of the
merge list can take. A word is read through a buffer; tokens that end `lookahead` symbols or
more before the buffer's end are final, are emitted, and reading goes on after them. (Where
no merge crosses a boundary, both sides merge as they would alone.) Memory is the buffer.

A text is read in pieces of PIECE characters, cut after white space, or inside a word that
fills a piece, before a character that composes with nothing to its left. `Reader` carries
what a cut leaves open from piece to piece: the word being merged, and an apostrophe that
may begin a contraction. Decoding is a machine of its own, fed piece by piece as well.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

#: Characters that are read at a time.
PIECE = 1 << 16


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """merges: (left, right, product) by rank; size: bytes of each token."""
    way: dict[int, int] = {}  # longest chain that may change whether a token stands at a place
    most = 0
    for left, right, product in merges:
        here = size[product] + way.get(right, 0)
        most = max(most, here)
        way[left] = max(way.get(left, 0), here)
        way[product] = max(way.get(product, 0), here)
    return most


class Transducer:
    """Encoding and decoding by the JSON definition of a byte-level BPE tokenizer with word ends."""

    def __init__(self, definition: bytes, spare: int = 256, remember: int = 500_000, piece: int = PIECE):
        spec = json.loads(definition)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + self.suffix] for c in chars]
        size = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        strip = lambda a: a.removesuffix(self.suffix) if self.suffix else a
        merges = [(vocab[a], vocab[b], vocab[strip(a) + b]) for a, b in pairs]
        self.merges = {(a, b): (rank, c) for rank, (a, b, c) in reversed(list(enumerate(merges)))}
        self.lookahead = sufficient_lookahead(merges, size)
        self.room = 2 * self.lookahead + spare
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+")
        self.runs = {"letters": regex.compile(r"\p{L}*"), "others": regex.compile(rf"[^{WHITE_SPACE}\p{{L}}\p{{N}}]*")}
        self.known: dict[str, bytes] = {}
        self.piece = piece
        self.remember = remember
        self.joined = spec.get("decoder") is None
        back = {c: b for b, c in enumerate(chars)}
        text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        top = max(text) + 1
        if self.joined:  # without a decoder tokens are written as they are, with spaces between
            self.bytes_of = [text.get(i, "").encode() for i in range(top)]
        else:
            self.bytes_of = [bytes(back[c] for c in strip(text.get(i, ""))) if text.get(i, "") not in self.special else text[i].encode() for i in range(top)]

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        n, merges = len(ids), self.merges
        if n <= 24:
            ids = list(ids)
            while len(ids) > 1:
                best, at = None, 0
                for k in range(len(ids) - 1):
                    got = merges.get((ids[k], ids[k + 1]))
                    if got and (best is None or got < best):
                        best, at = got, k
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(ids)
        heap = [(got[0], k, ids[k], ids[k + 1], got[1]) for k in range(n - 1) if (got := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, c = heapq.heappop(heap)
            j = after[k]
            if alive[k] != a or j >= n or alive[j] != b:
                continue
            alive[k], alive[j] = c, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if got := merges.get((c, alive[after[k]])):
                    heapq.heappush(heap, (got[0], k, c, alive[after[k]], got[1]))
            if (p := before[k]) >= 0 and (got := merges.get((alive[p], c))):
                heapq.heappush(heap, (got[0], p, alive[p], c, got[1]))
        return [x for x in alive if x >= 0]

    def word(self, data: bytes) -> list[int]:
        word = WordStream(self)
        return word.feed(data) + word.end()

    def width(self, token: int) -> int:
        if not hasattr(self, "widths"):
            self.widths: dict[int, int] = dict.fromkeys(self.inner, 1)
            for (a, b), (_, c) in sorted(self.merges.items(), key=lambda m: m[1]):
                self.widths[c] = self.widths.get(a, 1) + self.widths.get(b, 1)
        return self.widths[token]

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case is taken letter by letter, without regard to word ends
                text = text.replace("Σ", "σ")
        return text.lower()

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            pass
        if len(known) > self.remember:
            known.clear()
        out = []
        for w in words:
            got = known.get(w)
            if got is None:
                got = packed(self.word(w.encode()))
                if len(w) <= 64:
                    known[w] = got
            out.append(got)
        return out

    def cut_before(self, text: str, at: int) -> int:
        """Where the piece of a text that begins at `at` ends."""
        end = at + self.piece
        if end >= len(text):
            return len(text)
        space = max(text.rfind(c, at, end) for c in " \n\t")
        if space >= 0:
            return space + 1
        for p in range(end, at, -1):
            if composes_left(text[p]):
                continue
            for s in self.special:  # their strings have no white space, and stay whole
                found = text.find(s, max(at, p - len(s) + 1), p + len(s) - 1)
                if at < found < p:
                    p = found
                elif found == at and p < at + len(s):
                    return at + len(s)
            return p
        return next((p for p in range(end + 1, len(text)) if not composes_left(text[p])), len(text))

    def pieces(self, text: str) -> Iterator[list[bytes]]:
        """Packed ids of a text, piece by piece, as soon as they are stable."""
        reader, at, n = Reader(self), 0, len(text)
        while at < n:
            upto = self.cut_before(text, at)
            piece = text[at:upto] if at or upto < n else text
            out: list[bytes] = []
            if self.cut is not None and any(s in piece for s in self.special):
                start = 0
                for m in self.cut.finditer(piece):
                    out += reader.feed(piece[start : m.start()])
                    out += reader.end()
                    out.append(packed([self.special[m[0]]]))
                    start = m.end()
                piece = piece[start:]
            out += reader.feed(piece)
            at = upto
            yield out
        yield reader.end()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([b"".join(ids) for ids in self.pieces(text)])

    def decoder(self) -> ByteDecoder:
        return ByteDecoder(self.bytes_of, b" " if self.joined else b"")

    def decode(self, ids: Iterable[int]) -> str:
        machine = self.decoder()
        return machine.feed(ids) + machine.end()


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def composes_left(c: str) -> bool:
    """Whether normalisation may join the character with what stands before it: marks, and Hangul vowels and finals."""
    return not c.isascii() and ("\u1160" <= c <= "\u11ff" or unicodedata.category(c)[0] == "M")


class WordStream:
    """Bytes of one word in, tokens out once nothing to their right can change them."""

    def __init__(self, machine: Transducer):
        self.machine, self.buffer = machine, b""

    def feed(self, data: bytes) -> list[int]:
        m, self.buffer = self.machine, self.buffer + data
        out: list[int] = []
        while len(self.buffer) > m.room:
            stable, used = m.room - m.lookahead, 0
            for token in m.merge([m.inner[b] for b in self.buffer[: m.room]]):
                if used + m.width(token) > stable:
                    break
                used += m.width(token)
                out.append(token)
            self.buffer = self.buffer[used:]
        return out

    def end(self) -> list[int]:
        m, data, self.buffer = self.machine, self.buffer, b""
        if not data:
            return []
        return m.merge([*(m.inner[b] for b in data[:-1]), m.final[data[-1]]])


class Reader:
    """Pieces of a text in, packed ids out; holds the word that a piece leaves open."""

    def __init__(self, machine: Transducer):
        self.machine, self.open, self.word, self.held = machine, "", WordStream(machine), ""

    def feed(self, piece: str) -> list[bytes]:
        m = self.machine
        text = self.held + m.normalized(piece)
        self.held = ""
        out: list[bytes] = []
        if self.open:  # the class of the word that goes on here
            run = m.runs[self.open].match(text)[0]
            out.append(packed(self.word.feed(run.encode())))
            if len(run) == len(text):
                return out
            out += self.end()
            text = text[len(run) :]
        if not text or text[-1] in " \n\t":
            return out + m.ids_of(m.words.findall(text))
        found = list(m.words.finditer(text))
        last = [w[0] for w in found if w.end() == len(text)]
        if not last:
            return out + m.ids_of([w[0] for w in found])
        before = found[-2] if len(found) > 1 and found[-2].end() == found[-1].start() else None
        if last[0] == "'" or (before and before[0] == "'" and last[0] in ("r", "v", "l")):
            self.held = "'" if last[0] == "'" else "'" + last[0]
            found = found[: -len(self.held)]
        elif kind := next((k for k, run in m.runs.items() if run.fullmatch(last[0])), ""):  # neither a digit nor a contraction
            found.pop()
            self.open = kind
            out += m.ids_of([w[0] for w in found])
            return [*out, packed(self.word.feed(last[0].encode()))]
        return out + m.ids_of([w[0] for w in found])

    def end(self) -> list[bytes]:
        """What the end of the text, or a special token, makes stable."""
        out = []
        if self.open:
            out.append(packed(self.word.end()))
            self.open = ""
        if self.held:
            out += self.machine.ids_of(self.machine.words.findall(self.held))
            self.held = ""
        return out


class ByteDecoder:
    """Tokens in, text out as soon as its bytes are complete; at most 3 bytes are held back.

    The state is the part of a character that is still open and whether a token came before,
    for definitions whose tokens are written with `between` them.
    """

    def __init__(self, bytes_of: list[bytes], between: bytes = b""):
        self.bytes_of, self.between, self.begun = bytes_of, between, False
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        tokens = [self.bytes_of[i] for i in ids]
        if not tokens:
            return ""
        data = self.between.join(tokens)
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", final=True)
