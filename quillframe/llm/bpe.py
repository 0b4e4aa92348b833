"""Byte-pair encoding by vocabulary files of the tokenizers library whose words end in ``</w>``.

Three parts: ``Words`` cuts a text into the words that the file's normaliser and pre-tokeniser give; ``count_word``
counts tokens by heap-and-linked-list merging without making any; ``Transducer`` emits tokens from a stream of
symbols with bounded lookahead. ``Decoder`` turns a stream of ids into text again.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice

import regex

#: Words that a cache holds before it starts anew; at some 150 bytes each.
CACHE_WORDS = 400_000

# The pre-tokeniser pattern of the file, with the white space of its engine spelled out.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges of a file as integers: ``merges[left << 20 | right] = rank << 20 | product``."""

    def __init__(self, path: str):
        self.file = json.load(open(path, encoding="utf-8"))
        model = self.file["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or self.file["pre_tokenizer"]["pretokenizers"][1]["type"] != "ByteLevel":
            raise ValueError(f"{path}: a byte-level BPE file with word ends is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"])]
        self.merges = {a << 20 | b: rank << 20 | c for rank, (a, b, c) in reversed(list(enumerate(self.pairs)))}
        alphabet = byte_alphabet()
        self.inner = [self.ids[c] for c in alphabet]
        self.last = [self.ids[c + "</w>"] for c in alphabet]
        self.specials = {x["content"]: x["id"] for x in self.file["added_tokens"]}
        self.pieces = {i: s.encode() for s, i in (self.ids | self.specials).items()}

    @cached_property
    def reach(self) -> int:
        """The lookahead, computed once."""
        return self.lookahead()

    def lookahead(self) -> int:
        """How many symbols the end of the known part of a word can reach back, whatever follows.

        A change beyond the end reaches back by a chain of merges: a rule that is newly possible, or no longer,
        takes the token on its left with it; next, at a later rank, the rule whose right operand was that token, or
        is its product, is blocked or made possible. Each link reaches back by the length of its left operand, so
        the bound is the heaviest chain of rules with rising ranks: one pass over the rules from the last to the first.
        This needs merges whose operands are made by earlier ones, which is checked.
        """
        made, length = {}, {**dict.fromkeys(self.inner, 1), **dict.fromkeys(self.last, 1)}
        for rank, (a, b, c) in enumerate(self.pairs):
            if a not in length or b not in length or made.setdefault(c, rank) != rank:
                raise ValueError("the merge list is not proper: an operand comes later than its use, or a token has two rules")
            length[c] = length[a] + length[b]
        reach: dict[int, int] = {}
        for a, b, c in reversed(self.pairs):
            own = length[a] + max(reach.get(a, 0), reach.get(c, 0))
            reach[b] = max(reach.get(b, 0), own)
        return 1 + max(reach.values(), default=0)  # one more: whether a symbol ends its word shows with the next


class Words:
    """Cuts texts as the library does: special strings, then normaliser, then pre-tokeniser.

    Texts of Latin, Greek, Cyrillic and common punctuation take a regular expression; any other text takes the
    library's own normaliser and pre-tokeniser, whose Unicode tables may differ from those here.
    """

    def __init__(self, path: str, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(vocabulary.specials, key=len, reverse=True)))
        self.common = regex.compile(r"[\x00-\u02ff\u0370-\u0373\u0391-\u03a1\u03a4-\u03c1\u03c3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u2122]*+")
        self.find, self.each, self.white = regex.compile(PIECES).findall, regex.compile(PIECES).finditer, regex.compile(r"[ \t\n\r]")
        self.back = {c: b for b, c in enumerate(byte_alphabet())}

    #: Characters of a block of text; words of up to so many characters are one item, longer ones are cut where they are used.
    BLOCK = 1 << 16

    def blocks(self, text: str, at: int = 0, to: int | None = None) -> Iterator[str]:
        """``text[at:to]`` in blocks that end before white space, where no word, and no character that others combine with, goes on."""
        to = len(text) if to is None else to
        while at < to:
            end = at + self.BLOCK
            if end < to:
                found = self.white.search(text, end, to)
                end = found.start() if found else to
            yield text[at : min(end, to)]
            at = min(end, to)

    def segments(self, text: str) -> Iterator[tuple[str | None, Iterable]]:
        """(special string or None, words after it), block by block. Words are strings, or bytes where the library cut them."""
        at, before = 0, None
        for found in self.special.finditer(text) if "<|" in text else ():
            yield before, ()
            for block in self.blocks(text, at, found.start()):
                yield None, self.words(block)
            at, before = found.end(), found[0]
        yield before, ()
        for block in self.blocks(text, at):
            yield None, self.words(block)

    def words(self, text: str) -> Iterable:
        if self.common.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            text = text.lower()
            # A block is longer only where it is one stretch without white space, whose words are then found one by one.
            return self.find(text) if len(text) <= 2 * self.BLOCK else (x[0] for x in self.each(text))
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.back[c] for c in word) for word, _ in cut]


def merge_word(symbols: list[int], merges: dict[int, int]) -> tuple[list[int], list[int]]:
    """Merge adjacent pairs, lowest rank first and leftmost among equals: (tokens, symbols in each).

    Tokens stand in a doubly linked list over the positions; a heap holds (rank, position) of adjacent pairs as one
    integer. A pair that is no longer there when popped is skipped.
    """
    n = len(symbols)
    if n == 1:
        return symbols, [1]
    tokens, get = symbols[:], merges.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (found := get(tokens[i] << 20 | tokens[i + 1])) is not None:
            heap.append(found >> 20 << 40 | i)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFFFF
        if tokens[i] < 0 or (j := after[i]) >= n or (found := get(tokens[i] << 20 | tokens[j])) is None or found >> 20 != top >> 40:
            continue
        tokens[i], tokens[j] = found & 0xFFFFF, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := get(tokens[i] << 20 | tokens[k])) is not None:
                push(heap, found >> 20 << 40 | i)
        if (h := before[i]) >= 0 and (found := get(tokens[h] << 20 | tokens[i])) is not None:
            push(heap, found >> 20 << 40 | h)
    out, lengths, i = [], [], 0
    while i < n:
        out.append(tokens[i])
        lengths.append(after[i] - i)
        i = after[i]
    return out, lengths


def _merged(tokens: list[int], merges: dict[int, int]) -> tuple[list[int], int]:
    """Merge within ``tokens``, in place: (where the token after each one begins, merges made)."""
    n, get = len(tokens), merges.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [found >> 20 << 40 | i for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (found := get(a << 20 | b)) is not None]
    heapq.heapify(heap)
    pop, push, done = heapq.heappop, heapq.heappush, 0
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFFFF
        a = tokens[i]
        if a < 0 or (j := after[i]) >= n or (found := get(a << 20 | tokens[j])) is None or found >> 20 != top >> 40:
            continue
        done += 1
        tokens[i], tokens[j] = (a := found & 0xFFFFF), -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := get(a << 20 | tokens[k])) is not None:
                push(heap, found >> 20 << 40 | i)
        if (h := before[i]) >= 0 and (found := get(tokens[h] << 20 | a)) is not None:
            push(heap, found >> 20 << 40 | h)
    return after, done


#: Symbols of a word that are held as lists at once, some 123 bytes each; longer words are counted window by window.
WINDOW = 1 << 14


def count_word(data: bytes, vocabulary: Vocabulary, window: int = WINDOW) -> int:
    """Tokens of one word: its symbols minus the merges that the heap-and-linked-list process makes. No ids are emitted.

    Of a word longer than ``window`` as many symbols are held and merged at a time. Tokens that end at least the
    lookahead of the merge list before the end of the window stay as they are, so their merges are counted; the
    symbols behind them begin the next window.
    """
    n, merges, inner = len(data), vocabulary.merges, vocabulary.inner
    if n < 2:
        return n
    if n <= window:
        tokens = [inner[b] for b in data]
        tokens[-1] = vocabulary.last[data[-1]]
        return n - _merged(tokens, merges)[1]
    held, done = [], 0
    for at in range(0, n, window):
        held += [inner[b] for b in data[at : at + window]]
        if at + window >= n:
            held[-1] = vocabulary.last[data[-1]]
            done += _merged(held, merges)[1]
            break
        after, stable = _merged(held[:], merges)[0], len(held) - vocabulary.reach
        taken = 0
        while taken < len(held) and after[taken] <= stable:
            done += after[taken] - taken - 1
            taken = after[taken]
        del held[:taken]
    return n - done


class Counts(dict):
    """Token counts by word, as ``counts[word]``; bounded, as a long tail of words never comes again."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = count_word(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"), self.vocabulary)
        if len(word) <= 64:
            self[word] = n
        return n


class Transducer:
    """Byte-pair encoding of a word that arrives in parts, in constant memory.

    At most ``lookahead`` plus one part of symbols are held. A token is emitted once it ends at least ``lookahead``
    symbols before the end of what is known; by the bound it then stays as it is whatever follows, and what follows it
    merges as if it stood alone. Tokens that are not stable yet wait as symbols.
    """

    PART = 1024

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None):
        self.vocabulary = vocabulary
        self.lookahead = vocabulary.lookahead() if lookahead is None else lookahead
        self.held: list[int] = []

    def feed(self, data: bytes) -> list[int]:
        """Take the next bytes of the word; returns the tokens that are stable now."""
        inner, out = self.vocabulary.inner, []
        for at in range(0, len(data), self.PART):
            self.held += [inner[b] for b in data[at : at + self.PART]]
            spare = len(self.held) - self.lookahead
            if spare <= 0:
                continue
            taken = 0
            for token, length in zip(*merge_word(self.held, self.vocabulary.merges)):
                if taken + length > spare:
                    break
                out.append(token)
                taken += length
            del self.held[:taken]
        return out

    def end(self) -> list[int]:
        """The word is over; returns the rest of its tokens."""
        if not self.held:
            return []
        held, self.held = self.held, []
        held[-1] = self.vocabulary.last[self.vocabulary.inner.index(held[-1])]
        return merge_word(held, self.vocabulary.merges)[0]


class Encodings(dict):
    """Ids by word, as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        data = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
        ids = little_endian(self.transducer.feed(data) + self.transducer.end())
        if len(word) <= 64:
            self[word] = ids
        return ids


def little_endian(ids: Iterable[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def as_array(data: bytes) -> array:
    out = array("I", data)
    if sys.byteorder == "big":
        out.byteswap()
    return out


class Decoder:
    """Ids to text, part by part: ids give bytes, and a UTF-8 state machine gives the text that is complete so far.

    A file without a decoder has its tokens joined by one space, as the library does. For a byte-level decoder the
    tokens' bytes follow each other. At most three bytes wait for the rest of their character.
    """

    def __init__(self, pieces: dict[int, bytes], joined: bool = True):
        self.pieces, self.gap, self.begun = pieces, b" " if joined else b"", False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self.gap.join(map(self.pieces.__getitem__, ids))
        lead = self.gap if self.begun and data else b""
        self.begun = self.begun or bool(data)
        return self.machine.decode(lead + data)

    def end(self) -> str:
        return self.machine.decode(b"", True)


class Codec:
    """Whole texts through the transducer and back."""

    #: Words that are joined at once; longest word that is encoded at once.
    WORDS, LONG = 1 << 12, 1 << 12

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = Words(path, self.vocabulary)
        self.encodings = Encodings(Transducer(self.vocabulary))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of ``text``, in parts whose size does not depend on the text."""
        get = self.encodings.__getitem__
        for special, words in self.words.segments(text):
            if special:
                yield little_endian([self.vocabulary.specials[special]])
            words = iter(words)
            while part := list(islice(words, self.WORDS)):
                if max(map(len, part)) <= self.LONG:
                    yield b"".join(map(get, part))
                else:
                    for word in part:
                        yield from (get(word),) if len(word) <= self.LONG else self.stream(word)

    def stream(self, word: str | bytes) -> Iterator[bytes]:
        """Ids of one long word, as they become stable."""
        transducer = self.encodings.transducer
        for at in range(0, len(word), self.LONG):
            part = word[at : at + self.LONG]
            yield little_endian(transducer.feed(part if isinstance(part, bytes) else part.encode("utf-8", "surrogatepass")))
        yield little_endian(transducer.end())

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(ids, sha256 of the ids, sha256 of the decoded text)."""
        decoder, n, ids_sha, text_sha = Decoder(self.vocabulary.pieces, self.words.library.decoder is None), 0, hashlib.sha256(), hashlib.sha256()
        for part in self.encode(text):
            n += len(part) // 4
            ids_sha.update(part)
            text_sha.update(decoder.feed(as_array(part)).encode())
        text_sha.update(decoder.end().encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()
