"""Token counts, the codec and packing against the tokenizers library."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quillframe.llm import bpe  # noqa: E402
from quillframe.llm.packing import cut, pack, solve  # noqa: E402
from quillframe.llm.tokens import count_tokens, encode_decode  # noqa: E402
from tests.llm.helpers import DOCS, corpus, documents, plain  # noqa: E402

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(5)
    texts = ["", "a<|endoftext|>b<|startoftext|>", "<|endoftext|>" * 3, "ΣΑΣ ς É é İ ǅ ẞß", "don't we'll I'VE", "x\x1c\x1d\x85\xa0\u200b\ufeffy", "हिन्दी ०१२ ½ Ⅳ", "🎉👍🏽 ok", "é", "".join(map(chr, range(1, 700)))]
    texts += ["".join(rng.choice("abcdetinghoureslyand") for _ in range(rng.randint(100, 4000))) for _ in range(25)]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(200)) for _ in range(25)]
    return texts


def library(text):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_counts_and_codec_match_the_library(spark):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    frame = documents(spark, rows)
    counts, codec = [], []
    for i, t in rows:
        ids, text = library(t or "")
        counts.append((i, len((t or "").encode()), len(ids), len(ids) > 2048))
        codec.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert plain(count_tokens(frame, WORDS)) == sorted(counts, key=repr)
    assert plain(encode_decode(frame, WORDS)) == sorted(codec, key=repr)


def test_the_stream_of_a_word_may_be_cut_anywhere():
    vocabulary = bpe.Vocabulary(WORDS)
    lookahead = vocabulary.lookahead()
    rng = random.Random(6)
    for text in ("".join(rng.choice("ethanoingsrlduc") for _ in range(3000)), "ab" * 2000, "é" * 1500):
        want = library(text)[0]
        for part in (1, 7, 1000):
            transducer = bpe.Transducer(vocabulary, lookahead)
            data, got, held = text.encode(), [], 0
            for at in range(0, len(data), part):
                got += transducer.feed(data[at : at + part])
                held = max(held, len(transducer.held))
            assert got + transducer.end() == want and held <= lookahead + 64


def test_memory_does_not_follow_the_text():
    """Blocks, long stretches without white space and long words give the library's ids, in parts of bounded size."""
    rng = random.Random(15)
    word = lambda n: "".join(rng.choice("ethanoingsrlduc") for _ in range(n))
    codec = bpe.Codec(WORDS)
    texts = [" ".join(word(rng.randint(1, 12)) for _ in range(40_000)), word(300_000), ",".join(word(5) for _ in range(60_000)), "\n".join("É" + word(3) + "日本" * (i % 2) for i in range(30_000)), ("ab <|endoftext|>" * 3 + word(70_000)) * 3]
    for text in texts:
        parts = list(codec.encode(text))
        ids = library(text)[0]
        assert b"".join(parts) == struct.pack(f"<{len(ids)}I", *ids)
        assert max(map(len, parts)) <= 4 * 16 * codec.WORDS
    import tracemalloc

    peaks = []
    for n in (50_000, 400_000):
        text = " ".join(word(9) + "1" for _ in range(500)) * (n // 500)
        tracemalloc.start()
        for _ in codec.encode(text):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + (1 << 20)


def test_decoding_part_by_part():
    ids, text = library("Ünïcödé 日本語 text, streamed")
    decoder = bpe.Decoder(bpe.Vocabulary(WORDS).pieces)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == text
    whole = bpe.Decoder({1: "é".encode()[:1], 2: "é".encode()[1:], 3: b"x"}, joined=False)
    assert [whole.feed([1]), whole.feed([2, 3]), whole.feed([1]), whole.end()] == ["", "éx", "", "\ufffd"]


def test_merging_counts_what_it_makes():
    vocabulary = bpe.Vocabulary(WORDS)
    for word in ("a", "the", "thanedble", "xyzzyxyzzy", "aaaaaaa"):
        assert bpe.count_word(word.encode(), vocabulary) == len(library(word)[0])


def test_counts_of_long_words_window_by_window():
    """Any window gives the count of the whole word, and memory does not follow the word."""
    import tracemalloc

    vocabulary, rng = bpe.Vocabulary(WORDS), random.Random(8)
    words = ["".join(rng.choice(letters) for _ in range(n)).encode() for letters in ("ethanoingsrlduc", "ab", "é1", "x") for n in (1, 2, 199, 200, 201, 3000)]
    for word in words:
        whole = [vocabulary.inner[b] for b in word[:-1]] + [vocabulary.last[word[-1]]]
        want = len(bpe.merge_word(whole, vocabulary.merges)[0])
        assert {bpe.count_word(word, vocabulary, w) for w in (1, 7, 200, 1024, 1 << 14)} == {want}
    long = "".join(rng.choice("ethanoingsrlduc") for _ in range(120_000))
    assert bpe.count_word(long.encode(), vocabulary) == len(library(long)[0])
    peaks = []
    for n in (1, 4):
        data = (long * n).encode()
        tracemalloc.start()
        bpe.count_word(data, vocabulary)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]


def test_pieces_and_places(spark):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    tokenizer = Tokenizer.from_file(BYTES)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    found = pack(documents(spark, rows).repartition(3), BYTES)
    assert plain(found, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in found.collect():
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x[3] for x in want)
    assert len(sequences) <= -(-total // 2048) + 2


def test_solver_places_every_piece():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        counts = {k: rng.randint(0, 30) for k in range(1, capacity + 1) if rng.random() < 0.6}
        ranges, n = solve(counts, capacity)
        by_length = defaultdict(list)
        for x in sorted(ranges):
            by_length[x[0]].append(x)
        bins = defaultdict(list)
        for length, count in counts.items():
            for rank in range(count):
                _, start, first, offset, each = [x for x in by_length[length] if x[1] <= rank][-1]
                bins[first + (rank - start) // each].append((offset + (rank - start) % each * length, length))
        assert len(bins) == n
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * length > capacity for _, length in places) <= 2


def test_cuts():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(1, 4) == [(0, 1)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert count_tokens(empty, WORDS).count() == encode_decode(empty, WORDS).count() == pack(empty, BYTES).count() == 0
