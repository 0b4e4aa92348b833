"""Small documents for every case that an operator has to define, with columns whose names clash with results."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, kept boolean, row int, n string, rep long, score double, length int, id int, n_entities int, found string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, False, 1, "x", 7, 0.5, 3, 9, 2, "y") for i, t in rows], DOCS)


def corpus(seed=1):
    """Copies, near copies, repeated rows and ids, nulls, blanks, ties, long texts, shared passages, other scripts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if i % 5 == 0:
            text[3:3] = passage
        rows.append((i, " ".join(text)))
    base = [rng.choice(words) for _ in range(150)]
    for i in range(60, 75):
        copy = base[:]
        for _ in range(i - 60):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, "\n".join(copy)))
    rows += [(80, None), (81, ""), (82, " \t\n\r\x0b\x0c"), (83, "a"), (84, "A"), (85, "one two three four five"), (86, "one  two\tthree four five "), (87, "É é 日本語 🎉 ½"), (88, "x" * 5000)]
    rows += [(90, "same text"), (91, "sametext"), (92, " same text "), (93, " same text "), (90, "same text"), (90, "same text"), (90, "another text of the same id"), (None, "same text"), (None, None), (None, "only here")]
    rows += [(95, " ".join(rng.choice(words) for _ in range(30_000))), (96, "<|endoftext|> in a text <|startoftext|>"), (97, "a " * 300)]
    rng.shuffle(rows)
    return rows


def plain(frame, *columns):
    return sorted((tuple(r[c] for c in columns or frame.columns) for r in frame.collect()), key=repr)
