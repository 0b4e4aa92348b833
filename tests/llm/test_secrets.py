"""Secret scans against a plain version, and against the SQL."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from quillframe.llm import secrets
from quillframe.llm.registry import _secret_sql
from quillframe.llm.secrets import find_secrets
from tests.llm.helpers import corpus, documents, plain

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def key(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def texts(seed=2):
    rng = random.Random(seed)
    hexes, b64 = "0123456789abcdef", LETTERS + LETTERS.lower() + "0123456789+/"
    word = lambda: rng.choice(["alpha", "Bravo", "tokens", "http://a.example/path/with/many/parts/to/see", "état", "🎉", "long-hyphened-word-of-the-state", "Donaudampfschifffahrtsgesellschaftskapitaen", "12345678901234567890123"])
    rows = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 40))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), key(rng, b64, rng.choice([24, 40, 44, 64, 88])))
        if i % 5 == 0:
            parts.append(f"{rng.choice(['Password', 'api_key', 'APIKEY', 'secret', 'my_token'])}{rng.choice(['=', ': ', '\" : \"', ' := '])}{key(rng, b64[:62] + '._-=', rng.randint(3, 30))}")
        if i % 6 == 0:
            parts.append(key(rng, hexes, rng.choice([20, 31, 32, 64])))
        if i % 7 == 0:
            parts += ["AKIA" + key(rng, LETTERS + "0123456789", rng.choice([11, 12, 16])), key(rng, LETTERS + "234567", 52), key(rng, LETTERS.lower() + "0123456789", 50)]
        if i % 8 == 0:
            parts.append(base64.b64encode(rng.randbytes(34)).decode())
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    rows += [(100, "token=secret:abcdefgh1 token=short token=longenough1"), (101, "ſecret=abcdefghij toKen=abcdefghij"), (102, "token==abcdefgh token = 'x.y.z.1.2.3'"), (103, LETTERS + LETTERS.lower() + "0123456789"), (104, "a" * 50 + " " + "ab" * 40), (105, "0" * 40 + "f" * 40)]
    rows += [(106, key(rng, b64, 3000)), (107, "token=" + key(rng, b64[:62], 700) + "." + key(rng, b64[:62], 60)), (108, ("deadbeef" * 4 + " ") * 1500), (109, "password:" + "AKIA" + "Z" * 20), (110, "x" + key(rng, hexes, 40) + "g")]
    return rows + corpus()


def battery(run, alphabet):
    """The battery and the bin of a run, in plain arithmetic."""
    v, n, k = [alphabet.index(c) for c in run], len(run), len(alphabet)
    squares = sum(c * c for c in Counter(v).values())
    uniform = (squares * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    b = sum(x >= k // 2 for x in v)
    turns = 1 + sum((x >= k // 2) != (y >= k // 2) for x, y in zip(v, v[1:]))
    both = 2 * b * (n - b)
    runs = (turns - 1 - both / n) / math.sqrt(both * (both - n) / (n * n * (n - 1))) if both * (both - n) > 0 else 100
    around = n * sum(x * x for x in v) - sum(v) ** 2
    serial = ((n * sum(x * y for x, y in zip(v, v[1:] + v[:1])) - sum(v) ** 2) / around + 1 / (n - 1)) / math.sqrt(n * n / ((n - 1) ** 2 * (n - 2))) if around else 100
    pairs, match = n * (n - 1) / 2, max(2 / k, 1 / 18)
    text = (pairs * match - (squares - n) / 2 - 0.5) / math.sqrt(pairs * match * (1 - match))
    return uniform**2 + runs**2 + serial**2, math.floor(min(40, max(-1, text)) * 100)


def brute(rows):
    held = []
    for i, text in rows:
        text = text or ""
        base, at, pieces = [], 0, []
        for m in ASSIGN.finditer(text):
            pieces.append((at, text[at : m.start()]))
            at = m.end()
            if len(m[2]) >= 8:
                base.append((m.start(), 0, m.end()))
        pieces.append((at, text[at:]))
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        runs = []
        for at, piece in pieces:
            for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", piece):
                core = m[0].rstrip("=")
                if re.fullmatch("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}|[0-9]+", core):
                    continue
                e = next(e for e, (_, p, _, _) in enumerate(secrets.ENCODINGS) if re.match(p, core))
                alphabet = secrets.ENCODINGS[e][2]
                run = core.lower() if secrets.ENCODINGS[e][3] else core.replace("-", "+").replace("_", "/")
                runs.append((at + m.start(), at + m.end(), (e, sum(x < len(core) for x in secrets.LENGTHS)), *battery(run, alphabet)))
        held.append((i, sorted(base), runs))
    strata = {}
    for _, _, runs in held:
        for *_, stratum, _, bin_ in runs:
            strata.setdefault(stratum, []).append(bin_)
    least = {}
    for stratum, bins in strata.items():
        fits = [b for b in bins if math.erfc(b / 100 / math.sqrt(2)) / 2 * len(bins) <= 0.05 * sum(x >= b for x in bins)]
        least[stratum] = min(fits, default=10**9)
    out = []
    name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    for i, base, runs in held:
        extra = [(a, 3, b) for a, b, stratum, squares, bin_ in runs if squares <= 16.27 and bin_ >= least[stratum]]
        out.append((i, *(sum(b[1] == k for b in base) for k in range(3)), hashlib.sha256(name(base).encode()).hexdigest(), name(base + extra), len(extra)))
    return sorted(out, key=repr)


def test_find_secrets(spark):
    rows = texts()
    found = plain(find_secrets(documents(spark, rows).repartition(3)))
    assert found == brute(rows)
    assert sum(r[-1] for r in found) > 25


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    b64 = LETTERS + LETTERS.lower() + "0123456789+/"
    keys = [(i, f"see {key(rng, b64, 44)} there") for i in range(200)]
    words = [(1000 + i, "-".join(rng.choice("state of the art system with many words in it and more".split()) for _ in range(9))) for i in range(200)]
    found = {r.doc_id: r.n_random for r in find_secrets(documents(spark, keys + words)).collect()}
    assert sum(found[i] for i, _ in keys) >= 195 and sum(found[i] for i, _ in words) == 0


def test_sql_agrees(spark):
    rows = texts(9)
    mine = documents(spark, rows)
    connection = duckdb.connect()
    given = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    connection.execute("CREATE TABLE documents AS SELECT * FROM given")
    assert plain(find_secrets(mine).drop("n_random")) == sorted(map(tuple, connection.execute(_secret_sql()).fetchall()), key=repr)


def test_sums_of_long_arrays(spark):
    frame = spark.range(1).select(F.sequence(F.lit(1).cast("long"), F.lit(1300).cast("long")).alias("v"), F.array().cast("array<bigint>").alias("none"))
    row = frame.select(secrets.running_sums(F.col("v")).alias("s"), secrets.running_sums(F.col("none")).alias("e")).first()
    assert row.s == [i * (i + 1) // 2 for i in range(1, 1301)] and row.e == []


def test_plan_has_no_python_and_shuffles_no_text(spark):
    plan = find_secrets(documents(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert find_secrets(documents(spark, [])).count() == 0
