"""Secret scans: fixed forms, and a battery of randomness tests for everything else.

Built-in functions only. Three fixed forms (assignments, access keys, long hex) give the base spans. The pieces of text
between assignments are then cut into long runs of key characters, and each run is put to a battery under its inferred encoding:
chi-squared uniformity of its symbols, runs above and below the middle of the alphabet, and serial correlation. A run is a
secret if the battery does not reject randomness, and if text is rejected as its source: symbols of words meet themselves more often than
random ones, and the Benjamini-Hochberg procedure, within each encoding and class of lengths, bounds the share of false
discoveries among all runs of the corpus.

Texts are read once and never shuffled. What the procedure needs of all runs is a histogram of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import let
from quillframe.llm.common import durable

#: The fixed forms, in the order in which spans at one place are listed. ``assign`` takes letters in either case.
_ANY = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_KEYWORDS = "|".join(map(_ANY, ("password", "passwd", "secret", "token", "api_?key")))
FORM = rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The same with a look ahead at the first letter, which passes over most places at once.
ASSIGN = f"(?=[apstAPST]){FORM}"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8

#: Runs of key characters that are put to the battery, with the padding of their encoding.
RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by the narrowest alphabet that holds a run: name, pattern of the run, alphabet, and whether case is folded. Runs of digits
#: alone are numbers; as random as a key, but no key.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", True),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", False),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, True),
    ("base62", "^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS, False),
    ("base64", "^[0-9A-Za-z+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/", False),
)
#: Upper ends of the classes of lengths in which discoveries are controlled.
LENGTHS = (24, 32, 48, 64, 96, 128, 256, 1024)
#: The battery rejects randomness beyond this sum of three squared standard scores: chi-squared of three degrees, one in a thousand.
BATTERY = 16.27
#: Expected share of false discoveries; parts of a standard score that the histogram tells apart, and its last bin.
RATE, STEPS, LAST = 0.05, 100, 4000
#: Two symbols of a text are equal at least this often: words use some 18 letters at most, as if all were equally frequent.
TEXT_MATCH = 1 / 18
#: Elements that are summed up, or characters that are cut out, at a time: work grows with the text, not with its square.
CHUNK = 512


def running_sums(values: Column) -> Column:
    """Sums of a long array up to and with each element, chunk by chunk."""

    def sums(part: Column, start: Column) -> Column:
        grown = F.aggregate(part, F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("all")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")))
        return grown["all"]

    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    count = F.floor((F.size(values) + CHUNK - 1) / CHUNK).cast("int")
    parts = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<bigint>>"))

    def chained(p: Column) -> Column:
        ends = sums(F.transform(p, total), F.lit(0).cast("long"))
        return let(ends, lambda e: F.flatten(F.transform(p, lambda part, i: sums(part, F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(e, i - 1))))))

    return let(parts, chained)


def _spans(text: Column, pattern: str, found: Column, at: Column | None = None) -> Column:
    """array<struct<start, end, found>> in code points of the non-overlapping matches, whose texts are ``found``; ``at`` is the place of ``text``."""
    none = F.array().cast("array<struct<start: bigint, end: bigint, found: string>>")
    length = lambda s: F.length(s).cast("long")
    gaps = F.transform(F.split(text, pattern, -1), length)
    steps = F.zip_with(gaps, F.transform(found, length), lambda g, m: F.coalesce(g, F.lit(0)) + F.coalesce(m, F.lit(0)))
    start = F.lit(0).cast("long") if at is None else at
    placed = let(running_sums(steps), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - length(m) + start).alias("start"), (F.get(ends, i) + start).alias("end"), m.alias("found"))))
    return F.when(F.size(found) > 0, placed).otherwise(none)


def _symbol_counts(run: Column, alphabet: str) -> Column:
    """How often each symbol of the alphabet occurs; one pass over the run for each."""
    return F.transform(F.array(*map(F.lit, alphabet)), lambda c: (F.length(run) - F.length(F.replace(run, c, F.lit("")))).cast("double"))


def _products(run: Column, alphabet: str) -> Column:
    """The sum of the products of neighbouring symbols' numbers, the last with the first; exact, in chunks."""
    number = lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double")
    numbers = lambda s: F.transform(F.split(s, ""), number)

    def inner(part: Column) -> Column:
        pair = F.zip_with(part, F.slice(part, F.lit(2), F.size(part)), lambda a, b: a * F.coalesce(b, F.lit(0.0)))
        return F.aggregate(pair, F.lit(0.0), lambda a, x: a + x)

    edges = F.transform(F.regexp_extract_all(run, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda s: let(numbers(s), lambda p: F.struct(F.get(p, F.lit(0)).alias("first"), F.element_at(p, -1).alias("last"), inner(p).alias("sum"))))

    def joined(e: Column) -> Column:
        across = F.zip_with(e, F.concat(F.slice(e, F.lit(2), F.size(e)), F.slice(e, F.lit(1), F.lit(1))), lambda a, b: a["sum"] + a["last"] * b["first"])
        return F.aggregate(across, F.lit(0.0), lambda a, x: a + x)

    return let(edges, joined)


def _scores(run: Column, alphabet: str) -> Column:
    """struct(battery, bin): the sum of the squared scores of the three tests, and how far the run is from text, in steps."""
    k, mean = len(alphabet), (len(alphabet) - 1) / 2
    match = max(2 / k, TEXT_MATCH)
    n = F.length(run).cast("double")
    fold = lambda values, term: F.aggregate(values, F.lit(0.0), lambda a, x: a + term(x))
    weighted = lambda counts, power: F.aggregate(F.zip_with(counts, F.sequence(F.lit(0), F.lit(k - 1)), lambda c, v: c * (v if power == 1 else v * v)), F.lit(0.0), lambda a, x: a + x)
    half = F.translate(run, alphabet, "a" * (k // 2) + "b" * (k - k // 2))
    b = F.length(F.replace(half, F.lit("a"), F.lit(""))).cast("double")
    turns = F.length(F.regexp_replace(half, "a+|b+", "x")).cast("double")

    def scored(s: Column) -> Column:
        n, equal, turns, b = s["n"], s["squares"], s["turns"], s["b"]
        chi = equal * k / n - n
        uniform = (chi - (k - 1)) / F.sqrt((n - 1) * (2.0 * (k - 1)) / n)
        both = b * (n - b) * 2.0
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (turns - 1 - both / n) / F.sqrt(spread)).otherwise(100.0)  # one side only
        around = n * s["square"] - s["sum"] * s["sum"]
        serial = F.when(around > 0, ((n * s["product"] - s["sum"] * s["sum"]) / around + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n).otherwise(100.0)
        pairs, met = n * (n - 1) / 2, (equal - n) / 2
        text = (pairs * match - met - 0.5) / F.sqrt(pairs * match * (1 - match))
        return F.struct((uniform * uniform + runs * runs + serial * serial).alias("battery"), F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(LAST / STEPS), text)) * STEPS).cast("int").alias("bin"))

    facts = let(_symbol_counts(run, alphabet), lambda c: F.struct(n.alias("n"), fold(c, lambda x: x * x).alias("squares"), weighted(c, 1).alias("sum"), weighted(c, 2).alias("square"), turns.alias("turns"), b.alias("b"), _products(run, alphabet).alias("product")))
    return let(facts, scored)


def _judged(run: Column) -> Column:
    """struct(start, end, encoding, length, battery, bin) of a run; null for numbers, and for what the fixed forms have found."""
    core = F.regexp_replace(run["found"], "=+$", "")
    encoding = F.lit(None).cast("int")
    for i, (_, pattern, _, _) in reversed(list(enumerate(ENCODINGS))):
        encoding = F.when(core.rlike(pattern), F.lit(i)).otherwise(encoding)
    known = core.rlike(f"^(?:{ACCESS}|{HEX}|[0-9]+)$")

    def scores(s: Column) -> Column:
        out = F.lit(None).cast("struct<battery: double, bin: int>")
        for i, (_, _, alphabet, folded) in enumerate(ENCODINGS):
            text = F.lower(s["core"]) if folded else F.translate(s["core"], "-_", "+/")
            out = F.when(s["encoding"] == i, _scores(text, alphabet)).otherwise(out)
        return out

    def struct(s: Column) -> Column:
        size = F.length(s["core"])
        length = F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda x: x < size))
        return let(scores(s), lambda x: F.struct(run["start"].alias("start"), run["end"].alias("end"), s["encoding"].alias("encoding"), length.alias("length"), x["battery"].alias("battery"), x["bin"].alias("bin")))

    return F.when(~known, let(F.struct(core.alias("core"), encoding.alias("encoding")), struct))


def _tail(z: Column) -> Column:
    """The chance of a normal score of ``z`` or more: a polynomial (to 8e-8) up to 4, the bound by the density beyond."""
    a = F.abs(z)
    t = 1.0 / (a * 0.2316419 + 1.0)
    density = F.exp(-a * a / 2.0) / 2.5066282746310002
    # Coefficients of the polynomial for the normal integral.
    poly = ((((t * 1.330274429 - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t
    return F.when(z < 0, 1.0 - density * poly).when(z > 4, density / a).otherwise(density * poly)


def discoveries(runs: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, length, least): the lowest bin that the Benjamini-Hochberg procedure accepts, where there is one.

    Within each encoding and class of lengths, every run of the corpus is a hypothesis ("this is text"), repeated ones too.
    Chances are those of a bin's lower end, which is the higher one. The counts have at most 45 classes of ``LAST`` bins, whatever the corpus.
    """
    counts = runs.groupBy("encoding", "length", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("encoding", "length").orderBy(F.desc("bin"))
    whole = Window.partitionBy("encoding", "length")
    ranked = counts.withColumns({"above": F.sum("n").over(down), "all": F.sum("n").over(whole)})
    fits = _tail(F.col("bin").cast("double") / STEPS) * F.col("all") <= F.col("above") * rate
    return ranked.where(fits).groupBy("encoding", "length").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long.

    Spans are ``kind:start:end`` by start, then kind (assign, access, hex, random), joined by commas; places count code points,
    ends are exclusive. ``base_sha256`` is of the first three kinds alone, in lowercase hex. Base spans are whole matches, leftmost and non-overlapping
    within each kind; those of different kinds may overlap. ``random`` spans are runs of 20 key characters and more
    outside assignments; runs that are an access key or long hex, or digits only, are none.

    Null and empty texts have no spans (an empty string). A row stands for itself: repeated rows and ids have a row each, and
    a null id stays null. Whether a run is a discovery depends on all runs of the table, in each encoding and class of
    lengths, so copies of a document agree. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    all_of = lambda s, pattern: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("s")).withColumns({"assigned": all_of(F.col("s"), ASSIGN), "access": all_of(F.col("s"), ACCESS), "hex": all_of(F.col("s"), HEX)})
    # What lies between assignments, with its place: the whole text where there are none.
    none = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("s").alias("piece")))

    def pieces(spans: Column) -> Column:
        at = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["end"])
        return F.transform(F.split("s", ASSIGN, -1), lambda p, i: F.struct(at(i).alias("at"), p.alias("piece")))

    placed = read.withColumn("assigns", _spans(F.col("s"), ASSIGN, F.col("assigned"))).withColumn("pieces", F.when(F.size("assigned") > 0, pieces(F.col("assigns"))).otherwise(none))
    runs_of = lambda p: let(all_of(p["piece"], RUN), lambda found: _spans(p["piece"], RUN, found, p["at"]))
    kept = F.filter("assigns", lambda a: F.length(F.regexp_extract(a["found"], ASSIGN, 2)) >= LEAST_VALUE)
    bare = lambda spans, kind: F.transform(spans, lambda a: F.struct(a["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), a["end"].alias("end")))
    base = F.array_sort(F.concat(bare(kept, "assign"), bare(_spans(F.col("s"), ACCESS, F.col("access")), "access"), bare(_spans(F.col("s"), HEX, F.col("hex")), "hex")))
    judged = F.array_compact(F.transform(F.flatten(F.transform("pieces", runs_of)), _judged))
    found = durable(placed.select("doc_id", base.alias("base"), judged.alias("runs")), "secrets")
    runs = found.where(F.size("runs") > 0).select(F.explode("runs").alias("r")).select("r.encoding", "r.length", "r.bin")
    # At most one row for each encoding and class of lengths.
    limits = {(r["encoding"], r["length"]): r["least"] for r in discoveries(runs, rate).collect()}
    stratum = lambda r: r["encoding"] * 100 + r["length"]
    limit = F.create_map(*(F.lit(v) for (e, n), least in sorted(limits.items()) for v in (e * 100 + n, least))) if limits else F.lit(None).cast("map<int,int>")
    random = F.filter("runs", lambda r: F.coalesce((r["battery"] <= BATTERY) & (r["bin"] >= F.element_at(limit, stratum(r))), F.lit(False)))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(kind))).cast("long")
    named = lambda spans: F.array_join(F.transform(spans, lambda b: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), b["kind"] + 1), b["start"], b["end"])), ",")
    out = found.withColumn("random", bare(random, "random"))
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
