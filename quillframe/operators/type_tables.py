"""Document types as a table: any number of types in a plan of fixed size.

``signatures`` unrolls its types into the plan, which suits a handful. Here types, their keywords and their signatures are
rows that the caller brings. Pages get their type from an automaton (Aho-Corasick) of all keywords, which reads each line once however
many keywords there are; then the signatures of that type, an array, are folded over with the values already used as
the state of the fold.

The automaton is sent to the tasks only while its keywords are within ``AUTOMATON_BYTES``; beyond that, lines and keywords
meet in a join on short pieces of text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions.text import SHAPES, has_devanagari, join_unique, let, make_field, strip
from quillframe.operators.layout import by_left, field_value, generic_fields, keyword_value
from quillframe.operators.signatures import DocumentType
from quillframe.sources.store import kept

#: Bytes of keywords that an automaton may have; some 40 times that is its size in a task.
AUTOMATON_BYTES = 8 << 20
#: Characters of the pieces by which lines and keywords meet beyond that.
PIECE = 3

BLOCK = "struct<label: string, stop: string, shape: string, join: string>"
SIGNATURE = f"struct<label: string, keywords: array<string>, block: {BLOCK}, shape: string, options: array<string>>"
#: Types are tried by ``type_no``. ``first`` is for passports: a keyword's own line comes before its generic field, and the
#: first keyword that finds a value ends the search.
TYPES = f"type_no int, name string, least int, first boolean, keywords array<string>, fields array<{SIGNATURE}>"


def type_table(spark: SparkSession, types: Sequence[DocumentType], first: bool = False) -> DataFrame:
    """The table of types that are known as objects."""
    signature = lambda s: (s.label, list(s.keywords), s.block and (s.block.label, s.block.stop, s.block.shape, s.block.join), s.shape, list(s.options))
    return spark.createDataFrame([(i, t.name, t.least, first, list(t.keywords), [signature(s) for s in t.fields]) for i, t in enumerate(types)], TYPES)


def _keywords(types: DataFrame) -> DataFrame:
    """(type_no, keyword): in upper case, as often as the type lists them."""
    return types.select("type_no", F.explode("keywords").alias("keyword")).select("type_no", F.upper("keyword").alias("keyword"))


def _by_automaton(pages: DataFrame, types: DataFrame) -> DataFrame:
    least = {r["type_no"]: r["least"] for r in types.select("type_no", "least").where("least IS NOT NULL").collect()}
    of_type: dict[int, list[str]] = {}
    shared: Counter[str] = Counter()
    for row in _keywords(types).where("keyword IS NOT NULL").collect():
        of_type.setdefault(row["type_no"], []).append(row["keyword"])
        shared[row["keyword"]] += 1
    # A page is asked about a type only if it has one of the type's rarer keywords: the others, fewer than are needed, may be on any page.
    rarer: dict[str, list[int]] = {word: [] for word in shared}
    common: dict[int, list[str]] = {}
    for t, words in of_type.items():
        if least.get(t) is not None and least[t] > 0:
            words.sort(key=lambda w: (-shared[w], w))
            cut = least[t] - 1
            common[t] = words[:cut]
            for word in words[cut:]:
                rarer[word].append(t)
    sent = pages.sparkSession.sparkContext.broadcast((rarer, common, least))
    made: list = []

    def automaton():
        if not made:
            found = ahocorasick.Automaton()
            for word, of in sent.value[0].items():
                if word:
                    found.add_word(word, (word, of))
            found.make_automaton()
            made.append(found)
        return made[0]

    @F.pandas_udf("int")
    def first_type(texts: pd.Series) -> pd.Series:
        words, common, least = sent.value
        always = min((t for t, n in least.items() if n <= 0), default=None)
        search = automaton().iter if any(words) else lambda line: ()

        def one(lines) -> int | None:
            if lines is None:
                return None
            seen = {"": words.get("", ())} if len(lines) else {}
            for line in lines:
                seen.update(hit for _, hit in search(line))
            hits = Counter(t for of in seen.values() for t in of)
            enough = [t for t, n in hits.items() if n + sum(w in seen for w in common[t]) >= least[t]]
            return min([*enough, *([] if always is None else [always])], default=None)

        return pd.Series([one(x) for x in texts], dtype="Int32")

    return pages.withColumn("type_no", first_type(F.transform("lines", lambda x: x["upper"])))


def _by_join(pages: DataFrame, types: DataFrame) -> DataFrame:
    """Lines and keywords meet by the piece of the keyword that the fewest lines have; then the whole keyword is looked for.

    A keyword with a piece that no line has is on no page. A page meets a type by its rarer keywords only: the others, fewer than are
    needed, may be on any page. Types and keywords are many here, so no join may send them to the driver for a broadcast.
    """
    least = types.select("type_no", "least").where("least > 0").dropDuplicates(["type_no"])
    words = kept(_keywords(types).where("keyword IS NOT NULL").groupBy("type_no", "keyword").agg(F.count(F.lit(1)).alias("times")).join(least.hint("merge"), "type_no"), "keywords")
    distinct = words.select("keyword").distinct()
    size = F.least(F.length("keyword"), F.lit(PIECE))
    sizes = sorted(r[0] for r in distinct.select(size).distinct().collect() if r[0])
    pieces = lambda s, n: F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    lines = kept(pages.select("doc_id", F.explode("lines").alias("x")).select("doc_id", F.col("x.upper").alias("upper")).distinct(), "upper-lines")
    texts = lines.select("upper").distinct()
    cut = texts.select("upper", F.explode(F.concat(F.array().cast("array<string>"), *(pieces(F.col("upper"), n) for n in sizes))).alias("piece"))
    often = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("lines"))
    own = F.when(F.length("keyword") > 0, pieces(F.col("keyword"), size))
    met = distinct.select("keyword", own.alias("own")).select("keyword", F.size("own").alias("n"), F.explode("own").alias("piece")).join(often.hint("merge"), "piece")
    rarest = met.groupBy("keyword", "n").agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("lines", "piece")).alias("r")).where("there = n").select("keyword", "r.piece")
    held = cut.join(rarest.hint("merge"), "piece").where(F.contains("upper", "keyword")).select("upper", "keyword").distinct()
    empty = pages.where(F.size("lines") > 0).select("doc_id", F.lit("").alias("keyword")).distinct()
    on_line = lines.join(held.hint("merge"), "upper").select("doc_id", "keyword").distinct()
    found = kept(on_line.unionByName(empty.join(distinct.where("keyword = ''"), "keyword", "left_semi")), "found")
    often = found.groupBy("keyword").agg(F.count(F.lit(1)).alias("pages"))
    so_far = F.sum("times").over(Window.partitionBy("type_no").orderBy(F.desc("pages"), "keyword").rowsBetween(Window.unboundedPreceding, 0))
    live = kept(words.join(often.hint("merge"), "keyword").withColumn("rarer", so_far >= F.col("least")), "live-keywords")
    asked = found.join(live.where("rarer").select("keyword", "type_no").hint("merge"), "keyword").select("doc_id", "type_no").distinct()
    hits = asked.join(live.hint("merge"), "type_no").join(found.hint("merge"), ["doc_id", "keyword"]).groupBy("doc_id", "type_no", "least").agg(F.sum("times").alias("hits"))
    enough = hits.where("hits >= least").groupBy("doc_id").agg(F.min("type_no").alias("__hit"))
    always = types.where("least <= 0").agg(F.min("type_no")).first()[0]
    return pages.join(enough.hint("merge"), "doc_id", "left").withColumn("type_no", F.least("__hit", F.lit(always).cast("int"))).drop("__hit")


def with_type(pages: DataFrame, types: DataFrame, bound: int = AUTOMATON_BYTES) -> DataFrame:
    """``pages`` with ``type_no``: the first type of which enough keywords occur on any line, in any letter case; null if none has.

    A keyword that a type lists twice counts twice; null ones are none, and an empty one is on any line. A type whose ``least`` is 0
    fits any page, one without a ``least`` none. One page of a doc_id is expected beyond ``bound``, as ``layout.pages`` gives them.
    """
    size = _keywords(types).agg(F.sum(F.octet_length("keyword") + 16)).first()[0] or 0
    return (_by_automaton if size <= bound else _by_join)(pages, types)


def _block(lines: Column, block: Column) -> Column:
    """struct(text, consumed) of a block's lines; null without a block or lines of it."""
    at = lambda word, after: F.array_min(F.transform(F.filter(lines, lambda x: (x["line_no"] > after) & F.contains(x["text"], word)), lambda x: x["line_no"]))

    def between(s: Column) -> Column:
        stop = F.coalesce(at(block["stop"], s), F.lit(2**31 - 1))
        return let(stop, lambda e: F.filter(lines, lambda x: (x["line_no"] > s) & (x["line_no"] < e) & F.array_contains(x["shapes"], block["shape"])))

    def joined(found: Column) -> Column:
        across = F.transform(F.sort_array(F.transform(found, lambda x: F.struct(x["left"], x["line_no"], x["text"]))), lambda x: x["text"])
        down = F.transform(found, lambda x: x["text"])
        concat = block["join"] == "concat"
        text = F.when(concat, by_left(found)).otherwise(join_unique(down))
        return F.when(F.size(found) > 0, F.struct(F.coalesce(text, F.lit("")).alias("text"), F.when(concat, across).otherwise(down).alias("consumed")))

    whole = F.when(block.isNotNull(), let(at(block["label"], F.lit(-1)), lambda s: F.when(s.isNotNull(), let(between(s), joined))))
    return let(whole, lambda b: F.when(b["text"] != "", b))


def _fields(lines: Column, generic: Column, fields: Column, first: Column) -> Column:
    """The fields of a page by the signatures of its type, in order; a shape is not a value that an earlier block or keyword took."""
    texts = lambda: F.array().cast("array<string>")
    keys = lambda f, pick: F.array_compact(F.transform(f["keywords"], pick))

    def all_of(state: Column, f: Column) -> Column:
        def parts(block: Column, values: Column) -> Column:
            used = F.concat(state["used"], F.coalesce(block["consumed"], texts()), values)
            shaped = F.filter(lines, lambda x: F.when(f["shape"] == "enum", F.array_contains(f["options"], strip(x["text"]))).otherwise(F.array_contains(x["shapes"], f["shape"])))

            def made(u: Column) -> Column:
                free = F.when(f["shape"].isNotNull(), join_unique(F.filter(F.transform(shaped, lambda x: x["text"]), lambda t: ~F.array_contains(u, t))))
                found = F.array_compact(F.concat(F.array(block["text"]), values, F.array(free)))
                ordered = let(found, lambda p: F.concat(F.filter(p, has_devanagari), F.filter(p, lambda x: ~has_devanagari(x))))
                return F.struct(u.alias("used"), F.concat(state["made"], F.array(make_field(f["label"], join_unique(ordered)))).alias("made"))

            return let(used, made)

        values = keys(f, lambda k: F.coalesce(field_value(generic, k), keyword_value(lines, k)))
        return let(F.struct(_block(lines, f["block"]).alias("block"), values.alias("values")), lambda p: parts(p["block"], p["values"]))

    def first_of(state: Column, f: Column) -> Column:
        values = keys(f, lambda k: F.coalesce(keyword_value(lines, k), field_value(generic, k)))
        return F.struct(state["used"].alias("used"), F.concat(state["made"], F.array(make_field(f["label"], F.get(values, F.lit(0))))).alias("made"))

    none = F.struct(texts().alias("used"), F.array().cast("array<struct<label: string, value: string>>").alias("made"))
    folded = F.aggregate(fields, none, lambda state, f: F.when(first, first_of(state, f)).otherwise(all_of(state, f)), lambda state: state["made"])
    return F.array_compact(folded)


def typed_fields(pages: DataFrame, types: DataFrame, bound: int = AUTOMATON_BYTES) -> DataFrame:
    """(doc_id, lines, type, fields): the signature fields of pages whose type is in ``types`` (a table as of ``TYPES``), generic
    fields of the others (type null). Null signatures of a type are none.

    Types and typed pages are written first: only types that a page has meet the pages, and are broadcast to them below Spark's threshold.
    Beyond it both are joined by ``type_no``, where a type that most pages have is split as a skewed key.
    """
    known = kept(types.select("type_no", F.col("name").alias("type"), "least", F.coalesce("first", F.lit(False)).alias("first"), "keywords", F.array_compact("fields").alias("signatures")), "types")
    found = kept(with_type(pages, known, bound), "typed-pages")
    had = known.drop("least", "keywords").join(found.select("type_no").distinct(), "type_no", "left_semi")
    typed = found.join(had, "type_no", "left").withColumn("generic", generic_fields(F.col("lines")))
    # Shapes once for each line; only pages of a known type need them.
    shapes = lambda x: F.array_compact(F.array(*(F.when(test(x["text"]), F.lit(name)) for name, test in SHAPES.items())))
    shaped = typed.withColumn("__lines", F.when(F.col("type_no").isNotNull(), F.transform("lines", lambda x: x.withField("shapes", shapes(x)))))
    fields = F.when(F.col("type_no").isNotNull(), _fields(F.col("__lines"), F.col("generic"), F.col("signatures"), F.col("first"))).otherwise(F.col("generic"))
    return shaped.select("doc_id", "lines", "type", fields.alias("fields"))
