"""Queries over the driver's tables, by name. Inputs come from ``fixtures``, results from the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import errors, geometry, mrz, sql, tensors, text, udtf
from quillframe.operators import blobs, layout, passport, signatures, type_tables, wide
from quillframe.plans import fixtures, oracle
from quillframe.sources import crop_store, dictionary, images, multipart, quarantine, sidecar, store
from quillframe.streaming import assembly
from quillframe.streaming import pages as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "2025-01-01"


def _tasks(spark: SparkSession) -> int:
    """To how many tasks rows of few bytes and much work are dealt; left to Spark, which goes by bytes, they may be one task's."""
    return 2 * spark.sparkContext.defaultParallelism


def _sql(spark: SparkSession, sf_dir: str, views: str, query: str) -> DataFrame:
    """A query over named table scans; the scans are views of this session, replaced at each call."""
    for name in TABLES:
        if f" {name}" in views + query:
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if views and name == "customer":  # a zone takes some 90 check values to make, and a file of few bytes would be one task
                table = table.repartition(_tasks(spark), "c_custkey")
            table.createOrReplaceTempView(name)
    return spark.sql(f"WITH {views} {query}" if views else query)


#: Paths of inputs that this process has written, by application and tables.
_WRITTEN: dict[tuple[str, str], str] = {}


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, fixtures.ZONES, "SELECT * FROM zones")


def _lines_path(spark: SparkSession, sf_dir: str) -> str:
    """Recognized lines as a table of Parquet files, as a recognizer gives them, each page in one file; written once an application."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _WRITTEN or not store.exists(spark, _WRITTEN[name]):
        # Documents are dealt ahead of the join that makes their lines, so that lines are not shuffled, and no file has all of them.
        docs = _sql(spark, sf_dir, f"{fixtures.ZONES}, {fixtures.WORDED}", "SELECT * FROM worded")
        docs.repartition(_tasks(spark), "doc_id").createOrReplaceTempView("worded")
        raw = spark.sql(f"WITH {fixtures.TEMPLATE}, {fixtures.OCR_LINES} SELECT * FROM ocr_lines")
        corner = lambda x, y: F.array(x.cast("int"), y.cast("int"))
        left, top, right, bottom = F.col("lft"), F.col("top"), F.col("lft") + F.col("wid"), F.col("top") + 20
        polygon = F.array(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom))
        made = raw.select("doc_id", "kind", "det_no", "text", (F.col("conf") / 1000).cast("float").alias("confidence"), polygon.alias("polygon"))
        _WRITTEN[name] = store.written(made, "lines")
    return _WRITTEN[name]


LINES = "doc_id BIGINT, kind INT, det_no INT, text STRING, confidence FLOAT, polygon ARRAY<ARRAY<INT>>"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(LINES).parquet(_lines_path(spark, sf_dir))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pages(lines(spark, sf_dir))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _sql(spark, sf_dir, fixtures.QUADS, "SELECT * FROM quads")
    return raw.select("doc_id", "width", "height", F.array(*(geometry.point(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4))).alias("quad"))


def milli(c: Column) -> Column:
    return F.round(c.cast("double") * 1000).cast("long")


def mrz_roundtrip(spark, sf_dir):
    zone = zones(spark, sf_dir).select("doc_id", mrz.parse(F.col("line1"), F.col("line2"), _as_of()).alias("z"))
    return zone.select("doc_id", *(F.col("z")[c].alias(c) for c in ("document_type", "issuing_country", "passport_number", "nationality", "sex", "personal_number", *passport.ZONE_FLAGS[1:])))


def mrz_names(spark, sf_dir):
    zone = zones(spark, sf_dir).select("doc_id", mrz.parse(F.col("line1"), F.col("line2"), _as_of()).alias("z"))
    return zone.select("doc_id", "z.surname", "z.given_names")


def mrz_dates(spark, sf_dir):
    zone = zones(spark, sf_dir).select("doc_id", mrz.parse(F.col("line1"), F.col("line2"), _as_of()).alias("z"))
    return zone.select("doc_id", "z.date_of_birth", "z.date_of_expiry", "z.expired")


def check_digits(spark, sf_dir):
    found = zones(spark, sf_dir)
    return found.select("doc_id", mrz.check_digit(F.col("line2")).cast("int").alias("digit"), mrz.check_digit(F.substring("line2", 1, 9), 9).cast("int").alias("number_digit"))


def mrz_candidates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = docs.where(mrz.is_candidate_line(F.col("line")))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), mrz.fit(mrz.normalize(F.col("line"))).alias("zone_line"))


def shape_profile(spark, sf_dir):
    found = layout.usable_lines(lines(spark, sf_dir), 0.0)
    names = {"devanagari": "devanagari", "lowercase": "lowercase", "identity_number": "identity_number", "date": "date"}
    flags = {out: text.matches_shape(F.col("text"), shape) for out, shape in names.items()}
    flags["sex_marker"] = text.matches_shape(F.col("text"), "enum", signatures.IDENTITY_CARD.fields[5].options)
    return found.withColumns(flags).groupBy("kind", "det_no").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in flags))


def label_words(spark, sf_dir):
    found = layout.usable_lines(lines(spark, sf_dir), 0.0)
    label = text.looks_like_label(F.col("text"))
    sure = F.col("confidence") >= text.real(text.LABEL_CONFIDENCE)
    return found.select("doc_id", "det_no", label.alias("labelish"), (label & sure).alias("is_label"), text.looks_like_label(F.col("text"), text.PASSPORT_LABEL_WORDS).alias("passport_labelish"))


def inline_fields(spark, sf_dir):
    found = lines(spark, sf_dir).select("doc_id", "det_no", text.inline_field(F.col("text")).alias("f"))
    return found.where("f IS NOT NULL").select("doc_id", "det_no", "f.label", "f.value")


def reading_order(spark, sf_dir):
    return cards(spark, sf_dir).select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line_no", "x.text", "x.left", "x.top", "x.right", "x.bottom", "x.height")


def label_components(spark, sf_dir):
    groups = cards(spark, sf_dir).select("doc_id", F.explode_outer(layout.label_groups(F.col("lines"))).alias("g")).where("g IS NOT NULL")
    first = F.array_min(F.transform("g", lambda x: x["line_no"]))
    return groups.select("doc_id", F.explode("g").alias("x"), first.alias("group_no")).select("doc_id", "x.line_no", "group_no")


def nearest_below(spark, sf_dir):
    groups = cards(spark, sf_dir).select("doc_id", "lines", F.explode_outer(layout.label_groups(F.col("lines"))).alias("g")).where("g IS NOT NULL")
    found = groups.withColumn("box", layout.group_bounds(F.col("g"))).withColumn("value", layout.nearest_below(F.col("lines"), F.col("box"))).where("value IS NOT NULL")
    return found.select("doc_id", F.col("box.line_no").alias("group_no"), F.col("value.line_no").alias("anchor"), layout.vertical_gap(F.col("box"), F.col("value")).alias("gap"), layout.left_distance(F.col("box"), F.col("value")).alias("distance"))


def same_row_values(spark, sf_dir):
    anchors = cards(spark, sf_dir).select("doc_id", "lines", F.explode_outer(F.filter("lines", lambda x: x["is_value"])).alias("a")).where("a IS NOT NULL")
    return anchors.select("doc_id", F.col("a.line_no").alias("anchor"), layout.by_left(layout.value_row(F.col("lines"), F.col("a"))).alias("value"))


def generic_fields(spark, sf_dir):
    return layout.explode_fields(cards(spark, sf_dir).select("doc_id", layout.generic_fields(F.col("lines")).alias("fields")))


def detect_type(spark, sf_dir):
    page = cards(spark, sf_dir)
    hits = {f"{t.name}_hits": signatures.keyword_hits(F.col("lines"), t.keywords) for t in (*signatures.CARD_TYPES, signatures.PASSPORT)}
    return page.select("doc_id", F.coalesce(signatures.detect_type(F.col("lines")), F.lit("none")).alias("type"), *(c.alias(n) for n, c in hits.items()))


def block_scan(spark, sf_dir):
    page = cards(spark, sf_dir)
    blocks = [(t.name, s.label, s.block) for t in signatures.CARD_TYPES for s in t.fields if s.block]
    found = page.select("doc_id", F.explode_outer(F.array(*(F.struct(F.lit(label).alias("label"), signatures.collect_block(F.col("lines"), b).alias("b")) for _, label, b in blocks))).alias("x"))
    return found.where("x.b IS NOT NULL").select("doc_id", "x.label", F.col("x.b.text").alias("value"))


def card_fields(spark, sf_dir):
    return layout.explode_fields(signatures.card_fields(cards(spark, sf_dir)))


def passport_fields(spark, sf_dir):
    return layout.explode_fields(signatures.passport_fields(layout.pages(lines(spark, sf_dir), text.PASSPORT_LABEL_WORDS)))


def passport_document(spark, sf_dir):
    return passport.passport_documents(layout.pages(lines(spark, sf_dir), text.PASSPORT_LABEL_WORDS), _as_of())


def print_dates(spark, sf_dir):
    orders = _sql(spark, sf_dir, "", oracle.PRINTED.format(table="orders"))
    parts = text.printed_date_parts(F.col("printed"))
    return orders.select("o_orderkey", parts.isNotNull().alias("is_date"), text.printed_date_iso(F.col("printed")).alias("iso"))


def quad_order(spark, sf_dir):
    found = quads(spark, sf_dir).select("doc_id", geometry.order_corners(F.col("quad")).alias("q"))
    return found.select("doc_id", *(milli(F.col("q")[i][axis]).alias(f"{axis}{i}") for i in range(4) for axis in "xy"))


def quad_expand(spark, sf_dir):
    found = quads(spark, sf_dir).select("doc_id", geometry.expand_quad(F.col("quad"), F.col("width"), F.col("height")).alias("q"))
    return found.select("doc_id", *(F.round(F.col("q")[i][axis].cast("double") * 10).cast("long").alias(f"{axis}{i}") for i in range(4) for axis in "xy"))


def crop_validate(spark, sf_dir):
    q = quads(spark, sf_dir)
    size = geometry.crop_size(F.col("quad"))
    return q.select("doc_id", F.coalesce(geometry.crop_error(F.col("quad"), F.col("width"), F.col("height")), F.lit("ok")).alias("verdict"), size["width"].alias("crop_width"), size["height"].alias("crop_height"), geometry.twice_area(F.col("quad")).cast("long").alias("twice_area"))


def det_resize(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") * 37 % 5000 + 20).cast("int").alias("h"), (F.col("p_size") * 131 % 6000 + 20).cast("int").alias("w"))
    card, passport_size = geometry.detector_size(F.col("h"), F.col("w")), geometry.detector_size(F.col("h"), F.col("w"), geometry.PASSPORT_MAX_SIDE)
    return part.select("p_partkey", card["height"].alias("card_h"), card["width"].alias("card_w"), passport_size["height"].alias("passport_h"), passport_size["width"].alias("passport_w"), geometry.recognizer_width(F.col("w"), F.col("h")).alias("line_w"))


def unclip_boxes(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), (F.col("l_suppkey") % 9).alias("h"), (F.col("l_discount") * 10).alias("score"))
    grown = geometry.unclip(F.col("w"), F.col("h"))
    return item.select("l_orderkey", "l_linenumber", F.round(grown["width"].cast("double") * 100).cast("long").alias("w100"), F.round(grown["height"].cast("double") * 100).cast("long").alias("h100"), geometry.box_passes(F.lit(4), F.col("w"), F.col("h"), F.col("score")).alias("passes"))


def ctc_decode(spark, sf_dir):
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", tensors.ctc_decode(steps, F.array(*map(F.lit, ("", "a", "b", " ")))).alias("d"))
    return found.select("vec_id", "d.text", F.round(F.col("d.confidence").cast("double") * 10000).cast("long").alias("confidence"))


def heatmap_peak(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", tensors.mask_centroid(F.col("embedding"), 8, 0.1).alias("c"))
    return found.where("c IS NOT NULL").select("vec_id", milli(F.col("c.x")).alias("x"), milli(F.col("c.y")).alias("y"))


def sidecar_flatten(spark, sf_dir):
    bodies = _sql(spark, sf_dir, "", oracle.BODIES)
    return sidecar.flatten_lines(sidecar.parse_responses(bodies)).select("doc_id", "det_no", "text", F.round(F.col("confidence").cast("double") * 1000).cast("long").alias("confidence"), F.col("polygon")[2][0].alias("right"))


def error_status(spark, sf_dir):
    bodies = _sql(spark, sf_dir, "", oracle.BODIES)
    parsed = sidecar.parse_responses(bodies)
    response = errors.error_response(F.coalesce("error_kind", F.lit("none")))
    return parsed.select("doc_id", F.coalesce("error_kind", F.lit("none")).alias("error_kind"), response["status"].alias("status"), F.coalesce(response["message"], F.lit("")).alias("message"))


def largest_blob(spark, sf_dir):
    found = blobs.largest_blobs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8, "vec_id", "embedding", threshold=0.1)
    return found.select(F.col("id").alias("vec_id"), milli(F.col("x")).alias("x"), milli(F.col("y")).alias("y"))


def masked_mean(spark, sf_dir):
    """Means inside small quads, some of them partly outside the grid."""
    x, y, tilt = F.col("vec_id") % 9 - 2, F.col("vec_id") % 7 - 2, F.col("vec_id") % 2
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    quad = F.array(corner(x, y), corner(x + 3, y + tilt), corner(x + 3, y + 4), corner(x, y + 3))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", milli(tensors.masked_mean(F.col("embedding"), 8, quad)).alias("mean"))


def planes(spark, sf_dir):
    """Both kinds of model inputs of an image of two by two pixels, plane by plane."""
    pixels = F.transform(F.slice("embedding", 1, 12), lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int"))
    both = lambda p: F.concat(tensors.imagenet_planes(p), tensors.line_planes(p))
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(both(pixels)).alias("place", "value"))
    return found.select("vec_id", "place", F.round(F.col("value").cast("double") * 10000).cast("long").alias("value"))


def homography(spark, sf_dir):
    """Where the projective map of each valid crop takes its corners: to those of the straightened image."""
    q = quads(spark, sf_dir)
    size = geometry.crop_size(F.col("quad"))
    good = q.where(geometry.crop_error(F.col("quad"), F.col("width"), F.col("height")).isNull())
    mapped = good.select("doc_id", "quad", geometry.straightening(F.col("quad"), size["width"], size["height"]).alias("map"))
    found = mapped.select("doc_id", F.transform("quad", lambda p: geometry.project(F.col("map"), p["x"], p["y"])).alias("p"))
    return found.select("doc_id", *(F.rint(F.col("p")[i][axis]).cast("long").alias(f"{axis}{i}") for i in range(4) for axis in "xy"))


def dictionary_lines(spark, sf_dir):
    """Two steps of a model each, read with a dictionary file of all nations' names."""
    path = f"{store.own_dir(spark)}/dictionary-{uuid.uuid4().hex}"
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: n["n_name"]), "\n").alias("value"))
    names.write.text(path)
    symbols = dictionary.read_dictionary(spark, path)
    wide = names.sparkSession.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.array(F.slice("embedding", 1, 27), F.slice("embedding", 28, 27)).alias("logits"))
    return dictionary.decode_outputs(wide, symbols).select("vec_id", "text", F.round(F.col("confidence").cast("double") * 10000).cast("long").alias("confidence"))


def first_upload(spark, sf_dir):
    parts = _sql(spark, sf_dir, "", oracle.PARTS).withColumn("content", F.col("body").cast("binary"))
    return images.first_upload(parts).select("request_id", F.col("content").cast("string").alias("body"), "error_kind")


def multipart_uploads(spark, sf_dir):
    """Uploads of raw request bodies, of which some are cut short or of another type."""
    parts = _sql(spark, sf_dir, "", oracle.PARTS_SENT)
    line = "\r\n"
    head = lambda x: F.concat(F.when(x["name"] == "part1", "X-Note: none").otherwise(F.concat(F.lit('Content-Disposition: form-data; name="'), x["name"], F.lit('"'))), F.lit(line * 2))
    mark = F.concat(F.lit("--B"), (F.col("request_id") % 7).cast("string"))
    # Bodies are few bytes and much work: they are dealt once, to a fixed number of tasks, and stay there.
    dealt = parts.repartition(max(_tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "request_id")
    sent = dealt.groupBy("request_id").agg(F.sort_array(F.collect_list(F.when(F.col("part_no").isNotNull(), F.struct("part_no", "body", "name")))).alias("parts"))
    body = F.concat(F.array_join(F.transform("parts", lambda x: F.concat(mark, F.lit(line), head(x), x["body"], F.lit(line))), ""), mark, F.lit("--"))
    cut = F.when(F.col("request_id") % 17 == 0, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    kind = F.concat(F.when(F.col("request_id") % 19 == 0, "text/plain").otherwise("multipart/form-data"), F.lit("; boundary="), F.concat(F.lit("B"), (F.col("request_id") % 7).cast("string")))
    requests = sent.select("request_id", kind.alias("content_type"), cut.cast("binary").alias("body"))
    return multipart.uploads(requests).select("request_id", F.col("content").cast("string").alias("body"), "error_kind")


def stored_crops(spark, sf_dir):
    """Crops added in three writes to a store, compacted, and read from the bucket of each id."""
    path = f"{store.own_dir(spark)}/crops-{uuid.uuid4().hex}"
    made = _sql(spark, sf_dir, "", oracle.CROPS).withColumn("pixels", F.col("body").cast("binary"))
    for i in range(3):
        crop_store.add_crops(made.where(F.col("crop_no") % 3 == i), path, buckets=8)
    crop_store.compact(spark, path)
    held = spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).alias("n_stored"))
    return crop_store.crops(spark, path).join(held, "id").select("id", "crop_no", "body", "n_stored")


def quarantined(spark, sf_dir):
    """Responses written apart by their failure, with the numbers that the write observed."""
    path = f"{store.own_dir(spark)}/apart-{uuid.uuid4().hex}"
    counts = quarantine.write_apart(sidecar.parse_responses(_sql(spark, sf_dir, "", oracle.BODIES)), path)
    good = quarantine.good_rows(spark, path).select("doc_id", F.lit("good").alias("kind"))
    rows = good.unionByName(quarantine.bad_rows(spark, path).select("doc_id", F.col("error_kind").alias("kind")))
    observed = F.create_map(*(F.lit(v) for pair in counts.items() for v in pair))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).select("kind", "n", "first_id", F.element_at(observed, F.col("kind")).cast("long").alias("n_observed"))


def sql_zones(spark, sf_dir):
    """Zones in SQL alone, by the functions of the session."""
    sql.register(spark)
    zones(spark, sf_dir).createOrReplaceTempView("zone_rows")
    return spark.sql(f"SELECT doc_id, z.surname, z.given_names, z.passport_number, z.nationality, z.date_of_birth, z.date_of_expiry, z.composite_check_ok, digit FROM (SELECT doc_id, mrz_parse(line1, line2, DATE'{AS_OF}') AS z, mrz_check_digit(line2) AS digit FROM zone_rows)")


def sql_dates(spark, sf_dir):
    sql.register(spark)
    _sql(spark, sf_dir, "", oracle.PRINTED.format(table="orders")).createOrReplaceTempView("printed_rows")
    return spark.sql("SELECT o_orderkey, printed_date(printed) AS iso FROM printed_rows")


def sql_fields(spark, sf_dir):
    """Fields of pages in SQL, by a table function over the lines of each page."""
    udtf.register(spark)
    lines(spark, sf_dir).createOrReplaceTempView("page_lines")
    return spark.sql("SELECT * FROM page_fields(TABLE(SELECT doc_id, det_no, text, confidence, polygon FROM page_lines) PARTITION BY doc_id ORDER BY det_no)")


def look_up(spark, sf_dir):
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") * 2).alias("id"))
    held = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), "c_name")
    return images.look_up(requests, held).select("o_orderkey", "c_name", "error_kind")


def latest_crops(spark, sf_dir):
    crops = _sql(spark, sf_dir, "", oracle.CROPS).withColumn("pixels", F.col("body").cast("binary"))
    return images.latest_crops(crops).select("id", "crop_no", "body")


def request_body(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", sidecar.request_body(F.coalesce("text", F.lit("")).cast("binary")).alias("body"))


def _corners(frame: DataFrame, quad: Column, scale: int) -> DataFrame:
    return frame.withColumn("q", quad).select("doc_id", *(F.round(F.col("q")[i][axis].cast("double") * scale).cast("long").alias(f"{axis}{i}") for i in range(4) for axis in "xy"))


def rescale_box(spark, sf_dir):
    ratio = lambda m: (2 + F.col("doc_id") % m) / 4.0
    return _corners(quads(spark, sf_dir), geometry.rescale_box(F.col("quad"), ratio(7), ratio(5), F.col("width"), F.col("height")), 10)


def full_frame(spark, sf_dir):
    return _corners(quads(spark, sf_dir), geometry.full_frame(F.col("width"), F.col("height")), 1)


def upside_down(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", tensors.is_upside_down(F.col("embedding")).alias("upside_down"))


def stream_fields(spark, sf_dir):
    """The generic fields by the same operators over a stream of files, a few to a batch."""
    out = f"{store.own_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = streaming.stream_lines(spark, _lines_path(spark, sf_dir), LINES, files_per_batch=3)
    fields = lambda batch: layout.explode_fields(layout.pages(batch).select("doc_id", layout.generic_fields(F.col("lines")).alias("fields")))
    streaming.process_available(stream, fields, f"{out}/result", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id BIGINT, field_no INT, label STRING, value STRING").parquet(f"{out}/result/*")


def _waves_path(spark: SparkSession, sf_dir: str) -> str:
    """Lines of every page over three waves of files, some of them sent again in a fourth, and two lines that move time on."""
    name = (spark.sparkContext.applicationId, f"waves of {sf_dir}")
    if name not in _WRITTEN or not store.exists(spark, _WRITTEN[name]):
        found = lines(spark, sf_dir)
        total = found.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
        made = store.kept(found.drop("kind").join(total, "doc_id").withColumn("total", F.when(F.col("doc_id") % 3 != 0, F.col("total"))), "totals")
        path = f"{store.own_dir(spark)}/waves-{uuid.uuid4().hex}"
        at = lambda minutes: F.timestamp_seconds(F.lit(1_735_689_600 + 60 * minutes))
        again = made.where((F.col("doc_id") % 11 == 0) & (F.col("det_no") % 5 == 0))
        for minutes, wave in ((0, made.where("det_no % 3 = 1")), (1, made.where("det_no % 3 = 0")), (2, made.where("det_no % 3 = 2")), (3, again)):
            wave.withColumn("seen", at(minutes)).write.mode("append").parquet(path)
        last = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("det_no"), F.lit("end").alias("text"), F.lit(1.0).cast("float").alias("confidence"), F.array().cast("array<array<int>>").alias("polygon"), F.lit(None).cast("int").alias("total"))
        for day in (1, 2):
            last.withColumn("seen", at(1440 * day)).write.mode("append").parquet(path)
        _WRITTEN[name] = path
    return _WRITTEN[name]


def stream_assembly(spark, sf_dir):
    """The generic fields of pages whose lines come over several batches, and how many lines came for nothing."""
    out = f"{store.own_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = streaming.stream_lines(spark, _waves_path(spark, sf_dir), LINES.replace("kind INT, ", "") + ", total INT, seen TIMESTAMP", files_per_batch=8)
    pages = assembly.assemble_pages(stream, expected="total")

    def fields(batch: DataFrame) -> DataFrame:
        found = layout.whole_pages(batch.where("doc_id >= 0")).withColumn("fields", layout.generic_fields(F.col("lines")))
        rows = found.select("doc_id", "repeated", "late", F.posexplode_outer("fields").alias("field_no", "field"))
        extra = F.when(F.coalesce(F.col("field_no"), F.lit(0)) == 0, F.col("repeated") + F.col("late")).otherwise(0)  # once for each row of the page
        return rows.select("doc_id", "field_no", "field.label", "field.value", extra.alias("n_extra"))

    streaming.process_available(pages, fields, f"{out}/result", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema("doc_id BIGINT, field_no INT, label STRING, value STRING, n_extra INT").parquet(f"{out}/result/*")
    extra = rows.groupBy("doc_id").agg(F.sum("n_extra").alias("n_extra"))
    return rows.drop("n_extra").where("field_no IS NOT NULL").join(extra, "doc_id").select("doc_id", "field_no", "label", "value", "n_extra")


def type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known types, one more, and one for each part, of ten keywords of which pages have at most one."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.upper("p_name").alias("name"))
    words = F.concat(F.array(F.lit("name")), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat_ws(" ", "name", F.col("p_partkey"), i)))
    more = part.select((F.col("p_partkey") + 100).cast("int").alias("type_no"), "name", F.lit(2).alias("least"), F.lit(False).alias("first"), words.alias("keywords"), F.array().cast(f"array<{type_tables.SIGNATURE}>").alias("fields"))
    return type_tables.type_table(spark, (*signatures.CARD_TYPES, oracle.INVOICE)).unionByName(more)


def typed_fields(spark, sf_dir):
    return layout.explode_fields(type_tables.typed_fields(cards(spark, sf_dir), type_rows(spark, sf_dir)))


def typed_fields_joined(spark, sf_dir):
    """The same by the join that takes over where keywords are too many for an automaton."""
    return layout.explode_fields(type_tables.typed_fields(cards(spark, sf_dir), type_rows(spark, sf_dir), bound=0))


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 pages below each other as one, in reading order."""
    placed = lines(spark, sf_dir).withColumn("place", F.col("doc_id") % 500)
    moved = placed.withColumn("polygon", F.transform("polygon", lambda p: F.array(p[0], (p[1] + F.col("place") * 1000).cast("int"))))
    return wide.ordered_lines(moved.withColumns({"doc_id": F.floor(F.col("doc_id") / 500), "det_no": (F.col("place") * 100 + F.col("det_no")).cast("int")}))


def wide_label_rows(spark, sf_dir):
    return wide.label_groups(wide_lines(spark, sf_dir))


def wide_nearest_below(spark, sf_dir):
    found = wide_lines(spark, sf_dir)
    return wide.nearest_below(found, wide.group_boxes(found, wide.label_groups(found)))


def wide_value_rows(spark, sf_dir):
    found = wide_lines(spark, sf_dir)
    return wide.value_rows(found, found.where("is_value").select("doc_id", F.col("line_no").alias("anchor")))


def wide_fields(spark, sf_dir):
    return wide.generic_fields(wide_lines(spark, sf_dir))


def fields_json(spark, sf_dir):
    return layout.fields_json(signatures.card_fields(cards(spark, sf_dir)))


def passport_json(spark, sf_dir):
    return passport.passport_json(passport_document(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mrz_roundtrip, mrz_names, mrz_dates, check_digits, mrz_candidates, shape_profile, label_words, inline_fields, reading_order, label_components,
        nearest_below, same_row_values, generic_fields, detect_type, block_scan, card_fields, passport_fields, passport_document, print_dates,
        quad_order, quad_expand, crop_validate, det_resize, unclip_boxes, ctc_decode, heatmap_peak, sidecar_flatten, error_status,
        largest_blob, masked_mean, planes, homography, dictionary_lines, first_upload, multipart_uploads, stored_crops, quarantined, sql_zones, sql_dates, sql_fields, look_up, latest_crops, request_body, rescale_box, full_frame, upside_down, stream_fields, stream_assembly, wide_label_rows, wide_nearest_below, wide_value_rows, wide_fields, typed_fields, typed_fields_joined, fields_json, passport_json,
    )
}
ORACLE: dict[str, str] = oracle.ORACLE
