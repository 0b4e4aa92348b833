"""How the inputs of the page queries are written."""

import os

import pytest
from pyspark.sql import functions as F

from quillframe.plans import driver, fixtures

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_lines_are_many_files_and_a_page_is_in_one(spark):
    """Documents are few bytes, so Spark put them, and all that reads their lines, into one task."""
    files = driver.lines(spark, SF).select("doc_id", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("doc_id").count().where("count > 1").count() == 0
    assert files.select("file").distinct().count() > spark.sparkContext.defaultParallelism


def test_views_make_up_the_sql():
    assert fixtures.PAGES == f"{fixtures.ZONES},\n{fixtures.TEMPLATE},\n{fixtures.WORDED},\n{fixtures.OCR_LINES}"
