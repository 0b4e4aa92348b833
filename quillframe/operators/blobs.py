"""Regions of heatmaps as rows: cells over a threshold, joined to their neighbours, as connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.tensors import BLOB
from quillframe.functions.text import real
from quillframe.operators.connect import components
from quillframe.sources.store import kept


def _on(v, threshold: float):
    return F.coalesce(v.cast("float") > real(threshold), F.lit(False)) & ~F.isnan(v.cast("float"))


def label_cells(maps: DataFrame, width: int, id_col: str = "id", grid_col: str = "grid", threshold: float = BLOB) -> DataFrame:
    """(id, place, blob): every cell over the threshold with the least place of its 8-connected region.

    A map is an array of rows of ``width`` cells; places count from 0. Nulls and NaN are not over any threshold, an empty or
    null map has no cells. Links to the right and below are told within the map, so that no join seeks neighbours; from then
    on cells are rows keyed by map and place, and no map is a key of its own. Ids tell maps apart and must not repeat; a map
    without an id has no cells.
    """
    grid = F.col("grid")
    known = maps.select(F.col(id_col).alias("id"), F.col(grid_col).alias("grid")).where("id IS NOT NULL")

    def links(v, i):
        first, last = i % width == 0, i % width == width - 1
        near = F.array(F.when(~last, i + 1), F.when(~first, i + width - 1), i + width, F.when(~last, i + width + 1))
        near = F.filter(near, lambda j: j.isNotNull() & _on(F.get(grid, j), threshold))
        return F.struct(i.alias("place"), F.when(_on(v, threshold), near).alias("near"))

    cells = known.select("id", F.explode(F.transform(grid, links)).alias("c")).where("c.near IS NOT NULL").select("id", "c.place", "c.near")
    cells = kept(cells, "cells")
    edges = cells.select("id", F.col("place").alias("a"), F.explode("near").alias("b"))
    found = components(edges, "id").select("id", F.col("a").alias("place"), F.col("b").alias("blob"))
    return cells.select("id", "place").join(found, ["id", "place"], "left").select("id", "place", F.coalesce("blob", "place").alias("blob"))


def blobs(labelled: DataFrame, width: int) -> DataFrame:
    """(id, blob, n, x, y): cells and centroid of each region."""
    mean = lambda v: F.sum(v).cast("double") / F.count(F.lit(1))
    row = F.floor(F.col("place") / width)
    return labelled.groupBy("id", "blob").agg(F.count(F.lit(1)).alias("n"), mean(F.col("place") % width).alias("x"), mean(row).alias("y"))


def largest_blobs(maps: DataFrame, width: int, id_col: str = "id", grid_col: str = "grid", threshold: float = BLOB) -> DataFrame:
    """(id, n, x, y): the region of most cells of each map, of several the one with the least place; no row for a map without any."""
    found = blobs(label_cells(maps, width, id_col, grid_col, threshold), width)
    best = found.groupBy("id").agg(F.max(F.struct("n", (-F.col("blob")).alias("first"), "x", "y")).alias("b"))
    return best.select("id", "b.n", "b.x", "b.y")
