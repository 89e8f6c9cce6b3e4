"""Raster operators over tables of images: crop, rows, content, the gray pixels line by line. An image is a row; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster

KERNELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "median3": raster.median3,
    "ink": raster.ink,
    "page_ink": lambda a: raster.ink(raster.median3(a), c=raster.PAGE_C),
    "erode3": lambda a: raster.erode(a, np.ones((3, 3), bool)),
    "close5": lambda a: raster.close(a, 5),
    "maximum5": lambda a: raster.dilate(a, raster.disc(5)),
    "binary": lambda a: np.where(a > 128, 255, 0).astype(np.uint8),
    "labels": lambda a: raster.components(a)[1],
    "squared": lambda a: np.rint(raster.distances(a) ** 2),
    "thin": raster.thin,
    "straightened": raster.straightened,
}


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple]:
    for crop, rows, content in zip(*(batch.column(c).to_pylist() for c in ("crop", "rows", "content")), strict=True):
        yield crop, np.frombuffer(content, np.uint8).reshape(rows, -1)


def mapped(images: DataFrame, *kernels: str) -> DataFrame:
    """crop, rows, values: the numbers that the kernels, one after another, make of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for crop, image in _arrays(batch):
                for k in kernels:
                    image = KERNELS[k](image)
                out.append({"crop": crop, "rows": len(image), "values": image.astype(np.int32).ravel()})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("crop", pa.int32()), ("rows", pa.int32()), ("values", pa.list_(pa.int32()))]))

    return images.select(F.col("crop").cast("int").alias("crop"), "rows", "content").mapInArrow(run, "crop int, rows int, values array<int>")


def pixels(values: DataFrame) -> DataFrame:
    """crop, y, x, v of all pixels."""
    width = (F.size("values") / F.col("rows")).cast("int")
    return values.select("crop", width.alias("w"), F.posexplode("values").alias("k", "v")).select("crop", F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), "v")


def _of_marks(images: DataFrame, marks: list[tuple], schema: str, measure: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, x, y, r = np.array(marks).T
        for batch in batches:
            for crop, image in _arrays(batch):
                yield pa.record_batch([pa.array(np.full(len(node), crop, np.int32)), pa.array(node.astype(np.int32)), *map(pa.array, measure(image, x, y, r))], names=[c.split()[0] for c in schema.split(", ")])

    return images.select(F.col("crop").cast("int").alias("crop"), "rows", "content").mapInArrow(run, schema)


def rims(images: DataFrame, marks: list[tuple]) -> DataFrame:
    """marks (node, x, y, radius), the same in all images -> crop, node, and the points of ink on its rim and on a circle half as wide again."""
    return _of_marks(images, marks, "crop int, node int, rim long, radial long", lambda a, x, y, r: (raster.rims(a, x, y, r, 24).astype(np.int64), raster.rims(a, x, y, 1.5 * r, 8).astype(np.int64)))


def discs(images: DataFrame, marks: list[tuple]) -> DataFrame:
    """marks -> crop, node, share of ink (above 128) and mean of its disc, rounded."""
    return _of_marks(images, marks, "crop int, node int, share double, mean double", lambda a, x, y, r: (np.round(raster.shares(a > 128, x, y, r), 6), np.round(raster.brightness(a, x, y, r), 6)))


def clustered(points: DataFrame, reach: float) -> DataFrame:
    """points(crop, points) -> crop, place, x, y of greedy clusters, in the order they began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(crop, k, x, y) for crop, some in zip(batch.column("crop").to_pylist(), batch.column("points").to_pylist(), strict=True) for k, (x, y) in enumerate(raster.cluster_points([(p["x"], p["y"]) for p in some], reach))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["crop", "place", "x", "y"])

    return points.select("crop", "points").mapInArrow(run, "crop long, place int, x int, y int")


def encoded(images: DataFrame) -> DataFrame:
    """crop, rows, content -> crop, content as PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("crop"), pa.array([raster.png(a) for _, a in _arrays(batch)], pa.binary())], names=["crop", "content"])

    return images.select(F.col("crop").cast("string").alias("crop"), "rows", "content").mapInArrow(run, "crop string, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """crop, content as PNG -> crop, rows, content; a file that cannot be read has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for crop, data in zip(batch.column("crop").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    image = raster.from_png(data)
                except ValueError:
                    continue
                rows.append((crop, len(image), image.tobytes()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["crop", "rows", "content"])

    return files.select("crop", "content").mapInArrow(run, "crop string, rows int, content binary")


def crops_of_pages(pages: DataFrame) -> DataFrame:
    """pages(page, rows, content) -> page, cell, box (x, y, w, h) and crop of each drawing, in reading order, of the page made straight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, image in _arrays(batch):
                straight = raster.straightened(image)
                boxes = raster.page_boxes(straight)
                rows = [(page, k, *b, len(c), np.ascontiguousarray(c).tobytes()) for k, (b, c) in enumerate(zip(boxes, raster.cut(straight, boxes), strict=True))]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 7 + [pa.binary()], strict=True)], names=["page", "cell", "x", "y", "w", "h", "rows", "content"])

    return pages.select(F.col("page").cast("int").alias("crop"), "rows", "content").mapInArrow(run, "page int, cell int, x int, y int, w int, h int, rows int, content binary")
