"""Operators of the slot index: slots of a grid on each page, the boxes and words that lie in them, and the index made of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from . import relations

# Pixels around a slot's label, ink that makes a slot occupied, first page of figures, columns.
LABEL_BAND, LABEL_UP, LABEL_MARGIN, CORE_INK, FIRST_PAGE, COLUMNS = 200, 60, 80, 4000, 14, 5


def grid(spark: SparkSession, columns: list[float], lines: list[float]) -> DataFrame:
    """line, col, position and rectangle of each slot, of the centres of columns and lines; the pitch is the mean of their steps."""
    step = [sum(b - a for a, b in zip(c, c[1:], strict=False)) / max(len(c) - 1, 1) for c in (columns, lines)]
    rows = [(i, k, i * len(columns) + k + 1, max(0, int(x - step[0] / 2)), max(0, int(y - step[1] / 2)), int(step[0]), int(step[1])) for i, y in enumerate(lines) for k, x in enumerate(columns)]
    return spark.createDataFrame(rows, "line int, col int, position int, sx int, sy int, w int, h int")


def cross_references(cells: DataFrame, words: DataFrame, known: DataFrame) -> DataFrame:
    """Slots (page, position, sx, sy, w, h) that hold a reference: known ones, and those with the word see in them."""
    see = words.where("lower(token) = 'see'").select(F.col("page").alias("_page"), "cx", "cy")
    inside = (F.col("page") == F.col("_page")) & F.col("cx").between(F.col("sx"), F.col("sx") + F.col("w")) & F.col("cy").between(F.col("sy"), F.col("sy") + F.col("h"))
    named = cells.join(F.broadcast(known), ["page", "position"], "left_semi")
    return named.unionByName(cells.join(see, inside, "left_semi")).distinct()


def words_in_slots(cells: DataFrame, words: DataFrame, band: int = LABEL_MARGIN) -> DataFrame:
    """Slots with number, of the words in the band of their label the one nearest to the left side, letter, the last one, and whether the number is the slot's position. words(page, ord, cx, cy, token)."""
    w = words.select(F.col("page").alias("_page"), "ord", "cx", "cy", R.slot_number(F.col("token")).alias("_number"), R.slot_letter(F.col("token")).alias("_letter")).where("_number is not null or _letter is not null")
    low = F.col("sy") + F.col("h") - LABEL_BAND - LABEL_UP
    inside = (F.col("page") == F.col("_page")) & F.col("cy").between(low, F.col("sy") + F.col("h") + LABEL_MARGIN) & F.col("cx").between(F.col("sx") - band, F.col("sx") + F.col("w") + band)
    keys = cells.columns
    found = cells.join(w, inside, "left").groupBy(*keys).agg(F.min(F.when(F.col("_number").isNotNull(), F.struct(F.abs(F.col("cx") - F.col("sx")).alias("d"), "ord", "_number")))["_number"].alias("number"), F.max_by("_letter", F.when(F.col("_letter").isNotNull(), F.col("ord"))).alias("letter"))
    return found.withColumn("agrees", F.col("number") == F.col("position"))


def boxes_at_slots(boxes: DataFrame) -> DataFrame:
    """boxes(page, id, col, line): the last of each slot, and whether others wanted it."""
    return boxes.groupBy("page", "col", "line").agg(F.max("id").alias("box"), (F.count("*") > 1).alias("collides"))


def occupied(has_box: Column, is_reference: Column, core_ink: Column) -> Column:
    """A box makes a slot occupied; without one it takes ink in its core, and no reference."""
    return has_box | (~is_reference & (core_ink >= CORE_INK))


def index(spark: SparkSession, boxes: DataFrame, words: DataFrame, ink: DataFrame, columns: list[float], lines: list[float], rings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The records of all slots that are occupied, in the order of the table.

    boxes(page, id, x, y, w, h), words(page, ord, cx, cy, token), ink(page,
    position, slot_ink, core_ink), rings(crop, ring) by hand, known(page,
    position) references; columns and lines are the centres of the grid.
    """
    slots = grid(spark, columns, lines)
    known = known if known is not None else spark.createDataFrame([], "page int, position int")
    pages = boxes.select("page").unionByName(words.select("page")).distinct()
    cells = pages.join(F.broadcast(slots))  # a few slots a page
    centre = boxes.select("page", "id", relations.nearest_centre(F.col("x") + F.col("w") / 2, columns).alias("col"), relations.nearest_centre(F.col("y") + F.col("h") / 2, lines).alias("line"))
    whole = words_in_slots(cells, words).join(boxes_at_slots(centre), ["page", "col", "line"], "left").join(ink, ["page", "position"], "left")
    refs = cross_references(cells, words, known).select("page", "position", F.lit(True).alias("reference"))
    whole = whole.join(refs, ["page", "position"], "left")
    live = whole.where(occupied(F.col("box").isNotNull(), F.coalesce("reference", F.lit(False)), F.coalesce("core_ink", F.lit(0))))
    crop = F.when(F.col("box").isNotNull(), R.crop_name(F.col("page"), F.col("box").cast("int")))
    rows = live.select("page", (F.col("page") - FIRST_PAGE + 1).alias("figure"), "position", crop.alias("crop"), F.col("box").isNull().alias("missing_crop"), F.coalesce("slot_ink", F.lit(0)).cast("long").alias("slot_ink"), F.col("number").alias("ocr_position"), F.col("agrees").alias("ocr_agrees"), "letter")
    return relations.ranked(rows, "page", "position", name="rank").join(rings.select("crop", "ring"), "crop", "left")


def report(index_rows: DataFrame) -> DataFrame:
    """One row: occupied slots, crops that are missing, checks of positions and how many disagree, letters."""
    return index_rows.agg(F.count("*").alias("occupied"), F.count_if("missing_crop").alias("missing"), F.count("ocr_agrees").alias("checked"), F.count_if(~F.col("ocr_agrees")).alias("disagree"), F.count("letter").alias("letters"))
