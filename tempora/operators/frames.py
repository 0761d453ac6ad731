"""Gray conversion, normalisation, region masks and activity from frame differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Circles that make two or more rows of wells, and the rows.
WELL_ROWS = {4: 2, 6: 2, 8: 2, 12: 3, 16: 4, 24: 4}


def to_gray(pixels: str, channels: int) -> Column:
    """0.299 R + 0.587 G + 0.114 B, cut to whole numbers, alpha ignored; of other channel counts the first channel."""
    n = F.floor(F.size(pixels) / channels).cast("int")
    at = lambda i, c: F.element_at(pixels, (i * channels + c + 1).cast("int"))
    if channels == 1:
        return F.col(pixels)
    mix = (lambda i: F.floor(0.299 * at(i, 0) + 0.587 * at(i, 1) + 0.114 * at(i, 2)).cast("double")) if channels in (3, 4) else (lambda i: at(i, 0).cast("double"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), mix)).otherwise(F.array().cast("array<double>"))


def normalise(frames: DataFrame, kind: str = "float", target: tuple[float, float] | None = None) -> DataFrame:
    """pixels as 0 .. 1: by 255 or 65535 for uint8 and uint16, by the run's range for int, and for float only where it leaves 0 .. 1."""
    if kind in ("uint8", "uint16"):
        out = frames.withColumn("pixels", F.transform("pixels", lambda p: p / (255.0 if kind == "uint8" else 65535.0)))
    else:
        m = frames.groupBy("run_id").agg(F.min(F.array_min("pixels")).alias("_lo"), F.max(F.array_max("pixels")).alias("_hi"))
        keep = F.lit(kind == "float") & (F.col("_lo") >= 0) & (F.col("_hi") <= 1)
        out = frames.join(m, "run_id").withColumn("pixels", F.transform("pixels", lambda p: F.when(keep, p.cast("double")).otherwise(F.coalesce(F.try_divide(p.cast("double") - F.col("_lo"), F.col("_hi").cast("double") - F.col("_lo")), F.lit(0.0))))).drop("_lo", "_hi")
    if target:
        out = out.withColumn("pixels", F.transform("pixels", lambda p: p * (target[1] - target[0]) + target[0]))
    return out


def circle_masks(circles: DataFrame, height: int, width: int) -> DataFrame:
    """run_id, roi, px of all pixels in each circle, its centre moved so that it fits the frame. Invalid circles are dropped.

    A circle is expanded to its bounding box, never to the frame.
    """
    c = circles.where("x >= 0 AND y >= 0 AND r > 0")
    inside = lambda v, r, most: F.greatest(r, F.least(v, F.lit(most - 1) - r))
    c = c.withColumns({"cx": inside(F.col("x"), F.col("r"), width), "cy": inside(F.col("y"), F.col("r"), height)})
    box = lambda v, r, most: F.sequence(F.greatest(F.lit(0), v - r), F.least(F.lit(most - 1), v + r))
    c = c.where(F.greatest(F.lit(0), F.col("cx") - F.col("r")) <= F.least(F.lit(width - 1), F.col("cx") + F.col("r")))
    p = c.withColumn("px_x", F.explode(box(F.col("cx"), F.col("r"), width))).withColumn("px_y", F.explode(box(F.col("cy"), F.col("r"), height)))
    p = p.where("(px_x - cx) * (px_x - cx) + (px_y - cy) * (px_y - cy) <= r * r")
    return p.select("run_id", F.col("circle_id").alias("roi"), (F.col("px_y") * width + F.col("px_x")).cast("int").alias("px"))


#: Frames of a run that are compared in one window.
SEGMENT = 256


def activity(frames: DataFrame, masks: DataFrame, interval: float, start: float = 0.0, segment: int = SEGMENT) -> DataFrame:
    """run_id, roi, t, value: sums over each region of the absolute differences of successive frames, at the earlier one's time.

    Frames are cut to the pixels of each region before they are shuffled, and compared inside segments of a run's indices; the
    first frame of the next segment follows a segment's last one. n frames of a run give n - 1 samples.
    """
    lists = masks.groupBy("run_id", "roi").agg(F.sort_array(F.collect_list("px")).alias("pxs"))
    part = F.floor(F.col("frame_idx") / segment).alias("segment")
    run = Window.partitionBy("run_id").orderBy("segment")  # a row for each segment
    parts = frames.select("run_id", part, "frame_idx").groupBy("run_id", "segment").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first"))
    parts = parts.select("run_id", "segment", "first", F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("segment").over(run).alias("before"))
    rows = frames.select("run_id", part, "frame_idx", "pixels").join(lists, "run_id")
    rows = rows.select("run_id", "roi", "segment", "frame_idx", F.transform("pxs", lambda p: F.element_at("pixels", p + 1).cast("double")).alias("own"))
    w = Window.partitionBy("run_id", "roi", "segment").orderBy("frame_idx")
    rows = rows.withColumns({"next": F.lead("own").over(w), "i": F.row_number().over(w) - 1})
    heads = rows.join(parts.select("run_id", "segment", "before"), ["run_id", "segment"]).where("i = 0 AND before is not null").select("run_id", "roi", F.col("before").alias("segment"), F.col("own").alias("head"))
    both = rows.join(heads, ["run_id", "roi", "segment"], "left").join(parts.select("run_id", "segment", "offset"), ["run_id", "segment"])
    gaps = F.zip_with("own", F.coalesce("next", "head"), lambda a, b: F.abs(b - a))
    out = both.withColumn("gaps", gaps).where("gaps is not null")
    return out.select("run_id", "roi", (F.lit(start) + (F.col("offset") + F.col("i")) * interval).alias("t"), F.aggregate("gaps", F.lit(0.0), lambda s, x: s + x).alias("value"), F.col("frame_idx").alias("tie"))


def number_wells(circles: DataFrame) -> DataFrame:
    """Well numbers: 4, 6, 8, 12, 16 or 24 circles by rows from the top, every second row from the right; others from the left."""
    w = Window.partitionBy("run_id")
    c = circles.withColumn("n", F.count("*").over(w))
    rows = F.coalesce(*(F.when(F.col("n") == k, v) for k, v in WELL_ROWS.items()), F.lit(1))
    per = F.floor(F.col("n") / rows)
    c = c.withColumn("rows", rows).withColumn("row", F.when(F.col("rows") == 1, F.lit(0)).otherwise(F.least(F.col("rows") - 1, F.floor((F.row_number().over(w.orderBy("y", "x", "circle_id")) - 1) / per))).cast("int"))
    across = F.when(F.col("row") % 2 == 1, -F.col("x")).otherwise(F.col("x"))
    return c.withColumn("well", F.row_number().over(w.orderBy("row", across, "circle_id"))).select("run_id", "circle_id", "x", "y", "row", "well")


def region_geometry(masks: DataFrame, width: int) -> DataFrame:
    """Centre, mean distance to it and area of each region."""
    p = masks.withColumns({"x": F.col("px") % width, "y": F.floor(F.col("px") / width)})
    m = p.groupBy("run_id", "roi").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("area"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("mx"), F.lit(2)) + F.pow(F.col("y") - F.col("my"), F.lit(2)))
    return p.join(m, ["run_id", "roi"]).groupBy("run_id", "roi", "mx", "my", "area").agg(F.avg(gap).alias("radius")).select("run_id", "roi", F.col("mx").cast("int").alias("center_x"), F.col("my").cast("int").alias("center_y"), "radius", "area")


def range_report(frames: DataFrame, stage: str) -> DataFrame:
    """Least, largest, mean and deviation of all pixels, and whether normalised ones lie in -0.1 .. 1.1."""
    power = lambda k: F.aggregate("pixels", F.lit(0.0), lambda s, p: s + F.pow(p.cast("double"), F.lit(k)))
    sums = frames.select("run_id", F.size("pixels").alias("n"), F.array_min("pixels").alias("lo"), F.array_max("pixels").alias("hi"), power(1).alias("s1"), power(2).alias("s2"))
    m = sums.groupBy("run_id").agg(F.min("lo").cast("double").alias("min"), F.max("hi").cast("double").alias("max"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    ok = F.lit(stage != "normalised") | ((F.col("min") >= -0.1) & (F.col("max") <= 1.1))
    return m.select("run_id", F.lit(stage).alias("stage"), "min", "max", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("std"), F.when(ok, "pass").otherwise("warn").alias("status"))


def magnitude_class(samples: DataFrame, first: int = 100) -> DataFrame:
    """What the first samples of a series look like by their largest value."""
    i = F.row_number().over(Window.partitionBy("run_id", "roi").orderBy("t", "tie"))
    m = samples.withColumn("_i", i).where(F.col("_i") <= first).groupBy("run_id", "roi").agg(F.max("value").alias("largest"), F.count("*").alias("n"))
    kind = F.when(F.col("largest") > 10000, "very_high").when(F.col("largest") < 1, "normalised").when(F.col("largest").between(10, 1000), "typical").otherwise("unusual")
    return m.withColumn("kind", kind)
