"""Raster-to-table jobs over row-major arrays, with array functions and joins on pixels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS32 = 1.1920928955078125e-07
DISTANCES, ANGLES = (1, 2, 4), (0, 45, 90, 135)
PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "asm", "correlation")


def _rank(values: Column, place: float) -> Column:
    """Linear percentile of a sorted array. The place is exact: as a double, 40 * 0.99 - 39 is not 0.6."""
    at = (F.size(values) - 1) * F.lit(Decimal(str(place)))
    low, high = F.floor(at), F.ceil(at)
    a, b = F.element_at(values, (low + 1).cast("int")), F.element_at(values, (high + 1).cast("int"))
    return a + (b - a) * (at - low).cast("double")


def bound_to(value: Column, f) -> Column:
    """f of a value that is computed once: as a plain expression, each use inside a lambda would
    be computed anew, for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def with_normalized(samples: DataFrame) -> DataFrame:
    """Adds image_normalized: foreground (> 0) scaled between its 1st and 99th percentile and
    clipped to [0, 1]; background 0; all 0 where the foreground is empty or constant."""
    values = F.array_sort(F.transform(F.filter("image_raw", lambda x: x > 0), lambda x: x.cast("double")))
    bounds = bound_to(values, lambda v: F.struct(F.when(F.size(v) > 0, _rank(v, 0.01)).alias("a"), F.when(F.size(v) > 0, _rank(v, 0.99)).alias("b")))

    def scaled(q: Column) -> Column:
        a, b = q["a"], q["b"]
        flat = a.isNull() | (b - a <= EPS32 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))
        return F.transform("image_raw", lambda x: F.when((x <= 0) | flat, 0.0).otherwise((F.least(F.greatest(x.cast("double"), a), b) - a) / (b - a)))

    return samples.withColumn("image_normalized", bound_to(bounds, scaled))


def pixels(samples: DataFrame, *columns: str) -> DataFrame:
    """sample_id, pos and one column per array."""
    first, *rest = columns
    spread = samples.select("sample_id", *rest, F.posexplode(first).alias("pos", f"{first}_v"))
    return spread.select("sample_id", "pos", F.col(f"{first}_v").alias(first), *[F.element_at(c, F.col("pos") + 1).alias(c) for c in rest])


def normalized_by_pixels(samples: DataFrame) -> DataFrame:
    """The same normalization as a relational plan: sample_id, pos, value."""
    p = pixels(samples, "image_raw")
    bounds = p.where("image_raw > 0").groupBy("sample_id").agg(F.percentile("image_raw", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    joined = p.join(bounds, "sample_id", "left").select("sample_id", "pos", F.col("image_raw").cast("double").alias("x"), F.element_at("q", 1).alias("a"), F.element_at("q", 2).alias("b"))
    a, b = F.col("a"), F.col("b")
    flat = a.isNull() | (b - a <= EPS32 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))
    return joined.select("sample_id", "pos", F.when(flat | (F.col("x") <= 0), 0.0).otherwise((F.least(F.greatest("x", "a"), "b") - a) / (b - a)).alias("value"))


def eight_bit(image: Column) -> Column:
    return F.transform(image, lambda x: F.least(F.greatest(F.bround(x * 255, 0), F.lit(0.0)), F.lit(255.0)).cast("int"))


def sample_statistics(samples: DataFrame) -> DataFrame:
    total = F.aggregate("image_raw", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("image_raw", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n = F.size("image_raw")
    area = F.aggregate("tumor_mask", F.lit(0), lambda a, x: a + x)
    return samples.select(
        "sample_id", F.array_min("image_raw").alias("least"), F.array_max("image_raw").alias("most"), (total / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))).alias("std"),
        area.cast("bigint").alias("mask_pixels"), (area / F.size("tumor_mask")).alias("mask_fraction"), (area == 0).alias("empty_mask"),
    )


def mask_boxes(samples: DataFrame) -> DataFrame:
    """sample_id, r0, r1, c0, c1 (half open), h, w, longest, area; zeros when the mask is empty."""
    on = F.filter(F.sequence(F.lit(0), F.size("tumor_mask") - 1), lambda i: F.element_at("tumor_mask", i + 1) == 1)
    base = samples.select("sample_id", "height", "width", on.alias("on"))
    rows, cols = F.transform("on", lambda i: F.floor(i / F.col("width"))), F.transform("on", lambda i: i % F.col("width"))
    box = base.select("sample_id", "height", "width", F.size("on").alias("area"), F.array_min(rows).alias("r0"), (F.array_max(rows) + 1).alias("r1"), F.array_min(cols).alias("c0"), (F.array_max(cols) + 1).alias("c1")).na.fill(0)
    box = box.withColumn("h", F.col("r1") - F.col("r0")).withColumn("w", F.col("c1") - F.col("c0"))
    return box.select("sample_id", "height", "width", *[F.col(c).cast("bigint").alias(c) for c in ("r0", "r1", "c0", "c1", "h", "w", "area")], F.greatest("h", "w").cast("bigint").alias("longest"))


def square_boxes(boxes: DataFrame, margin: float = 0.1) -> DataFrame:
    """Adds pad, side and the square box's corner (top, left)."""
    padded = boxes.withColumn("pad", F.ceil(F.col("longest") * F.lit(margin))).withColumn("side", F.col("longest") + 2 * F.col("pad"))
    start = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 - F.col("side") / 2)
    return padded.withColumn("top", start("r0", "r1")).withColumn("left", start("c0", "c1"))


def roi_geometry(samples: DataFrame, target: int = 128) -> DataFrame:
    """Square box with how far it reaches beyond each edge and the factor to the target side."""
    g = square_boxes(mask_boxes(samples))
    over = {"over_top": -F.col("top"), "over_left": -F.col("left"), "over_bottom": F.col("top") + F.col("side") - F.col("height"), "over_right": F.col("left") + F.col("side") - F.col("width")}
    for name, value in over.items():
        g = g.withColumn(name, F.greatest(value, F.lit(0)).cast("bigint"))
    return g.withColumn("upscale", F.try_divide(F.lit(float(target)), F.col("side")))


def cropped(samples: DataFrame) -> DataFrame:
    """sample_id, side, padded, crop, masked_crop: zero where the square leaves the raster."""
    g = roi_geometry(samples).select("sample_id", "side", "top", "left", (F.col("over_top") + F.col("over_left") + F.col("over_bottom") + F.col("over_right") > 0).alias("padded"))
    joined = samples.select("sample_id", "height", "width", "image_raw", "tumor_mask").join(g, "sample_id")

    def at(i: Column, value) -> Column:
        r, c = F.col("top") + F.floor(i / F.col("side")), F.col("left") + i % F.col("side")
        inside = (r >= 0) & (r < F.col("height")) & (c >= 0) & (c < F.col("width"))
        return F.when(inside, value((r * F.col("width") + c + 1).cast("int"))).otherwise(0)

    places = F.sequence(F.lit(0).cast("bigint"), F.col("side") * F.col("side") - 1)
    image = lambda k: F.element_at("image_raw", k)
    return joined.where("side > 0").select(
        "sample_id", "side", "padded", F.transform(places, lambda i: at(i, image)).alias("crop"), F.transform(places, lambda i: at(i, lambda k: image(k) * F.element_at("tumor_mask", k))).alias("masked_crop")
    )


def quantized(image: Column, levels: int = 32) -> Column:
    return F.transform(image, lambda x: F.least(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * levels), F.lit(levels - 1)).cast("int"))


def cooccurrence(samples: DataFrame, levels: int = 32) -> DataFrame:
    """sample_id, d, a, i, j, n: symmetric counts of level pairs of mask pixels at an offset.

    Neighbours are looked up in the row's own arrays; only pairs of levels are spread out, and they
    are counted before the shuffle."""
    base = with_normalized(samples).select("sample_id", "width", quantized(F.col("image_normalized"), levels).alias("q"), "tumor_mask")
    steps = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}
    width, q, mask = F.col("width"), F.col("q"), F.col("tumor_mask")
    places = F.filter(F.sequence(F.lit(0), F.size("q") - 1), lambda k: F.element_at(mask, k + 1) == 1)

    def at_offset(d: int, a: int) -> Column:
        dr, dc = steps[a][0] * d, steps[a][1] * d
        to = lambda k: k + dr * width + dc

        def pair(k: Column) -> Column:
            c = k % width + dc
            inside = (c >= 0) & (c < width) & (to(k) >= 0) & (to(k) < F.size("q"))
            return inside & (F.when(inside, F.element_at(mask, (to(k) + 1).cast("int"))).otherwise(0) == 1)

        struct = lambda k: F.struct(F.lit(d).alias("d"), F.lit(a).alias("a"), F.element_at(q, k + 1).alias("i"), F.element_at(q, (to(k) + 1).cast("int")).alias("j"))
        return F.transform(F.filter(F.col("places"), pair), struct)

    found = base.withColumn("places", places).select("sample_id", F.explode(F.flatten(F.array(*[at_offset(d, a) for d in DISTANCES for a in ANGLES]))).alias("o"))
    counts = found.groupBy("sample_id", "o.d", "o.a", "o.i", "o.j").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.select("sample_id", "d", "a", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    return both.groupBy("sample_id", "d", "a", "i", "j").agg(F.sum("n").alias("n"))


def cooccurrence_properties(counts: DataFrame) -> DataFrame:
    """Six properties per (sample, d, a); correlation is 1 where the levels don't vary.

    Counts and moments are added as whole numbers and divided once, at the end (homogeneity adds
    decimals), so the order of addition doesn't show."""
    keys = ["sample_id", "d", "a"]
    i, j, n = (F.col(c).cast("bigint") for c in ("i", "j", "n"))
    gap = i - j
    sums = {"t": n, "s": i * n, "ij": i * j * n, "ii": i * i * n, "gg": gap * gap * n, "ag": F.abs(gap) * n, "nn": n * n}
    near = F.sum((n / (1 + gap * gap)).cast("decimal(38,15)")).cast("double").alias("near")
    m = counts.groupBy(*keys).agg(*[F.sum(v).cast("double").alias(c) for c, v in sums.items()], near)
    t, s = F.col("t"), F.col("s")
    varies = t * F.col("ii") - s * s
    asm = F.col("nn") / (t * t)
    return m.select(
        *keys, (F.col("gg") / t).alias("contrast"), (F.col("ag") / t).alias("dissimilarity"), (F.col("near") / t).alias("homogeneity"), F.sqrt(asm).alias("energy"), asm.alias("asm"),
        F.when(varies <= 0, 1.0).otherwise((t * F.col("ij") - s * s) / varies).alias("correlation"), (t / 2).cast("bigint").alias("pairs"),
    )


def _summaries() -> list[Column]:
    mean = lambda p: F.sum(F.col(p).cast("decimal(38,15)")).cast("double") / F.count(p)
    return [f for p in PROPERTIES for f in (mean(p).alias(f"{p}_mean"), F.stddev_pop(p).alias(f"{p}_std"))]


def texture_summary(properties: DataFrame) -> DataFrame:
    """12 columns: mean and population deviation of each property over offsets that have pairs."""
    return properties.groupBy("sample_id").agg(*_summaries())


def texture_directional(properties: DataFrame) -> DataFrame:
    """84 columns: each property at each offset (0 without pairs), and the 12 summaries."""
    at = lambda p, d, a: F.coalesce(F.max(F.when((F.col("d") == d) & (F.col("a") == a), F.col(p))), F.lit(0.0)).alias(f"{p}_d{d}_a{a}")
    return properties.groupBy("sample_id").agg(*[at(p, d, a) for p in PROPERTIES for d in DISTANCES for a in ANGLES], *_summaries())


def axis_patterns(samples: DataFrame) -> DataFrame:
    """sample_id, code, n: signs of the four axis neighbours (>= centre) of mask pixels, as a
    relational plan of lookups into the row's own array; neighbours outside count as 0."""
    q = F.col("image_raw")

    def near(dr: int, dc: int, bit: int) -> Column:
        r, c = F.col("r") + dr, F.col("c") + dc
        inside = (r >= 0) & (r < F.col("height")) & (c >= 0) & (c < F.col("width"))
        value = F.when(inside, F.element_at(q, (r * F.col("width") + c + 1).cast("int"))).otherwise(0)
        return F.when(value >= F.element_at(q, F.col("pos") + 1), bit).otherwise(0)

    on = samples.select("sample_id", "height", "width", "image_raw", F.posexplode("tumor_mask").alias("pos", "m")).where("m = 1")
    placed = on.withColumn("r", F.floor(F.col("pos") / F.col("width"))).withColumn("c", F.col("pos") % F.col("width"))
    code = near(0, 1, 1) + near(-1, 0, 2) + near(0, -1, 4) + near(1, 0, 8)
    return placed.select("sample_id", code.alias("code")).groupBy("sample_id", "code").agg(F.count("*").alias("n"))


def augmentation_draws(samples: DataFrame, seed: int, epochs: int) -> DataFrame:
    """Parameters that depend on (seed, epoch, sample) only."""
    spread = samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))

    def uniform(k: int) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("sample_id").cast("string"), F.lit(str(k)))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint") / 4294967296.0

    between = lambda k, a, b: a + (b - a) * uniform(k)
    return spread.select(
        "sample_id", "epoch", (uniform(0) < 0.5).alias("flip"), between(1, -10.0, 10.0).alias("degrees"), between(2, -0.05, 0.05).alias("shift_x"), between(3, -0.05, 0.05).alias("shift_y"), between(4, 0.9, 1.1).alias("scale"),
        between(5, 0.9, 1.1).alias("brightness"), between(6, 0.9, 1.1).alias("contrast"),
    )


def tone_augmented(samples: DataFrame, draws: DataFrame) -> DataFrame:
    """sample_id, epoch, image: flip, brightness and contrast, clipped to [0, 1]."""
    joined = draws.join(with_normalized(samples).select("sample_id", "width", "image_normalized"), "sample_id")
    n = F.size("image_normalized")
    flipped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("image_normalized", F.when(F.col("flip"), F.floor(i / F.col("width")) * F.col("width") + F.col("width") - i % F.col("width")).otherwise(i + 1).cast("int")))
    bright = joined.select("sample_id", "epoch", "contrast", F.transform(flipped, lambda x: F.least(x * F.col("brightness"), F.lit(1.0))).alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return bright.withColumn("mean", mean).select("sample_id", "epoch", F.transform("x", lambda v: F.least(F.greatest(F.col("mean") + (v - F.col("mean")) * F.col("contrast"), F.lit(0.0)), F.lit(1.0))).alias("image"))


def channel_report(samples: DataFrame, means: list[float], stds: list[float]) -> DataFrame:
    """sample_id, channel, mean, std, least, most of the raster standardized per channel."""
    channels = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.lit(m).alias("m"), F.lit(s).alias("s")) for k, (m, s) in enumerate(zip(means, stds, strict=True))]))
    rows = with_normalized(samples).select("sample_id", "image_normalized", channels.alias("c"))
    x = rows.select("sample_id", "c.channel", F.transform("image_normalized", lambda v: (v - F.col("c.m")) / F.col("c.s")).alias("x"))
    total, squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    mean = total / F.size("x")
    return x.select("sample_id", "channel", mean.alias("mean"), F.sqrt(F.greatest(squares / F.size("x") - mean * mean, F.lit(0.0))).alias("std"), F.array_min("x").alias("least"), F.array_max("x").alias("most"))


def ordered_gaps(samples: DataFrame) -> DataFrame:
    """Largest difference between the two normalization plans, per sample."""
    own = pixels(with_normalized(samples), "image_normalized")
    gaps = own.join(normalized_by_pixels(samples), ["sample_id", "pos"])
    return gaps.groupBy("sample_id").agg(F.max(F.abs(F.col("image_normalized") - F.col("value"))).alias("max_abs_diff"))
