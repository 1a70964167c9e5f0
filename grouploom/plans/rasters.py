"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels as N
from ..operators import raster as R
from .evaluation import rounded, to_digits
from .registry import query

NORM = """(WITH b AS (SELECT s.*, list_sort(list_transform(list_filter(image_raw, lambda x: x > 0), lambda x: CAST(x AS DOUBLE))) AS v FROM fx_samples s),
q AS (SELECT *, (len(v) - 1) * 0.01 AS pa, (len(v) - 1) * 0.99 AS pb FROM b),
c AS (SELECT *, v[CAST(floor(pa) AS INT) + 1] + (v[CAST(ceil(pa) AS INT) + 1] - v[CAST(floor(pa) AS INT) + 1]) * (pa - floor(pa)) AS a, v[CAST(floor(pb) AS INT) + 1] + (v[CAST(ceil(pb) AS INT) + 1] - v[CAST(floor(pb) AS INT) + 1]) * (pb - floor(pb)) AS b FROM q)
SELECT sample_id, height, width, image_raw, tumor_mask, list_transform(image_raw, lambda x: CASE WHEN x <= 0 OR a IS NULL OR b - a <= 1.1920928955078125e-07 * greatest(1.0, abs(a), abs(b)) THEN 0.0 ELSE (least(greatest(CAST(x AS DOUBLE), a), b) - a) / (b - a) END) AS image_normalized FROM c)"""


def spread_sql(source: str, array: str, value: str) -> str:
    return f"SELECT sample_id, CAST(unnest(range(64)) AS INT) AS pos, {value.format(x=f'unnest({array})')} AS value FROM {source}"


@query("r01_normalize", spread_sql(NORM, "image_normalized", "round({x}, 6)"))
def r01(v):
    return rounded(R.pixels(R.with_normalized(v.samples), "image_normalized").withColumnRenamed("image_normalized", "value"), "value")


@query("r02_recompute", f"WITH n AS (SELECT sample_id, generate_subscripts(image_normalized, 1) AS pos, unnest(image_normalized) AS x FROM {NORM}), p AS (SELECT sample_id, generate_subscripts(image_raw, 1) AS pos, CAST(unnest(image_raw) AS DOUBLE) AS x FROM fx_samples), q AS (SELECT sample_id, quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b FROM p WHERE x > 0 GROUP BY 1) SELECT sample_id, round(max(abs(n.x - CASE WHEN p.x <= 0 OR a IS NULL THEN 0.0 ELSE (least(greatest(p.x, a), b) - a) / (b - a) END)), 6) + 0.0 AS max_abs_diff FROM n JOIN p USING (sample_id, pos) LEFT JOIN q USING (sample_id) GROUP BY 1")
def r02(v):
    return rounded(R.ordered_gaps(v.samples), "max_abs_diff")


@query("r03_eight_bit", spread_sql(NORM, "image_normalized", "CAST(least(greatest(round_even({x} * 255, 0), 0), 255) AS INT)"))
def r03(v):
    x = R.with_normalized(v.samples).select("sample_id", R.eight_bit(F.col("image_normalized")).alias("value"))
    return R.pixels(x, "value")


@query("r04_sample_statistics", "WITH p AS (SELECT sample_id, CAST(unnest(image_raw) AS DOUBLE) AS x, unnest(tumor_mask) AS m FROM fx_samples) SELECT sample_id, CAST(min(x) AS INT) AS least, CAST(max(x) AS INT) AS most, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, CAST(sum(m) AS BIGINT) AS mask_pixels, round(sum(m) / count(*), 6) AS mask_fraction, sum(m) = 0 AS empty_mask FROM p GROUP BY 1")
def r04(v):
    return rounded(R.sample_statistics(v.samples), "mean", "std", "mask_fraction")


BOX = """(WITH p AS (SELECT sample_id, CAST(unnest(range(64)) AS BIGINT) AS i, unnest(tumor_mask) AS m FROM fx_samples), b AS (SELECT sample_id, min(i // 8) FILTER (m = 1) AS r0, max(i // 8) FILTER (m = 1) + 1 AS r1, min(i % 8) FILTER (m = 1) AS c0, max(i % 8) FILTER (m = 1) + 1 AS c1, CAST(sum(m) AS BIGINT) AS area FROM p GROUP BY 1),
s AS (SELECT *, r1 - r0 AS h, c1 - c0 AS w, greatest(r1 - r0, c1 - c0) AS longest, CAST(ceil(greatest(r1 - r0, c1 - c0) * 0.1) AS BIGINT) AS pad FROM b), q AS (SELECT *, longest + 2 * pad AS side FROM s)
SELECT *, CAST(floor((r0 + r1) / 2 - side / 2) AS BIGINT) AS top, CAST(floor((c0 + c1) / 2 - side / 2) AS BIGINT) AS "left" FROM q)"""


@query("r05_mask_box", f"SELECT sample_id, r0, r1, c0, c1, h, w, longest, area FROM {BOX}")
def r05(v):
    return R.mask_boxes(v.samples).select("sample_id", "r0", "r1", "c0", "c1", "h", "w", "longest", "area")


@query("r06_square_box", f'SELECT sample_id, pad, side, top, "left" FROM {BOX}')
def r06(v):
    return R.square_boxes(R.mask_boxes(v.samples)).select("sample_id", *[F.col(c).cast("bigint").alias(c) for c in ("pad", "side", "top", "left")])


CROP = f"""(SELECT b.sample_id, side, k, CASE WHEN inside THEN image_raw[r * 8 + c + 1] ELSE 0 END AS x, CASE WHEN inside THEN image_raw[r * 8 + c + 1] * tumor_mask[r * 8 + c + 1] ELSE 0 END AS xm FROM (SELECT *, top + k // side AS r, "left" + k % side AS c, r >= 0 AND r < 8 AND c >= 0 AND c < 8 AS inside FROM (SELECT *, unnest(range(side * side)) AS k FROM {BOX})) b JOIN fx_samples s ON s.sample_id = b.sample_id)"""


@query("r07_crop", f"SELECT sample_id, max(side) AS side, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * k) AS BIGINT) AS moment, CAST(sum(xm * k) AS BIGINT) AS masked_moment FROM {CROP} GROUP BY 1")
def r07(v):
    c = R.cropped(v.samples)
    dot = lambda a: F.aggregate(F.transform(a, lambda x, i: x.cast("bigint") * i), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return c.select("sample_id", F.col("side").cast("bigint").alias("side"), F.aggregate("crop", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), dot("crop").alias("moment"), dot("masked_crop").alias("masked_moment"))


@query("r08_geometry", f'SELECT sample_id, side, greatest(-top, 0) AS over_top, greatest(-"left", 0) AS over_left, greatest(top + side - 8, 0) AS over_bottom, greatest("left" + side - 8, 0) AS over_right, round(128.0 / side, 6) AS upscale FROM {BOX}')
def r08(v):
    g = R.roi_geometry(v.samples).withColumn("side", F.col("side").cast("bigint"))
    return rounded(g.select("sample_id", "side", "over_top", "over_left", "over_bottom", "over_right", "upscale"), "upscale")


@query("r11_quantize", spread_sql(NORM, "image_normalized", "CAST(least(floor({x} * 32), 31) AS INT)"))
def r11(v):
    return R.pixels(R.with_normalized(v.samples).select("sample_id", R.quantized(F.col("image_normalized")).alias("value")), "value")


COUNTS = f"""(WITH n AS (SELECT sample_id, unnest(range(64)) AS k, unnest(image_normalized) AS x, unnest(tumor_mask) AS m FROM {NORM}), p AS (SELECT sample_id, CAST(k // 8 AS INT) AS r, CAST(k % 8 AS INT) AS c, CAST(least(floor(x * 32), 31) AS INT) AS q FROM n WHERE m = 1),
o AS (SELECT d, a, dr * d AS dr, dc * d AS dc FROM (SELECT unnest([1, 2, 4]) AS d), (VALUES (0, 0, 1), (45, -1, 1), (90, -1, 0), (135, -1, -1)) t(a, dr, dc)),
x AS (SELECT p.sample_id, d, a, p.q AS i, z.q AS j FROM p, o JOIN p z ON z.sample_id = p.sample_id AND z.r = p.r + dr AND z.c = p.c + dc)
SELECT sample_id, d, a, i, j, count(*) AS n FROM (SELECT * FROM x UNION ALL SELECT sample_id, d, a, j, i FROM x) GROUP BY ALL)"""


@query("r12_cooccurrence", f"SELECT * FROM {COUNTS}")
def r12(v):
    return R.cooccurrence(v.samples)


@query("j15_neighbour_pairs", f"SELECT sample_id, d, a, CAST(sum(n) / 2 AS BIGINT) AS pairs FROM {COUNTS} GROUP BY ALL")
def j15(v):
    return R.cooccurrence(v.samples).groupBy("sample_id", "d", "a").agg((F.sum("n") / 2).cast("bigint").alias("pairs"))


PROPS = f"""(WITH s AS (SELECT sample_id, d, a, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(i * n) AS DOUBLE) AS s, CAST(sum(i * j * n) AS DOUBLE) AS ij, CAST(sum(i * i * n) AS DOUBLE) AS ii, CAST(sum((i - j) * (i - j) * n) AS DOUBLE) AS gg, CAST(sum(abs(i - j) * n) AS DOUBLE) AS ag, CAST(sum(n * n) AS DOUBLE) AS nn,
 CAST(sum(CAST(n / (1 + (i - j) * (i - j)) AS DECIMAL(38, 15))) AS DOUBLE) AS near FROM {COUNTS} GROUP BY ALL)
SELECT sample_id, d, a, gg / t AS contrast, ag / t AS dissimilarity, near / t AS homogeneity, sqrt(nn / (t * t)) AS energy, nn / (t * t) AS asm, CASE WHEN t * ii - s * s <= 0 THEN 1.0 ELSE (t * ij - s * s) / (t * ii - s * s) END AS correlation FROM s)"""
ALL_PROPS = ", ".join(f"round({p}, 6) + 0.0 AS {p}" for p in R.PROPERTIES)


@query("r13_properties", f"SELECT sample_id, d, a, {ALL_PROPS} FROM {PROPS}")
def r13(v):
    return rounded(R.cooccurrence_properties(R.cooccurrence(v.samples)).drop("pairs"), *R.PROPERTIES)


SUMMARY = ", ".join(f"round(CAST(sum(CAST({p} AS DECIMAL(38, 15))) AS DOUBLE) / count({p}), 6) + 0.0 AS {p}_mean, round(stddev_pop({p}), 6) AS {p}_std" for p in R.PROPERTIES)
SUMMARY_NAMES = [f"{p}_{s}" for p in R.PROPERTIES for s in ("mean", "std")]


@query("r14_texture_summary", f"SELECT sample_id, {SUMMARY} FROM {PROPS} GROUP BY 1")
def r14(v):
    return rounded(R.texture_summary(R.cooccurrence_properties(R.cooccurrence(v.samples))), *SUMMARY_NAMES)


DIRECTIONAL = [(p, d, a) for p in R.PROPERTIES for d in R.DISTANCES for a in R.ANGLES]


@query("r15_texture_directional", "SELECT sample_id, " + ", ".join(f"round(coalesce(max(CASE WHEN d = {d} AND a = {a} THEN {p} END), 0), 6) + 0.0 AS {p}_d{d}_a{a}" for p, d, a in DIRECTIONAL) + f", {SUMMARY} FROM {PROPS} GROUP BY 1")
def r15(v):
    return rounded(R.texture_directional(R.cooccurrence_properties(R.cooccurrence(v.samples))), *[f"{p}_d{d}_a{a}" for p, d, a in DIRECTIONAL], *SUMMARY_NAMES)


@query("r16_axis_patterns", """WITH p AS (SELECT sample_id, CAST(k // 8 AS INT) AS r, CAST(k % 8 AS INT) AS c, x, m FROM (SELECT sample_id, unnest(range(64)) AS k, unnest(image_raw) AS x, unnest(tumor_mask) AS m FROM fx_samples)),
b AS (SELECT p.sample_id, p.r, p.c, sum(CASE WHEN coalesce(z.x, 0) >= p.x THEN o.bit ELSE 0 END) AS code FROM p, (VALUES (0, 1, 1), (-1, 0, 2), (0, -1, 4), (1, 0, 8)) o(dr, dc, bit) LEFT JOIN p z ON z.sample_id = p.sample_id AND z.r = p.r + o.dr AND z.c = p.c + o.dc WHERE p.m = 1 GROUP BY ALL)
SELECT sample_id, CAST(code AS INT) AS code, count(*) AS n FROM b GROUP BY ALL""")
def r16(v):
    return R.axis_patterns(v.samples)


def hash_sql(k: int) -> str:
    return f"(CAST(('0x' || substr(sha256('42:' || epoch || ':' || sample_id || ':{k}'), 1, 8)) AS BIGINT) / 4294967296.0)"


DRAWS = f"""(SELECT sample_id, epoch, {hash_sql(0)} < 0.5 AS flip, -10.0 + 20.0 * {hash_sql(1)} AS degrees, -0.05 + 0.1 * {hash_sql(2)} AS shift_x, -0.05 + 0.1 * {hash_sql(3)} AS shift_y, 0.9 + (1.1 - 0.9) * {hash_sql(4)} AS scale, 0.9 + (1.1 - 0.9) * {hash_sql(5)} AS brightness, 0.9 + (1.1 - 0.9) * {hash_sql(6)} AS contrast FROM fx_samples, (SELECT CAST(unnest([0, 1]) AS INT) AS epoch))"""
DRAW_NAMES = ("degrees", "shift_x", "shift_y", "scale", "brightness", "contrast")


@query("r19_augmentation_draws", f"SELECT sample_id, epoch, flip, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in DRAW_NAMES)} FROM {DRAWS}")
def r19(v):
    return rounded(R.augmentation_draws(v.samples, 42, 2), *DRAW_NAMES)


@query("r20_tone_augmentation", f"""WITH x AS (SELECT d.sample_id, d.epoch, contrast, k, least(image_normalized[CASE WHEN flip THEN (k // 8) * 8 + 8 - k % 8 ELSE k + 1 END] * brightness, 1.0) AS v FROM (SELECT *, unnest(range(64)) AS k FROM {DRAWS}) d JOIN {NORM} s ON s.sample_id = d.sample_id),
y AS (SELECT sample_id, epoch, k, least(greatest(m + (v - m) * contrast, 0.0), 1.0) AS z FROM (SELECT *, avg(v) OVER (PARTITION BY sample_id, epoch) AS m FROM x)) SELECT sample_id, epoch, round(sum(z), 4) AS total, round(sum(z * k), 4) AS moment FROM y GROUP BY ALL""")
def r20(v):
    out = R.tone_augmented(v.samples, R.augmentation_draws(v.samples, 42, 2))
    total = F.aggregate("image", F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(F.transform("image", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", "epoch", to_digits(total, 4).alias("total"), to_digits(moment, 4).alias("moment"))


@query("r21_channel_report", f"WITH x AS (SELECT sample_id, channel, (unnest(image_normalized) - m) / s AS v FROM {NORM}, (VALUES (0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)) c(channel, m, s)) SELECT sample_id, channel, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most FROM x GROUP BY ALL")
def r21(v):
    return rounded(R.channel_report(v.samples, [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]), "mean", "std", "least", "most")


@query("i02_manifest", f"SELECT s.sample_id, s.patient_id, s.label, p.split, area, r0, r1, c0, c1, sha256('id=' || s.sample_id || ';raw=' || array_to_string(image_raw, ',')) AS content_sha256 FROM fx_samples s JOIN fx_split p USING (patient_id) JOIN {BOX} b ON b.sample_id = s.sample_id")
def i02(v):
    from ..operators.integrity import content_hash

    digest = content_hash({"id": F.col("sample_id"), "raw": F.array_join(F.col("image_raw").cast("array<string>"), ",")})
    base = v.samples.select("sample_id", "patient_id", "label", digest.alias("content_sha256"))
    boxes = R.mask_boxes(v.samples).select("sample_id", "area", "r0", "r1", "c0", "c1")
    return base.join(v.split.select("patient_id", "split"), "patient_id").join(boxes, "sample_id")


# kernels that SQL does not express
def with_normalized(v):
    return R.with_normalized(v.samples)


@query("r09_resize")
def r09(v):
    return N.resized(with_normalized(v), 16, antialias=False)


@query("r10_resize_antialiased")
def r10(v):
    return N.resized(with_normalized(v), 5, antialias=True)


@query("r16_uniform_patterns")
def r16_full(v):
    names = [f"lbp_{k}" for k in range(10)]
    return N.per_sample(with_normalized(v), names, lambda x, m: dict(zip(names, N.lbp_histogram(x, m), strict=True)), ("image_normalized", "tumor_mask"))


@query("r17_wavelet")
def r17(v):
    names = [f"wavelet_{b}_{s}" for b in ("l1_hh", "l1_hl", "l1_lh", "l2_hh", "l2_hl", "l2_lh", "l2_ll") for s in ("mean", "std", "energy", "entropy")]
    return N.per_sample(with_normalized(v), names, N.wavelet_features, ("image_normalized",))


@query("r18_gabor")
def r18(v):
    names = [f"gabor_f{f:03d}_o{a:03d}_{s}" for f in (10, 20, 30) for a in (0, 45, 90, 135) for s in ("real_mean", "real_std", "magnitude_mean", "magnitude_std", "magnitude_energy")]
    return N.per_stack(with_normalized(v), names, N.gabor_stacked, "image_normalized")


@query("r20_augmentation")
def r20_full(v):
    rows = with_normalized(v).join(R.augmentation_draws(v.samples, 42, 2), "sample_id")
    extra = ("epoch", "flip", "degrees", "shift_x", "shift_y", "scale", "brightness", "contrast")

    def summary(image, **draw):
        out = N.augmented(image, **draw)
        return {"mean": out.mean(), "std": out.std(), "least": out.min(), "most": out.max()}

    return N.per_sample(rows, ["mean", "std", "least", "most"], summary, ("image_normalized",), extra)
