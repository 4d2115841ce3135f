"""Column expressions for grids, scores, verdicts and text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0


def is_valid(value: Column, nodata: float = NODATA) -> Column:
    """Finite and not the NoData value; null is not valid."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")) & (value != nodata), F.lit(False))


def row_col(x: Column, y: Column, left: float, top: float, width: float, height: float) -> tuple[Column, Column]:
    """Row and column of the grid cell that holds a point; ``height`` is positive downwards."""
    return F.floor((F.lit(top) - y) / F.lit(height)).cast("long"), F.floor((x - F.lit(left)) / F.lit(width)).cast("long")


def cell_centre(row: Column, col: Column, left: float, top: float, width: float, height: float) -> tuple[Column, Column]:
    return F.lit(left) + (col + 0.5) * width, F.lit(top) - (row + 0.5) * height


def patch_window(row: Column, col: Column, size: int) -> dict[str, Column]:
    """Half-open window of an even size around a cell; odd and non-positive sizes are errors."""
    if size <= 0 or size % 2:
        raise ValueError("a patch size must be even and positive")
    half = size // 2
    return {"row_start": row - half, "row_stop": row + half, "col_start": col - half, "col_stop": col + half}


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def encoder_rate_label(rate: Column) -> Column:
    """Null: scratch; 0: frozen; else the rate in short form."""
    return F.when(rate.isNull(), "scratch").when(rate == 0, "frozen (LR 0)").otherwise(F.concat(F.lit("enc LR "), F.format_string("%.0e", rate)))


def verdict(delta: Column, gate: Column, baseline: Column) -> Column:
    """Within the gate a difference is noise; beyond it the sign decides."""
    return F.when(baseline, "-").when(delta.isNull() | gate.isNull(), None).when(F.abs(delta) < gate, "within noise").when(delta > 0, "helps").otherwise("hurts")


def sign_label(delta: Column, slack: float = 0.003) -> Column:
    return F.when(delta > slack, "up").when(delta < -slack, "down").otherwise("flat")


def monitor_value(auc: Column, loss: Column) -> Column:
    """The AUC where it is finite, else the negated loss."""
    return F.coalesce(F.when(~F.isnan(auc), auc), -loss)


#: The two outcomes.
EFFECTIVE, WEAK = "Effective", "Weak transfer"


def outcome(gain: Column, gate: Column) -> Column:
    """Effective: better, and by more than the gate."""
    return F.when((gain > 0) & (gain > gate), EFFECTIVE).otherwise(WEAK)


def rate_tag(rate: Column) -> Column:
    """A rate in the short form of %g, without plus signs and with p for the point."""
    size = F.floor(F.log10(F.abs(rate) * (1 + 1e-12))).cast("int")
    digits = F.round(rate / F.pow(F.lit(10.0), size), 5)
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.concat(trimmed(F.format_string("%.5f", digits)), F.lit("e"), F.when(size < 0, "-").otherwise(""), F.lpad(F.abs(size).cast("string"), 2, "0"))
    plain = trimmed(F.format_string("%.10f", F.round(rate, 10)))
    return F.replace(F.when((size < -4) | (size >= 6), power).otherwise(plain), F.lit("."), F.lit("p"))


#: Words in the names of rasters that hold classes.
CLASS_WORDS = ("landcover", "land_cover", "lulc", "lithology", "geology", "class", "category", "categorical")


def raster_kind(name: Column) -> Column:
    """Kind of a raster by keywords of its name; the order of the tests matters."""
    low = F.lower(name)
    classes = F.lit(False)
    for word in CLASS_WORDS:
        classes = classes | low.contains(word)
    return F.when(low.contains("aspect"), "aspect").when(classes, "categorical").otherwise("continuous")


#: Fixed value: what the keys of groups that are mapped features begin with.
FEATURE_PREFIX = "FEAT_"


def group_key(label: Column, feature: Column, sample: Column) -> Column:
    """The group that a sample is dealt to folds with: positives go with the others of their
    mapped feature, all else alone."""
    return F.when((label == 1) & feature.isNotNull(), F.concat(F.lit(FEATURE_PREFIX), feature.cast("string"))).otherwise(sample.cast("string"))


def smallest_integer(low: Column, high: Column, nodata: float = NODATA) -> Column:
    least, most = F.least(low, F.lit(nodata)), F.greatest(high, F.lit(nodata))
    return F.when((least >= -32768) & (most <= 32767), "int16").when((least >= -2147483648) & (most <= 2147483647), "int32").otherwise("float64")


def score_list(text: Column) -> Column:
    """``"0.65;0.78"`` as an array of doubles; parts that are no numbers are null."""
    return F.transform(F.split(text, ";"), lambda x: x.try_cast("double"))


def joined_scores(values: Column, digits: int = 4) -> Column:
    return F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v)), ";")


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and key: the same in every engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def utm(lon: Column, lat: Column, zone: int = 17) -> tuple[Column, Column]:
    """Easting and northing of a northern UTM zone on the WGS 84 ellipsoid, by the Krueger
    series to the third order in the third flattening."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    lam, phi = F.radians(lon - (6 * zone - 183)), F.radians(lat)
    e = 2 * n**0.5 / (1 + n)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north
