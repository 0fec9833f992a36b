"""Column expressions of the catalog; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def dms_to_degrees(parts: Column, ref: Column) -> Column:
    """F1. Degrees, minutes and seconds to decimal degrees, negative in the south and west; null unless three parts."""
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return F.when(F.size(parts) == 3, value * F.when(F.upper(F.trim(ref)).isin("S", "W"), -1.0).otherwise(1.0))


def clean_text(text: Column) -> Column:
    """F3. Without NUL characters and the blanks around; null if nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(text, "\\x00", "")), F.lit(""))


def parse_date(text: Column) -> Column:
    """F2. ISO text of a camera date; any other text as it is; empty to null."""
    found = [F.try_to_timestamp(F.trim(text), F.lit(p)) for p in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]
    return F.coalesce(*[F.date_format(f, "yyyy-MM-dd'T'HH:mm:ss") for f in found], F.nullif(F.trim(text), F.lit("")))


def rational(text: Column) -> Column:
    """F4. "a/b" or a number to double, null where it is none."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(text.try_cast("double"))


def first_text(*columns: Column) -> Column:
    """F5. The first that is not empty."""
    return F.coalesce(*[clean_text(c) for c in columns])


def normalize_metadata(raw: Column) -> Column:
    """F6. A map of raw camera metadata to a struct of named fields; null if it gives nothing."""
    get = lambda k: F.element_at(raw, F.lit(k))
    degrees = lambda k: dms_to_degrees(F.transform(F.split(get(k), r",\s*"), lambda x: rational(x)), get(k + "Ref"))
    gps = F.struct(degrees("GPSLatitude").alias("lat"), degrees("GPSLongitude").alias("lon"))
    fields = {
        "make": clean_text(get("Make")),
        "model": clean_text(get("Model")),
        "lens": clean_text(get("LensModel")),
        "taken_at": parse_date(first_text(get("DateTimeOriginal"), get("DateTime"))),
        "iso": first_text(get("ISOSpeedRatings"), get("PhotographicSensitivity")).try_cast("int"),
        "f_number": rational(get("FNumber")),
        "exposure": rational(get("ExposureTime")),
        "focal_length": rational(get("FocalLength")),
        "orientation": get("Orientation").try_cast("int"),
        "software": clean_text(get("Software")),
        "gps": F.when(gps["lat"].isNotNull() & gps["lon"].isNotNull(), gps),
    }
    return F.when(F.greatest(*[v.isNotNull() for v in fields.values()]), F.struct(*[v.alias(k) for k, v in fields.items()]))


def json_field(text: Column, path: str) -> Column:
    """F7. A field of a JSON text as text; null where the text is no JSON or lacks it."""
    return F.try_variant_get(F.try_parse_json(text), path, "string")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """F9. Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """F9. Cosine similarity, 0 if either is a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


def normalize(a: Column) -> Column:
    """F9. Unit vector; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def euclidean(a: Column, b: Column) -> Column:
    """F10. Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def area(box: Column) -> Column:
    """F11. Area of a box (x, y, w, h)."""
    return box["w"] * box["h"]


def iou(a: Column, b: Column) -> Column:
    """F11. Intersection over union of two boxes, 0 where both are empty."""
    width = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    height = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    common = width * height
    return F.coalesce(F.try_divide(common.cast("double"), (area(a) + area(b) - common).cast("double")), F.lit(0.0))


def centre_inside(inner: Column, outer: Column) -> Column:
    """F11. Whether the centre of a box lies in another."""
    x, y = inner["x"] + inner["w"] / 2, inner["y"] + inner["h"] / 2
    return x.between(outer["x"], outer["x"] + outer["w"]) & y.between(outer["y"], outer["y"] + outer["h"])


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """F11. A box cut to its image."""
    x, y = F.least(F.greatest(box["x"], F.lit(0)), width), F.least(F.greatest(box["y"], F.lit(0)), height)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.least(box["w"], width - x), F.lit(0)).alias("w"), F.greatest(F.least(box["h"], height - y), F.lit(0)).alias("h"))


def exposure_summary(f_number: Column, seconds: Column, iso: Column, focal: Column) -> Column:
    """F12. One line such as "f/2.8 1/250s ISO 100 50mm"; parts that are missing are left out."""
    shutter = F.when(seconds >= 1, F.format_string("%.1fs", seconds)).when(seconds > 0, F.concat(F.lit("1/"), F.round(1 / seconds).cast("long").cast("string"), F.lit("s")))
    return F.concat_ws(" ", F.when(f_number.isNotNull(), F.format_string("f/%.1f", f_number)), shutter, F.when(iso.isNotNull(), F.concat(F.lit("ISO "), iso.cast("string"))), F.when(focal.isNotNull(), F.format_string("%.0fmm", focal)))


def suspect(verified: Column, det_score: Column, limit: float = 0.65) -> Column:
    """F13. Rejected, or found with a low score."""
    return F.coalesce(verified == 0, F.lit(False)) | F.coalesce(det_score < limit, F.lit(False))


def thumb_key(path: Column) -> Column:
    """F14. File name of a thumbnail."""
    return F.concat(F.substring(F.sha2(path, 256), 1, 16), F.lit(".jpg"))


def relative_path(path: Column, anchor: str) -> Column:
    """F15. Path below an anchor folder; others as they are."""
    root = anchor.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 2**31 - 1)).otherwise(path)


def absolute_path(path: Column, anchor: str) -> Column:
    """F15. Path of a file stored relative to an anchor folder."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(anchor.rstrip("/") + "/"), path))


def display_label(user: Column, auto: Column) -> Column:
    """F16. The label a person gave, else the automatic one."""
    return F.coalesce(F.nullif(user, F.lit("")), auto)


def tag_kind(model_name: Column) -> Column:
    """F17. geo for tags of a geo model, else label."""
    return F.when(model_name.startswith("geo_"), "geo").otherwise("label")


def validate_threshold(base: float, n: Column, mean: Column, m2: Column) -> Column:
    """F18. An identity's own threshold: widened by two deviations once five samples are known, 0.95 at most."""
    sigma = F.sqrt(F.try_divide(m2, (n - 1).cast("double")))
    return F.when((n >= 5) & (sigma > 0), F.least(F.lit(0.95), F.greatest(F.lit(base), F.lit(base) + 2 * sigma))).otherwise(F.lit(base))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    rad = F.radians
    a = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
