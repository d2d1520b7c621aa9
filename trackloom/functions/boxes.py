"""Box geometry and score functions as column expressions; null-safe where the rules are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")]


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: list[Column], b: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes; 0 if one is missing or both are empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    missing = a[0].isNull() | b[0].isNull() | (union == 0)
    return F.when(missing, F.lit(0.0)).otherwise(inter / union)


def overlap_smaller(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the smaller box; 0 if that is empty."""
    small = F.least(area(a), area(b))
    return F.when(small == 0, F.lit(0.0)).otherwise(intersection(a, b) / small)


def motion(before: list[Column], after: list[Column], width: float, height: float) -> dict[str, Column]:
    """IoU, centre jump as a share of the image diagonal, and ratio of areas, each guarded against zero."""
    inter, a, b = intersection(before, after), area(before), area(after)
    dx = (after[0] + after[2] - before[0] - before[2]) / 2
    dy = (after[1] + after[3] - before[1] - before[3]) / 2
    return {
        "iou": inter / F.greatest(F.lit(1e-9), a + b - inter),
        "center_jump": F.sqrt(dx * dx + dy * dy) / F.sqrt(F.lit(width * width + height * height)),
        "area_ratio": F.greatest(a, b) / F.greatest(F.lit(1e-9), F.least(a, b)),
    }


def crop(b: list[Column], width: int, height: int, share: float = 0.04, least: int = 2) -> list[Column]:
    """A box padded by a share of its longer side, rounded half to even, within the image."""
    pad = F.greatest(F.lit(least), F.bround(F.lit(share) * F.greatest(b[2] - b[0], b[3] - b[1])).cast("int"))
    return [F.greatest(F.lit(0), b[0] - pad), F.greatest(F.lit(0), b[1] - pad), F.least(F.lit(width), b[2] + pad), F.least(F.lit(height), b[3] + pad)]


def appearance_crop(b: list[Column], width: int, height: int, share: float = 0.04) -> list[Column]:
    """A box padded by a share of each side, cut to whole pixels towards zero."""
    dx, dy = F.lit(share) * (b[2] - b[0]), F.lit(share) * (b[3] - b[1])
    return [F.greatest(F.lit(0), (b[0] - dx).cast("int")), F.greatest(F.lit(0), (b[1] - dy).cast("int")), F.least(F.lit(width), (b[2] + dx).cast("int")), F.least(F.lit(height), (b[3] + dy).cast("int"))]


def rescale(b: list[Column], source: tuple[int, int], target: tuple[int, int]) -> list[Column]:
    """Coordinates of one image size in another."""
    sx, sy = target[0] / source[0], target[1] / source[1]
    return [b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy]


def rank_score(detector: Column, similarity: Column, margin: Column) -> Column:
    """The detector's score without a reference, else a quarter of it, three of similarity, and a quarter of the margin."""
    return F.when(similarity.isNull(), detector).otherwise(0.25 * detector + 0.75 * similarity + 0.25 * F.coalesce(margin, F.lit(0.0)))


def stable_seed(key: Column, salt: str) -> Column:
    """The first eight hex digits of sha256('salt/key'), as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "/"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits count as numbers: each run is padded to twenty digits."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def cosine(a: Column, b: Column) -> Column:
    """The dot product of two unit vectors of floats, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector scaled to length one; a null or zero vector gives null."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def iso_utc(time: Column) -> Column:
    """A timestamp as an ISO text in UTC with microseconds, as labels are stamped when they are saved."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
