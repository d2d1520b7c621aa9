"""References found in images by point matches, and their masks taken over."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import registration as G
from trackloom.functions import runs as R

MATCHES = ["reference", "source_x", "source_y", "target_x", "target_y"]


def located(matches: DataFrame, image: str = "image_id", width: int = 640) -> DataFrame:
    """(image, reference, camera, matches, inliers, ax, ay, bx, by, refusal): a row for each image and reference with LEAST matches or more.

    ``matches`` (image, reference, camera, source_x, source_y, target_x, target_y) are of points of a reference with points of an image of the same camera, such as two images' keypoints give;
    an image's keypoints bound a group. Coordinates that are null or not finite are left out. The transform is drawn by a seed of the pair's names, so that
    it doesn't depend on the order of rows or on the partition. ``refusal`` is null where the reference may be taken over; without any transform it is no_transform.
    """
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}
    real = F.lit(True)
    for c in MATCHES[1:]:
        real = real & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = matches.where(real).select(image, "reference", "camera", *[F.col(c).cast("double").alias(c) for c in MATCHES[1:]])

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in MATCHES[1:]])
        key = [group[c][0].as_py() for c in (image, "reference", "camera")]
        x, y, u, v = (group[c].to_numpy() for c in MATCHES[1:])
        n, source, target = len(x), x + 1j * y, u + 1j * v
        if n < G.LEAST:
            return empty
        found = G.similarity(source, target, zlib.crc32(repr(key).encode()))
        if found is None:
            own = [n, 0, None, None, None, None, "no_transform"]
        else:
            a, b, inside = found
            own = [n, int(inside.sum()), a.real, a.imag, b.real, b.imag, G.refusal(source, a, b, inside, key[2], width)]
        return pa.Table.from_pylist([dict(zip(empty.schema.names, [*key, *own]))], schema=empty.schema)

    names = "matches long, inliers long, ax double, ay double, bx double, by double, refusal string"
    schema = f"`{image}` {kinds[image]}, reference {kinds['reference']}, camera string, {names}"
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(matches.sparkSession.createDataFrame([], schema).schema).empty_table()
    return rows.groupBy(image, "reference", "camera").applyInArrow(fit, schema)


def taken_over(found: DataFrame, masks: DataFrame, height: int, image: str = "image_id") -> DataFrame:
    """(image, object_id, runs): the references' masks (reference, object_id, runs) moved into the images that take them over, united by object.

    A reference of which a mask, other than the unknown part 1100, leaves the image altogether isn't taken over.
    """
    own = found.where("refusal IS NULL").select(image, F.col("reference").alias("__r"), "ax", "ay", "bx", "by")
    met = masks.join(own, F.col("reference") == F.col("__r")).drop("__r")
    at = met.withColumn("runs", G.mask_moved("runs", F.lit(height), "ax", "ay", "bx", "by")).withColumn("gone", (R.area(F.col("runs")) == 0) & (F.col("object_id") != 1100))
    lost = at.where("gone").select(image, "reference").distinct()
    kept = at.join(lost, [image, "reference"], "left_anti")
    return kept.groupBy(image, "object_id").agg(R.mask_union(F.collect_list("runs")).alias("runs"))
