"""Drawing primitives of a result in image pixels; a rasteriser only has to paint them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One colour per kind; boxes and the banner follow below.
SEGMENT_COLOUR = "yellow"
POSE_COLOUR = "cyan"
TEXT_COLOUR = "orange"
TRACK_COLOUR = "magenta"
BANNER_COLOUR = "black"

PRIMITIVE = (
    "array<struct<layer:int,item_ix:int,part_ix:int,shape:string,colour:string,"
    "points:array<struct<x:double,y:double>>,radius:int,caption:string,caption_x:double,caption_y:double>>"
)


def model_colour(model: Column) -> Column:
    """Blue without a model, green for a light one (``mini`` in its name), else red."""
    return (
        F.when(model.isNull() | (model == ""), "blue").when(F.lower(model).contains("mini"), "green").otherwise("red")
    )


def overlay_primitives(final: DataFrame) -> DataFrame:
    """Rows image_id, layer, item_ix, part_ix, shape, colour, points, radius, caption, caption_x, caption_y.

    ``final``: the six arrays, source_model, uncertainty_score, image_width and
    image_height. Images without a size (unreadable) give no primitives.
    """
    width, height = F.col("image_width"), F.col("image_height")
    colour = model_colour(F.col("source_model"))
    radius = F.greatest(F.lit(3), F.floor(height * 0.005).cast("int"))
    no_radius = F.lit(None).cast("int")

    def at(p: Column) -> Column:
        return F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))

    def corners(b: Column) -> Column:
        return F.array(
            F.struct((b["xmin"] * width).alias("x"), (b["ymin"] * height).alias("y")),
            F.struct((b["xmax"] * width).alias("x"), (b["ymax"] * height).alias("y")),
        )

    def scored(item: Column) -> Column:
        return F.format_string("%s (%.2f)", item["label"], item["confidence"])

    def primitive(layer, ix, part, shape, paint, points, size, caption, x, y) -> Column:
        paint = paint if isinstance(paint, Column) else F.lit(paint)
        part = part if isinstance(part, Column) else F.lit(part)
        return F.struct(F.lit(layer), ix, part, F.lit(shape), paint, points, size, caption, x, y)

    def rectangles(layer: int, kind: str, paint, caption) -> Column:
        def draw(item: Column, ix: Column) -> Column:
            x, y = item["xmin"] * width, item["ymin"] * height
            return primitive(layer, ix, 0, "rectangle", paint, corners(item), no_radius, caption(item), x, y)

        return F.transform(F.col(kind), draw).cast(PRIMITIVE)

    def polygon(segment: Column, ix: Column) -> Column:
        points = F.transform(segment["polygon"], at)
        first = F.get(points, F.lit(0))
        return primitive(1, ix, 0, "polygon", SEGMENT_COLOUR, points, no_radius, scored(segment), first["x"], first["y"])

    def pose(item: Column, ix: Column) -> Column:
        visible = F.filter(item["keypoints"], lambda k: k["visible"])

        def dot(k: Column, part: Column) -> Column:
            p = at(k)
            return primitive(
                2, ix, part, "circle", POSE_COLOUR, F.array(p), radius, k["name"], p["x"] + radius + 2, p["y"]
            )

        first = at(F.get(visible, F.lit(0)))
        name = F.when(
            F.size(visible) > 0,
            F.array(
                primitive(
                    2, ix, F.size(visible), "caption", POSE_COLOUR, F.array(first), no_radius, scored(item), first["x"], first["y"]
                )
            ).cast(PRIMITIVE),
        ).otherwise(F.array().cast(PRIMITIVE))
        return F.concat(F.transform(visible, dot).cast(PRIMITIVE), name)

    banner_height = F.greatest(F.lit(30), F.floor(height * 0.04).cast("int"))
    banner = F.array(
        primitive(
            5,
            F.lit(0),
            0,
            "banner",
            BANNER_COLOUR,
            F.array(
                F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
                F.struct(width.cast("double").alias("x"), banner_height.cast("double").alias("y")),
            ),
            no_radius,
            F.format_string("Model: %s | Uncert: %.2f", F.coalesce("source_model", F.lit("None")), "uncertainty_score"),
            F.lit(10.0),
            F.lit(5.0),
        )
    ).cast(PRIMITIVE)
    primitives = F.concat(
        rectangles(0, "boxes", colour, scored),
        F.transform(F.filter("segments", lambda s: F.size(s["polygon"]) >= 3), polygon).cast(PRIMITIVE),
        F.flatten(F.transform("poses", pose)),
        rectangles(3, "texts", TEXT_COLOUR, lambda t: t["text"]),
        rectangles(4, "tracks", TRACK_COLOUR, lambda t: F.concat(t["track_id"], F.lit(":"), t["label"])),
        banner,
    )
    return final.filter(F.col("image_width") > 0).select("image_id", F.inline(primitives))
