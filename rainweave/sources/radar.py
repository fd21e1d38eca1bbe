"""Radar catalogue and frames. Pixels are not decoded here: frames arrive as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Study box in degrees, file pattern, and the name part that holds the time.
STUDY_BOX = {"left": 103.6, "right": 104.1, "bottom": 1.188, "top": 1.5}
RADAR_FILE_GLOB = "*spacesync_99_*.tif"
TIME_PART, CROPPED_TIME_PART = 2, 3


def radar_file_time(path: Column, cropped: bool = False) -> Column:
    """Time in a radar file name, NULL when the name does not carry one."""
    name = F.element_at(F.split(path, "/"), -1)
    stamp = F.get(F.split(name, "_"), F.lit(CROPPED_TIME_PART if cropped else TIME_PART))
    return F.when(stamp.rlike(r"^\d{12}$"), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm"))).cast("timestamp_ntz")


def read_radar_catalogue(spark: SparkSession, folder: str, cropped: bool = False) -> DataFrame:
    """Paths and times of the radar files below a folder; names without a time are left out."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", RADAR_FILE_GLOB).load(folder).select("path")
    )
    return catalogue(files, cropped)


def catalogue(files: DataFrame, cropped: bool = False) -> DataFrame:
    timed = files.withColumn("time_sgt", radar_file_time(F.col("path"), cropped))
    return timed.where(F.col("time_sgt").isNotNull())


def frames_to_cells(frames: DataFrame, row_order: str = "north_up") -> DataFrame:
    """One row per cell with its coordinates.

    ``north_up``: first raster row is the northern edge and coordinates are cell centres.
    ``ascending``: edges of the outer bounds spread evenly over the cells, first row in the south.
    """
    if row_order not in ("north_up", "ascending"):
        raise ValueError("row_order must be 'north_up' or 'ascending'")
    rows = frames.select(
        "time_sgt", "bounds", F.size("data").alias("_h"), F.posexplode("data").alias("row", "_cells")
    )
    cells = rows.select(
        "time_sgt", "bounds", "_h", F.size("_cells").alias("_w"), "row", F.posexplode("_cells").alias("col", "value")
    )
    left, right = F.col("bounds.left"), F.col("bounds.right")
    bottom, top = F.col("bounds.bottom"), F.col("bounds.top")
    if row_order == "ascending":
        lat = bottom + F.col("row") * (top - bottom) / F.nullif(F.col("_h") - 1, F.lit(0))
        lon = left + F.col("col") * (right - left) / F.nullif(F.col("_w") - 1, F.lit(0))
        # a single row or column sits on the lower edge
        lat, lon = F.coalesce(lat, bottom), F.coalesce(lon, left)
    else:
        lat = top - (F.col("row") + 0.5) * (top - bottom) / F.col("_h")
        lon = left + (F.col("col") + 0.5) * (right - left) / F.col("_w")
    return cells.select("time_sgt", "row", "col", lat.alias("lat"), lon.alias("lon"), "value")


def north_up_transform(bounds: Column, height: Column, width: Column) -> Column:
    """Affine coefficients (a, b, c, d, e, f) of a north-up raster with these bounds."""
    return F.array(
        (bounds["right"] - bounds["left"]) / width, F.lit(0.0), bounds["left"],
        F.lit(0.0), (bounds["bottom"] - bounds["top"]) / height, bounds["top"],
    )


def pixel_of(transform: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional (col, row) of a coordinate, inverse of the affine map without rotation."""
    return (x - transform[2]) / transform[0], (y - transform[5]) / transform[4]


def crop_frames(frames: DataFrame, box: dict[str, float] | None = None) -> DataFrame:
    """Cut frames to a box in whole pixels; adds ``success`` and the moved ``transform``.

    Frames need ``data`` and ``transform``. The pixel window is half-open; a frame without
    pixels in the box keeps its row with ``success`` false and no data.
    """
    box = box or STUDY_BOX
    height, width = F.size("data"), F.size(F.col("data")[0])
    left, top = pixel_of(F.col("transform"), F.lit(box["left"]), F.lit(box["top"]))
    right, bottom = pixel_of(F.col("transform"), F.lit(box["right"]), F.lit(box["bottom"]))
    window = frames.withColumns(
        {
            "_c0": F.greatest(F.lit(0.0), left).cast("int"),
            "_c1": F.least(width.cast("double"), right).cast("int"),
            "_r0": F.greatest(F.lit(0.0), top).cast("int"),
            "_r1": F.least(height.cast("double"), bottom).cast("int"),
        }
    )
    filled = F.coalesce((F.col("_c1") > F.col("_c0")) & (F.col("_r1") > F.col("_r0")), F.lit(False))
    columns = F.col("_c1") - F.col("_c0")
    cut = F.transform(
        F.slice("data", F.col("_r0") + 1, F.greatest(F.col("_r1") - F.col("_r0"), F.lit(0))),
        lambda r: F.slice(r, F.col("_c0") + 1, F.greatest(columns, F.lit(0))),
    )
    t = F.col("transform")
    moved = F.array(t[0], t[1], t[2] + t[0] * F.col("_c0"), t[3], t[4], t[5] + t[4] * F.col("_r0"))
    return (
        window.withColumn("success", filled)
        .withColumn("data", F.when(F.col("success"), cut))
        .withColumn("transform", F.when(F.col("success"), moved))
        .drop("_c0", "_c1", "_r0", "_r1")
    )


def crop_report(cropped: DataFrame, folder: str, path: str = "path", time: str = "time_sgt") -> DataFrame:
    """Result rows of a crop: where each frame came from, where it goes, and whether it worked.

    Targets keep one folder per date; a failed frame has no target.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    target = F.concat_ws("/", F.lit(folder), F.date_format(time, "yyyyMMdd"), F.concat(F.lit("cropped_"), name))
    return cropped.select(
        F.col(time).alias("timestamp"), "weather_idx", F.col(path).alias("input_path"),
        F.when(F.col("success"), target).alias("output_path"), "success",
    )


def zoom_window(bounds: Column, height: Column, width: Column, zoom: dict[str, float]) -> tuple[Column, ...]:
    """Half-open (row0, row1, col0, col1) from rounded fractions of the frame (half to even)."""
    span_x, span_y = bounds["right"] - bounds["left"], bounds["top"] - bounds["bottom"]

    def part(distance: Column, span: Column, n: Column) -> Column:
        return F.bround(distance / span * n).cast("int")

    return (
        part(bounds["top"] - zoom["top"], span_y, height),
        part(bounds["top"] - zoom["bottom"], span_y, height),
        part(F.lit(zoom["left"]) - bounds["left"], span_x, width),
        part(F.lit(zoom["right"]) - bounds["left"], span_x, width),
    )


def within_box(lat: Column, lon: Column, box: dict[str, float]) -> Column:
    """Coordinates inside a box, edges included."""
    return lon.between(box["left"], box["right"]) & lat.between(box["bottom"], box["top"])
