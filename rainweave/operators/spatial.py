"""Spatial joins: radius, nearest neighbours, coverage, grids.

Coordinates are degrees and distances are Euclidean in degrees, as everywhere in this library;
``km / 111`` converts. Nothing here compares all points with all points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainweave.functions.geo import KM_PER_DEGREE, segment_distance, straight_distance
from rainweave.session import checkpointed

# a leaf of the search tree holds at most this many distinct coordinates
LEAF_SITES = 32
# left points of one square that are compared in one task
SQUARE_ROWS = 512
# sources in one task: each carries some ten squares and a few hundred pairs at once, about 30 KB
SOURCES_PER_TASK = 2048
# squares of a level (or sites, in groups) up to which a level is taken to join without a shuffle
FEW_SQUARES = 4096
# 4**12 cells per axis: about 3 cm over a 500 km box
MAX_DEPTH = 12


def make_grid(spark: SparkSession, x: tuple[float, float, float], y: tuple[float, float, float],
              y_descending: bool = True) -> DataFrame:
    """Grid cells (row, col, x, y) for half-open axes given as (start, stop, step)."""

    def size(start: float, stop: float, step: float) -> int:
        return max(0, math.ceil((stop - start) / step - 1e-9))

    nx, ny = size(*x), size(*y)
    cells = spark.range(nx * ny).select(
        F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col")
    )
    along_y = (F.lit(ny - 1) - F.col("row")) if y_descending else F.col("row")
    return cells.select(
        "row", "col", (F.lit(float(x[0])) + F.col("col") * F.lit(float(x[2]))).alias("x"),
        (F.lit(float(y[0])) + along_y * F.lit(float(y[2]))).alias("y"),
    )


def grid_around(points: DataFrame, x: str, y: str, resolution: float) -> DataFrame:
    """Grid over the bounding box of the points, widened by the resolution; y descending."""
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    low_x, high_x, low_y, high_y = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    r = resolution
    return make_grid(points.sparkSession, (low_x - r, high_x + r, r), (low_y - r, high_y + r, r))


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, left_id: str, right_id: str,
                x: str = "longitude", y: str = "latitude", unit: str = "km", without_self: bool = False) -> DataFrame:
    """Pairs (src, dst, dist) of left and right points within the radius.

    Both sides are keyed by squares as wide as the radius; right points are copied to the nine
    squares around them. A crowded square yields output by its square: its left points are cut in
    parts of bounded size, each with its own copy of the right ones, and there are as many tasks as parts.
    """
    radius = radius_km / KM_PER_DEGREE
    factor = {"km": KM_PER_DEGREE, "degrees": 1.0}[unit]

    def square(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(radius))

    near = F.sequence(F.lit(-1), F.lit(1))
    a = left.select(F.col(left_id).alias("src"), F.col(x).alias("_ax"), F.col(y).alias("_ay")).withColumns(
        {"_i": square("_ax"), "_j": square("_ay")}
    )
    b = (
        right.select(F.col(right_id).alias("dst"), F.col(x).alias("_bx"), F.col(y).alias("_by"))
        .withColumn("_di", F.explode(near))
        .withColumn("_dj", F.explode(near))
        .withColumns({"_i": square("_bx") + F.col("_di"), "_j": square("_by") + F.col("_dj")})
    )
    parts = checkpointed(a.groupBy("_i", "_j").agg(F.ceil(F.count(F.lit(1)) / SQUARE_ROWS).alias("_parts")))
    tasks = parts.agg(F.sum("_parts")).first()[0] or 1
    a = a.join(parts, ["_i", "_j"]).withColumn("_part", F.pmod(F.xxhash64("src", "_ax", "_ay"), F.col("_parts"))).drop("_parts")
    b = b.join(parts, ["_i", "_j"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    place = ["_i", "_j", "_part"]
    distance = straight_distance(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))
    # both sides, since either may be the one that streams past the other
    pairs = a.repartition(tasks, *place).join(b.repartition(tasks, *place), place).withColumn("_d", distance).where(F.col("_d") <= radius)
    if without_self:
        pairs = pairs.where(F.col("src") != F.col("dst"))
    return pairs.select("src", "dst", (F.col("_d") * F.lit(factor)).alias("dist"))


def nearest_neighbours(sources: DataFrame, targets: DataFrame, k: int, source_id: Sequence[str], target_id: str,
                       by: Sequence[str] = (), x: str = "longitude", y: str = "latitude", payload: Sequence[str] = (),
                       without_self: bool = False, max_distance: float | None = None) -> DataFrame:
    """The ``k`` nearest targets of every source, exactly, within groups of equal ``by``.

    Ties go to the smaller target id. Columns: by, source_id, target_id, payload, dist, rank;
    ``source_id`` must differ from ``target_id`` in name. ``without_self`` skips equal ids.

    A tree of squares (each split in 4 x 4) is descended level by level with equi-joins. Per
    source only the squares survive that can still hold one of the k nearest: a square is
    dropped when k points are known to lie nearer than its nearest edge. Targets at one
    coordinate are reduced to the few with the smallest ids first, so neither crowded squares
    nor equal coordinates lead to all pairs. Sources are dealt over tasks by their number, not by
    their bytes, since each grows to many rows.
    """
    by, source_id, payload = list(by), list(source_id), list(payload)
    need = k + 1 if without_self else k
    keep = F.row_number().over(Window.partitionBy(*by, x, y).orderBy(target_id)) <= need
    sites = (
        targets.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(*by, target_id, x, y, *payload)
        .withColumn("_keep", keep)
        .where("_keep")
        .groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.sort_array(F.collect_list(F.struct(target_id, *payload))).alias("_members"))
    )
    sites = checkpointed(sites)  # read once per level below
    n_sites, *box = sites.agg(F.count(F.lit(1)), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    low_x, high_x, low_y, high_y = [v if v is not None else 0.0 for v in box]
    side = max(high_x - low_x, high_y - low_y) or 1.0

    def square(value: Column, low: float, cells: Column) -> Column:
        return F.least(F.floor((value - F.lit(low)) / F.lit(side) * cells), cells - 1).cast("long")

    def placed(df: DataFrame, level: Column) -> DataFrame:
        cells = F.pow(F.lit(4.0), level)
        return df.withColumns({"_i": square(F.col("_x"), low_x, cells), "_j": square(F.col("_y"), low_y, cells)})

    depth = _tree_depth(placed, sites, by, n_sites)

    def squares(level: int) -> DataFrame:
        return (
            placed(sites, F.lit(level))
            .groupBy(*by, "_i", "_j")
            .agg(
                F.count(F.lit(1)).alias("_sites"), F.sum(F.size("_members")).alias("_points"),
                F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"),
            )
            .withColumn("_leaf", (F.col("_sites") <= LEAF_SITES) | F.lit(level >= depth))
            .drop("_sites")
        )

    asked = checkpointed(sources.select(*by, *source_id, F.col(x).cast("double").alias("_sx"), F.col(y).cast("double").alias("_sy")).where(
        F.col("_sx").isNotNull() & F.col("_sy").isNotNull()
    ))
    tasks = math.ceil(asked.count() / SOURCES_PER_TASK) or 1

    def dealt(df: DataFrame) -> DataFrame:
        """Sources over tasks by their number; adaptive execution would merge them by their few bytes after a join by square."""
        return df.repartition(tasks, *by, *source_id)

    asked = dealt(asked)
    line = Window.partitionBy(*by, *source_id)
    zero = F.lit(0.0)

    def pruned(front: DataFrame, level: int) -> DataFrame:
        if tasks > 1 and min(n_sites, FEW_SQUARES + 1 if by else 16**level) > FEW_SQUARES:
            front = dealt(front)
        known = F.sum("_points").over(line.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0))
        within = F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound"))
        # first by the bound of the level above, which spares most rows the sort
        kept = (
            front.where(within)
            .withColumn("_known", known)
            .withColumn("_bound", F.least("_bound", F.min(F.when(F.col("_known") >= need, F.col("_far"))).over(line)))
            .where(within)
            .drop("_known")
        )
        return kept if max_distance is None else kept.where(F.col("_near") <= max_distance)

    def edges(prefix: str) -> tuple[Column, Column]:
        """Distances to the nearest and to the farthest edge of a square's contents."""
        x0, x1, y0, y1 = (F.col(prefix + c) for c in ("_x0", "_x1", "_y0", "_y1"))
        sx, sy = F.col("_sx"), F.col("_sy")
        near_x, near_y = F.greatest(x0 - sx, sx - x1, zero), F.greatest(y0 - sy, sy - y1, zero)
        far_x, far_y = F.greatest(F.abs(x0 - sx), F.abs(sx - x1)), F.greatest(F.abs(y0 - sy), F.abs(sy - y1))
        return F.sqrt(near_x * near_x + near_y * near_y), F.sqrt(far_x * far_x + far_y * far_y)

    state = [*by, *source_id, "_sx", "_sy", "_level", "_i", "_j", "_leaf", "_near", "_far", "_points", "_bound"]
    if by:
        start = 0
        roots = squares(0).select(*by, "_leaf")
        front = asked.join(roots, by).withColumns(
            {"_level": F.lit(0), "_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long"), "_near": zero,
             "_far": F.lit(None).cast("double"), "_points": F.lit(None).cast("long"), "_bound": F.lit(None).cast("double")}
        )
    else:
        # without groups the root is one square for all; its sixteen parts are keyed right away
        start, depth = 1, max(depth, 1)
        parts = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
        opened = asked.withColumn("_i", F.explode(parts)).withColumn("_j", F.explode(parts)).join(squares(1), ["_i", "_j"])
        near, far = edges("")
        front = pruned(opened.withColumns({"_level": F.lit(1), "_near": near, "_far": far, "_bound": F.lit(None).cast("double")}).select(*state), 1)
    # an impossible square number for finished rows, spread so that they share no partition
    nowhere = -1 - F.pmod(F.xxhash64(*by, *source_id), F.lit(1 << 20))
    for level in range(start, depth):
        children = squares(level + 1).select(
            *by, F.floor(F.col("_i") / 4).alias("_pi"), F.floor(F.col("_j") / 4).alias("_pj"),
            *[F.col(c).alias("_c" + c) for c in ("_i", "_j", "_points", "_x0", "_x1", "_y0", "_y1", "_leaf")],
        )
        near, far = edges("_c")
        is_child = F.col("_c_i").isNotNull()
        front = pruned(
            front.withColumn("_pi", F.when(F.col("_leaf"), nowhere).otherwise(F.col("_i")))
            .withColumnRenamed("_j", "_pj")
            .join(children, [*by, "_pi", "_pj"], "left")
            .select(
                *by, *source_id, "_sx", "_sy",
                F.when(is_child, F.lit(level + 1)).otherwise(F.col("_level")).alias("_level"),
                F.coalesce("_c_i", "_i").alias("_i"), F.coalesce("_c_j", "_pj").alias("_j"),
                F.coalesce("_c_leaf", "_leaf").alias("_leaf"),
                F.when(is_child, near).otherwise(F.col("_near")).alias("_near"),
                F.when(is_child, far).otherwise(F.col("_far")).alias("_far"),
                F.coalesce("_c_points", "_points").alias("_points"), "_bound",
            ),
            level + 1,
        )
    levelled = placed(sites.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(depth)))), F.col("_level"))
    distance = straight_distance(F.col("_sx"), F.col("_sy"), F.col("_x"), F.col("_y"))
    pairs = (
        front.select(*by, *source_id, "_sx", "_sy", "_level", "_i", "_j", "_bound")
        .join(levelled, [*by, "_level", "_i", "_j"])
        .where(F.col("_bound").isNull() | (distance <= F.col("_bound")))
        .select(*by, *source_id, distance.alias("dist"), F.explode("_members").alias("_member"))
        .select(*by, *source_id, "dist", "_member.*")
    )
    if without_self:
        pairs = pairs.where(F.col(source_id[0]) != F.col(target_id))
    if max_distance is not None:
        pairs = pairs.where(F.col("dist") < max_distance)
    if tasks > 1:
        pairs = dealt(pairs)
    rank = F.row_number().over(line.orderBy("dist", target_id))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _tree_depth(placed, sites: DataFrame, by: Sequence[str], n_sites: int) -> int:
    """Smallest level at which every square holds few coordinates.

    Even data needs about log16(n / leaf) levels, so these are measured first; deeper ones only
    where places are crowded. Each measurement returns one row per level.
    """
    first, last = 0, 1 + math.ceil(math.log(max(n_sites, 1) / LEAF_SITES, 16)) if n_sites > LEAF_SITES else 0
    while first <= MAX_DEPTH:
        last = min(last, MAX_DEPTH)
        levels = sites.withColumn("_level", F.explode(F.sequence(F.lit(first), F.lit(last))))
        crowd = (
            placed(levels, F.col("_level"))
            .groupBy(*by, "_level", "_i", "_j").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("_level").agg(F.max("n").alias("n"))
        )
        fits = [row["_level"] for row in crowd.collect() if row["n"] <= LEAF_SITES]
        if fits or n_sites == 0:
            return min(fits, default=0)
        first, last = last + 1, last + 3
    return MAX_DEPTH


def _square_side(reach: float) -> float:
    if reach < 0:
        raise ValueError("reach must not be negative")
    return 4.0 * reach if reach > 0 else 0.01


def link_squares(links: DataFrame, reach: float) -> DataFrame:
    """The squares (``_i``, ``_j``) that lie within ``reach`` of each link path, with the ends of the path.

    Per column of squares the piece of the path near the column gives the rows it passes, so the squares of a
    link follow its length and not the area of its bounding box.
    """
    side = _square_side(reach)
    wide = reach * (1 + 1e-9) + 1e-12  # a little more, for rounding; distances are compared afterwards

    def number(value: Column) -> Column:
        return F.floor(value / F.lit(side))

    ax, ay = F.col("site_a_longitude"), F.col("site_a_latitude")
    bx, by_ = F.col("site_b_longitude"), F.col("site_b_latitude")
    left, right = F.least(ax, bx), F.greatest(ax, bx)
    columns = links.select(ax, ay, bx, by_).distinct().withColumn("_i", F.explode(F.sequence(number(left - wide), number(right + wide))))
    begin = F.least(F.greatest(left, F.col("_i") * side - wide), right)
    end = F.greatest(F.least(right, (F.col("_i") + 1) * side + wide), left)

    def height(x: Column) -> Column:
        return ay + (x - ax) * F.try_divide(by_ - ay, bx - ax)

    # an upright path passes all its rows in one column
    low = F.coalesce(F.least(height(begin), height(end)), F.least(ay, by_))
    high = F.coalesce(F.greatest(height(begin), height(end)), F.greatest(ay, by_))
    return columns.withColumn("_j", F.explode(F.sequence(number(low - wide), number(high + wide))))


def covered_cells(cells: DataFrame, links: DataFrame, reach: float, cell_id: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Cells with the flag ``covered``: within ``reach`` degrees of any link path.

    Links need site_a_/site_b_ coordinates. Links are keyed by the squares along their path, so a cell
    meets only the links near it; hits are reduced per cell at once.
    """
    side = _square_side(reach)
    placed = cells.withColumns({"_i": F.floor(F.col(x) / F.lit(side)), "_j": F.floor(F.col(y) / F.lit(side))})
    ends = [F.col(f"site_{end}_{axis}") for end in "ab" for axis in ("longitude", "latitude")]
    near = segment_distance(F.col(x), F.col(y), *ends) <= reach
    hits = placed.join(link_squares(links, reach), ["_i", "_j"]).where(near).select(*cell_id).distinct().withColumn("covered", F.lit(True))
    return cells.join(hits, list(cell_id), "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
