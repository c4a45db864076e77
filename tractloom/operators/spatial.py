"""Radius counts, nearest points and recent closures on the sphere.

Points are placed in a three-dimensional cube grid. A cube that holds many positions is cut into 64 by count, and so are its
parts, so the depth of the tree follows the points; every part is summarised by its count and bounding box. All levels are
rolled up from one summary of the leaves. Sites never meet the points of a cube directly: they walk down the tree. For
radius counts, parts wholly inside the radius add their count and those wholly outside are skipped; only parts that the edge
crosses are looked into, and several radii are answered on one way down. For the nearest point, only parts that can still
beat the best guaranteed distance are kept. Points are compared one by one in the leaves that remain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_MILES, chord_miles, haversine_miles, unit_vector
from ..session import stored

AXES = ("x", "y", "z")
#: Positions that a leaf may hold, and levels at most (a level is four times finer).
CROWDED, DEEPEST = 64, 20
# Relative slack on straight-line tests; the final decision on an edge case is always the exact great-circle formula.
SLACK = 1e-7
CUBE = [f"c{a}" for a in AXES]


def _positioned(df: DataFrame) -> DataFrame:
    x, y, z = unit_vector("lat", "lon")
    return df.withColumns({"x": x, "y": y, "z": z})


def _cubed(df: DataFrame, edge: float) -> DataFrame:
    return df.withColumns({f"c{a}": F.floor(F.col(a) / edge) for a in AXES})


def _around(sites: DataFrame) -> DataFrame:
    """Repeat each site for the 27 cubes around its own."""
    steps = F.array(*[
        F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z"))
        for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)
    ])
    near = sites.withColumn("__d", F.explode(steps))
    return near.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"__d.{a}") for a in AXES}).drop("__d")


class CellTree:
    """Positions in cubes of one edge, cut by count: ``points`` has the path of each position's leaf, ``depth`` the longest."""

    def __init__(self, points: DataFrame, by: list[str], edge: float, limit: int = CROWDED):
        self.by, self.depth = by, 0
        cell = [*by, *CUBE, "path"]
        cut = _cubed(points, edge).withColumn("path", F.array().cast("array<int>"))
        while self.depth < DEEPEST:
            crowded = stored(cut.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit), "crowded-cells")
            if crowded.isEmpty():
                break
            self.depth += 1
            # the edge is divided by a power of two, which floating point does exactly: finer cells nest in coarser ones
            places = [F.floor(F.col(a) / (edge / 4**self.depth)).bitwiseAND(F.lit(3)) for a in AXES]
            child = (places[0] * 16 + places[1] * 4 + places[2]).cast("int")
            path = F.when(F.col("__n").isNotNull(), F.concat("path", F.array(child))).otherwise(F.col("path"))
            cut = stored(cut.join(crowded, cell, "left").withColumn("path", path).drop("__n"), "cells")
        self.points = cut
        self.leaves = stored(self._rolled(cut.withColumns({f"{end}{a}": F.col(a) for a in AXES for end in ("lo", "hi")}), F.col("path")), "leaves")

    def _rolled(self, df: DataFrame, path: Column) -> DataFrame:
        return df.groupBy(*self.by, *CUBE, path.alias("path")).agg(
            F.sum("copies").alias("copies"), F.max(F.size("path")).alias("below"),
            *[F.min(f"lo{a}").alias(f"lo{a}") for a in AXES], *[F.max(f"hi{a}").alias(f"hi{a}") for a in AXES],
        )

    def level(self, at: int) -> DataFrame:
        """Cells cut off at a depth, with the path ``above`` of the cell they lie in; a leaf above that depth lists itself."""
        rolled = self._rolled(self.leaves, F.slice("path", 1, at)) if at else self._rolled(self.leaves, F.slice("path", 1, 0))
        return rolled.withColumn("above", F.slice("path", 1, max(0, at - 1))).withColumn("leaf", F.col("below") <= at)


def _box_distances() -> tuple[Column, Column]:
    """Smallest and largest straight-line distance from a site to a cell's bounding box."""
    near, far = [], []
    for a in AXES:
        p, lo, hi = F.col(a), F.col(f"lo{a}"), F.col(f"hi{a}")
        gap = F.greatest(lo - p, p - hi, F.lit(0.0))
        reach = F.greatest(F.abs(p - lo), F.abs(p - hi))
        near.append(gap * gap)
        far.append(reach * reach)
    return F.sqrt(reduce(lambda u, v: u + v, near)), F.sqrt(reduce(lambda u, v: u + v, far))


def _distinct_sites(places: DataFrame, lat: str, lon: str) -> DataFrame:
    """Places at the same coordinates are searched once."""
    return _positioned(places.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).where("lat is not null and lon is not null").distinct())


def _distinct_points(points: DataFrame, lat: str, lon: str, by: list[str]) -> DataFrame:
    stacked = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(
        *by, F.col(lat).alias("lat"), F.col(lon).alias("lon")
    )
    return _positioned(stacked.agg(F.count(F.lit(1)).alias("copies")))


def _group_values(points: DataFrame, by: list[str]) -> Column:
    """The distinct group values (for instance the years) as one small array."""
    return points.select(F.struct(*by).alias("g")).agg(F.sort_array(F.collect_set("g"))).scalar()


def spine(places: DataFrame, points: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Every place with every group value that occurs among the points."""
    if not by:
        return places.select(*keep)
    return places.select(*keep, F.explode(_group_values(points, by)).alias("__g")).select(
        *keep, *[F.col(f"__g.{b}").alias(b) for b in by]
    )


def counts_within(
    places: DataFrame, points: DataFrame, radii: dict[str, float], place: str = "tract_fips", by: list[str] | None = None,
    lat: str = "lat", lon: str = "lon", crowded: int = CROWDED,
) -> DataFrame:
    """Number of points within each radius (miles, great circle, inclusive) of each place, per group; zeros are kept.

    ``radii`` names an output column for each radius. All are counted on one way down the tree.
    """
    by = by or []
    names, chords = list(radii), [chord_miles(m) for m in radii.values()]
    edge = max(chords) * (1 + SLACK)
    tree = CellTree(stored(_distinct_points(points, lat, lon, by), "positions"), by, edge, crowded)
    site = ["lat", "lon", *by]
    key = [*by, *CUBE]
    near, far = _box_distances()
    touches = [near <= c * (1 + SLACK) for c in chords]
    inside = [far <= c * (1 - SLACK) for c in chords]
    still = [F.col("open")[i] for i in range(len(chords))]

    def summed(df: DataFrame, hits: list[Column]) -> DataFrame:
        return df.groupBy(*site).agg(*[F.sum(F.when(hit, F.col("copies"))).alias(n) for n, hit in zip(names, hits, strict=True)])

    frontier = _around(_cubed(_distinct_sites(places, lat, lon), edge)).withColumn("open", F.array(*[F.lit(True)] * len(chords)))
    found, crossed_leaves = [], []
    for at in range(tree.depth + 1):
        cells = tree.level(at)
        met = frontier.join(cells.drop("above"), CUBE) if at == 0 else frontier.join(cells, [*key, "above"])
        tested = met.withColumns({
            "within": F.array(*[o & t & i for o, t, i in zip(still, touches, inside, strict=True)]),
            "crossed": F.array(*[o & t & ~i for o, t, i in zip(still, touches, inside, strict=True)]),
        }).where(F.exists("within", lambda x: x) | F.exists("crossed", lambda x: x))
        level = stored(tested.select(*site, *AXES, *CUBE, "path", "leaf", "copies", "within", "crossed"), "within")
        found.append(summed(level, [F.col("within")[i] for i in range(len(chords))]))
        deeper = level.where(F.exists("crossed", lambda x: x))
        crossed_leaves.append(deeper.where("leaf").select(*site, *CUBE, "path", "crossed"))
        frontier = deeper.where("not leaf").select(*site, *AXES, *CUBE, F.col("path").alias("above"), F.col("crossed").alias("open"))
    exact = tree.points.select(*key, "path", F.col("lat").alias("__la"), F.col("lon").alias("__lo"), "copies")
    opened = reduce(DataFrame.unionByName, crossed_leaves).join(exact, [*key, "path"]).withColumn("__d", haversine_miles("lat", "lon", "__la", "__lo"))
    found.append(summed(opened, [F.col("crossed")[i] & (F.col("__d") <= m) for i, m in enumerate(radii.values())]))
    counted = reduce(DataFrame.unionByName, found).groupBy(*site).agg(*[F.sum(n).alias(n) for n in names]).withColumnsRenamed({"lat": lat, "lon": lon})
    return spine(places, points, by, [place, lat, lon]).join(counted, [lat, lon, *by], "left").select(
        place, *by, *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def count_within(
    places: DataFrame, points: DataFrame, miles: float, place: str = "tract_fips", by: list[str] | None = None,
    output: str = "n_within", lat: str = "lat", lon: str = "lon", crowded: int = CROWDED,
) -> DataFrame:
    """Number of points within ``miles`` of each place, per group."""
    return counts_within(places, points, {output: miles}, place, by, lat, lon, crowded)


#: Edge of the cubes that the search for the nearest point starts with: at most 125 of them cover the globe.
TOP_EDGE = EARTH_RADIUS_MILES / 2


def nearest(
    places: DataFrame, points: DataFrame, place: str = "tract_fips", by: list[str] | None = None,
    output: str = "nearest_miles", lat: str = "lat", lon: str = "lon", crowded: int = CROWDED,
) -> DataFrame:
    """Great-circle distance to the nearest point, per group; NULL where the group has no points.

    A site starts with all cubes of its group, of which there are few, and at each level keeps the cells that are not farther
    than the far side of the nearest one.
    """
    by = by or []
    site = ["lat", "lon", *by]
    tree = CellTree(stored(_distinct_points(points, lat, lon, by), "positions"), by, TOP_EDGE, crowded)
    near, far = _box_distances()

    def can_win(met: DataFrame) -> DataFrame:
        tested = met.withColumns({"__near": near, "__far": far})
        # a site meets at most 64 parts of each cell it kept, so the window is small for every site
        bound = F.min("__far").over(Window.partitionBy(*site))
        kept = tested.withColumn("__bound", bound).where(F.col("__near") <= F.col("__bound") * (1 + SLACK) + SLACK)
        return stored(kept.select(*site, *AXES, *CUBE, "path"), "nearest")

    start = spine(_distinct_sites(places, lat, lon), points, by, ["lat", "lon", *AXES]).withColumn("__one", F.lit(1))
    top = tree.level(0).drop("above", "copies", "below", "leaf").withColumn("__one", F.lit(1))
    open_cells = can_win(start.join(F.broadcast(top), [*by, "__one"]))
    for at in range(1, tree.depth + 1):
        cells = tree.level(at).drop("copies", "below", "leaf")
        open_cells = can_win(open_cells.withColumnRenamed("path", "above").join(cells, [*by, *CUBE, "above"]))
    exact = tree.points.select(*by, *CUBE, "path", F.col("lat").alias("__la"), F.col("lon").alias("__lo"))
    away = haversine_miles("lat", "lon", "__la", "__lo")
    found = open_cells.join(exact, [*by, *CUBE, "path"]).groupBy(*site).agg(F.min(away).alias(output)).withColumnsRenamed({"lat": lat, "lon": lon})
    return spine(places, points, by, [place, lat, lon]).join(found, [lat, lon, *by], "left").select(place, *by, output)


def recent_closures(
    points: DataFrame, entity: str = "branch_id", year: str = "year", lookback: int = 3, lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Entities seen in the ``lookback`` years before a data year but not in it, at their latest known position."""
    seen = points.groupBy(entity, year).agg(F.min(F.struct(lat, lon)).alias("__at"))
    years = points.agg(F.collect_set(year)).scalar()
    ahead = F.explode(F.sequence(F.col(year) + 1, F.col(year) + lookback))
    due = seen.select(entity, F.col(year).alias("__seen"), "__at", ahead.alias(year)).where(
        F.array_contains(years, F.col(year))
    )
    gone = due.join(seen.select(entity, year), [entity, year], "left_anti")
    last = gone.groupBy(entity, year).agg(F.max_by("__at", "__seen").alias("__at"))
    return last.select(entity, year, F.col(f"__at.{lat}").alias(lat), F.col(f"__at.{lon}").alias(lon))


def presence_flag(spine_df: DataFrame, located: DataFrame, keys: list[str], output: str) -> DataFrame:
    """1 where any listed entity is located in the row's area and year, else 0."""
    marks = located.select(*keys).distinct().withColumn(output, F.lit(1))
    return spine_df.join(marks, keys, "left").withColumn(output, F.coalesce(output, F.lit(0)))
