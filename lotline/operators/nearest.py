"""Exact nearest target for every point, in metres: places, polygons or lines.

Targets are spans, places or segments, and each is in all cells of one grid that it touches. The spans of a
point's own cell tell how far the nearest one can be at most; then the point meets the spans of the cells
that are not farther than that. A point goes to the cells and nothing is multiplied before it is compared,
so what is shuffled grows with the points and the spans, however dense they are.

Points far from all spans, and all points where some cell is much fuller than others, go another way. There targets are items with a box: distinct places, or the segments of polygons and lines, long ones in several
boxes. Items are counted in the cells of grids over their extent, each grid four by four times as fine as
the one before. Down to the grid that evenly spread items need, all cells are counted; below it only
those that hold more than ``CELL_CAPACITY`` items, so one dense spot makes no other cell finer.

Points are grouped by cell too. Groups descend from the whole extent; at each grid a group knows how far
its nearest target can be at most, and drops cells that are farther away at least. What is left of a
group is one row of an aggregate. At the end only the items of the remaining cells are compared with the
points of the group.

Nothing is compared with everything: a group keeps the few cells around it whatever the density.
The result is exact, because a cell is dropped only when it cannot hold the nearest item.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions.geo import edge_side, metres_per_degree, planar_metres, ring_edges, segment_metres, wrap_degrees
from lotline.operators.containment import first_holding
from lotline.operators.skew import join_lookup
from lotline.storage import keep

CELL_CAPACITY = 32
# Each step down splits a cell into 2**STEP x 2**STEP.
STEP = 2
MAX_LEVEL = 30
# Cells and items are sent to all tasks if there are no more than this, at some 100 bytes each.
BROADCAST_ROWS = 200_000
# A span has so many cells on average at most, and a cell so many spans at least.
SPREAD, OCCUPANCY = 24, 4
FINEST_GRID = 20
# The first bound is the distance to one span that begins near, in a grid of cells so many steps of two smaller.
FINER = 2
# With a cell of more spans than this, and than so many times the average, all points descend.
HEAVY_SPANS, HEAVY_TIMES = 256, 16
# A point that would have to look at more cells is left to the descent as well.
MOST_VISITS = 4096
# One that would look at more than so many looks at one span in each first.
FAR_VISITS = 9
# Rounding of a place on a span, as a share of a cell: cells that near count as touched.
CELL_MARGIN = 1e-6
# Bounds are computed from box corners: leave room for rounding.
SLACK = 1 + 1e-9
SLACK_METRES = 1e-6
CELL = ["ix", "iy"]
ENDS = ["ax", "ay", "bx", "by"]
# Number of items, their box, and a place on one of them.
CONTENT = ["n", "x0", "x1", "y0", "y1", "rx", "ry"]
GROUP = ["gl", "gx", "gy"]
GROUP_BOX = ["gx0", "gx1", "gy0", "gy1", "kx_min", "kx_max", "ky_min", "ky_max"]


def _on_grid(column: str, level: Column | int) -> Column:
    power = F.lit(float(2**level)) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(F.col(column) * power).cast("bigint")


def _counted(items: DataFrame, levels: list[int]) -> DataFrame:
    """``level, ix, iy`` and content of the occupied cells of some grids, in one aggregate."""
    each = items.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return each.groupBy("level", _on_grid("ux", F.col("level")).alias("ix"), _on_grid("uy", F.col("level")).alias("iy")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
        F.min("rx").alias("rx"),
        F.min_by("ry", "rx").alias("ry"),
    )


@dataclass(frozen=True)
class Cells:
    """The cells of all grids. Cells of ``even`` and finer grids with at most ``CELL_CAPACITY`` items are not split."""

    table: DataFrame
    rows: int
    even: int
    deepest: int

    def inner(self, level: str = "level", n: str = "n") -> Column:
        return (F.col(level) < self.even) | (F.col(n) > CELL_CAPACITY) & (F.col(level) < MAX_LEVEL)

    def full(self) -> DataFrame:
        """Cells of the even grid that are split, and the finest grid below each."""
        shift = 2.0 ** (-self.even) * F.pow(F.lit(2.0), F.col("level"))
        up = self.table.where(F.col("level") >= self.even).where(self.inner())
        cell = [F.floor(F.col(c) / shift).cast("bigint").alias(f"e{c[1]}") for c in CELL]
        return up.groupBy(*cell).agg((F.max("level") + STEP).alias("depth"))


def _cells(items: DataFrame, n: int) -> Cells:
    even = min(STEP * max(1, math.ceil(math.log(max(n / CELL_CAPACITY, 1), 4) / STEP)), MAX_LEVEL)
    coarse = _counted(items, list(range(STEP, even + 1, STEP)))
    finer = list(range(even + STEP, MAX_LEVEL + 1, STEP))
    if finer:
        full = coarse.where((F.col("level") == even) & (F.col("n") > CELL_CAPACITY)).select(F.col("ix").alias("ex"), F.col("iy").alias("ey"))
        crowded = items.withColumn("ex", _on_grid("ux", even)).withColumn("ey", _on_grid("uy", even)).join(full, ["ex", "ey"], "left_semi")
        coarse = coarse.unionByName(_counted(crowded, finer))
    table = keep(coarse)
    rows, deepest = table.agg(F.count(F.lit(1)), F.max(F.when((F.col("n") > CELL_CAPACITY) & (F.col("level") < MAX_LEVEL), F.col("level")))).first()
    return Cells(table, rows, even, max(even, (deepest or 0) + STEP))


def _least_metres() -> Column:
    """No point of the group is nearer to any item of the cell."""
    gx0, gx1, x0, x1 = (F.col(c) for c in ("gx0", "gx1", "x0", "x1"))
    meets = F.lit(False)
    for turn in (-360.0, 0.0, 360.0):  # an item over the date line goes beyond 180 degrees
        meets = meets | ((gx0 + turn <= x1) & (x0 <= gx1 + turn))
    ends = F.least(F.abs(wrap_degrees(gx0 - x1)), F.abs(wrap_degrees(gx1 - x0)))
    dx = F.when(meets, F.lit(0.0)).otherwise(ends) * F.col("kx_min")
    dy = F.greatest(F.col("y0") - F.col("gy1"), F.col("gy0") - F.col("y1"), F.lit(0.0)) * F.col("ky_min")
    return F.sqrt(dx * dx + dy * dy)


def _most_metres() -> Column:
    """No point of the group is farther from the place that stands for the cell."""
    side = F.abs(wrap_degrees(F.col("gx0") - F.col("rx"))) + (F.col("gx1") - F.col("gx0"))
    dx = F.least(side, F.lit(180.0)) * F.col("kx_max")
    dy = F.greatest(F.abs(F.col("gy0") - F.col("ry")), F.abs(F.col("gy1") - F.col("ry"))) * F.col("ky_max")
    return F.sqrt(dx * dx + dy * dy)


def _groups(probes: DataFrame) -> DataFrame:
    """Boxes of the point groups, with the range of metres per degree within each."""
    boxes = probes.groupBy(*GROUP).agg(
        F.min("px").alias("gx0"), F.max("px").alias("gx1"), F.min("py").alias("gy0"), F.max("py").alias("gy1")
    )
    near_pole = F.greatest(F.abs("gy0"), F.abs("gy1"))
    near_equator = F.when((F.col("gy0") <= 0) & (F.col("gy1") >= 0), F.lit(0.0)).otherwise(
        F.least(F.abs("gy0"), F.abs("gy1"))
    )
    # East-west degrees shrink towards the poles, north-south degrees grow.
    kx_min, ky_max = metres_per_degree(near_pole)
    kx_max, ky_min = metres_per_degree(near_equator)
    return boxes.select(
        "*", kx_min.alias("kx_min"), kx_max.alias("kx_max"), ky_min.alias("ky_min"), ky_max.alias("ky_max")
    )


def _pruned(pairs: DataFrame) -> DataFrame:
    """Groups with the cells that may hold a nearest item, out of groups with cells: one aggregate.

    ``known`` is a place on an item that is about as near as the bound, which holds for every point of the group.
    """
    scored = pairs.withColumn("least", _least_metres()).withColumn("most", _most_metres())
    cells = F.collect_list(F.struct("level", *CELL, *CONTENT, "least"))
    whole = scored.groupBy(*GROUP).agg(
        *(F.first(c).alias(c) for c in GROUP_BOX), F.min("most").alias("bound"), F.min_by(F.struct("rx", "ry"), "most").alias("known"), cells.alias("cells")
    )
    near = F.filter("cells", lambda c: c["least"] <= F.col("bound") * SLACK + SLACK_METRES)
    return whole.select(*GROUP, *GROUP_BOX, "known", F.inline(near)).drop("least")


def _frontier(groups: DataFrame, cells: Cells) -> DataFrame:
    """Groups with the unsplit cells that may hold a nearest item."""
    # The coarsest grid has at most 4**STEP cells: one small value that every group looks at.
    first = cells.table.where(F.col("level") == STEP).agg(F.collect_list(F.struct("level", *CELL, *CONTENT))).scalar()
    frontier = _pruned(groups.withColumn("_cells", first).select("*", F.inline("_cells")).drop("_cells"))
    up = 2**STEP
    below = cells.table.where(F.col("level") > STEP).select(
        (F.col("level") - STEP).alias("up_level"), *(F.floor(F.col(c) / up).cast("bigint").alias(f"up_{c}") for c in CELL), F.struct("level", *CELL, *CONTENT).alias("child")
    )
    below = _small(below, cells.rows)
    for _ in range(STEP, cells.deepest, STEP):
        same = (F.col("level") == F.col("up_level")) & (F.col("ix") == F.col("up_ix")) & (F.col("iy") == F.col("up_iy"))
        split = frontier.drop("known").join(below, same & cells.inner(), "left")
        own = F.struct("level", *CELL, *CONTENT)
        frontier = _pruned(split.select(*GROUP, *GROUP_BOX, F.coalesce("child", own).alias("c")).select(*GROUP, *GROUP_BOX, "c.*"))
    return frontier


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Frame:
    """The extent of the items, as a unit square."""

    west: float
    south: float
    width: float
    height: float

    @classmethod
    def of(cls, west: float, east: float, south: float, north: float) -> Frame:
        # A little more than the extent, so that the last item is inside the last cell.
        return cls(west, south, (east - west or 1.0) * (1 + 1e-9), (north - south or 1.0) * (1 + 1e-9))

    def placed(self, df: DataFrame, x: Column, y: Column) -> DataFrame:
        return df.withColumn("ux", (x - self.west) / self.width).withColumn("uy", (y - self.south) / self.height)


def _descended(points: DataFrame, items: DataFrame, n: int, frame: Frame, metres: Callable[..., Column]) -> DataFrame:
    """``px, py, best``: for each of the different ``px, py`` the least ``(metres, target_id)`` over all items.

    ``items`` is a written table of ``target_id``, a box, a place on the item, its position and ``shape``;
    ``metres(kx, ky, px, py, shape)`` is the distance of a point to an item.
    """
    cells = _cells(items, n)
    probes = frame.placed(points.select("px", "py").distinct(), F.col("px"), F.col("py"))
    at_level = items.withColumn("level", F.lit(cells.even))
    level = F.lit(cells.even)
    if cells.deepest > cells.even:
        full = cells.full()
        probes = probes.withColumn("ex", _on_grid("ux", cells.even)).withColumn("ey", _on_grid("uy", cells.even))
        probes = join_lookup(probes, full, ["ex", "ey"], "left")
        level = F.coalesce("depth", level)
        crowded = items.withColumn("ex", _on_grid("ux", cells.even)).withColumn("ey", _on_grid("uy", cells.even))
        crowded = join_lookup(crowded, full, ["ex", "ey"]).withColumn("level", F.explode(F.sequence(F.lit(cells.even + STEP), F.col("depth").cast("int"), F.lit(STEP))))
        at_level = at_level.unionByName(crowded.drop("ex", "ey", "depth"))
    probes = probes.withColumn("gl", level.cast("int")).withColumn("gx", _on_grid("ux", F.col("gl"))).withColumn("gy", _on_grid("uy", F.col("gl")))
    probes = probes.select("px", "py", *GROUP)
    frontier = _frontier(_groups(probes), cells)
    # An item has a row for each grid that may hold its cell; only the unsplit one is met.
    members = at_level.select("level", _on_grid("ux", F.col("level")).alias("ix"), _on_grid("uy", F.col("level")).alias("iy"), "shape", "target_id")
    # Few groups fan out to many points. Partitions are fixed, since merging small ones here would
    # leave all that work to one task.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = (
        frontier.select(*GROUP, "known", "level", *CELL)
        .repartition(tasks, *GROUP, "level", *CELL)
        .join(_small(members, n if cells.deepest == cells.even else cells.rows + n), ["level", *CELL])
        .select(*GROUP, "known", "shape", "target_id")
    )
    kx, ky = metres_per_degree(F.col("py"))
    known = planar_metres(F.col("kx"), F.col("ky"), F.col("px") - F.col("known.rx"), F.col("py") - F.col("known.ry"))
    return (
        probes.withColumn("kx", kx)
        .withColumn("ky", ky)
        .join(candidates, GROUP)
        .withColumn("metres", metres(F.col("kx"), F.col("ky"), F.col("px"), F.col("py"), F.col("shape")))
        # Most candidates are farther than the known place and never reach the aggregate.
        .filter(F.col("metres") <= known + SLACK_METRES)
        .groupBy("px", "py")
        .agg(F.min(F.struct("metres", "target_id")).alias("best"))
    )


@dataclass(frozen=True)
class Grid:
    """One grid over a frame, of ``2**level`` by ``2**level`` cells."""

    frame: Frame
    level: int

    @classmethod
    def of(cls, frame: Frame, n: int, length: float) -> Grid:
        """The finest grid in which ``n`` spans, together as long as ``length`` frames, have not too many cells."""

        def fits(level: int) -> bool:
            rows = n + 2**level * length
            return rows <= SPREAD * n and OCCUPANCY * 4**level <= rows

        return cls(frame, max((k for k in range(FINEST_GRID + 1) if fits(k)), default=0))

    @property
    def side(self) -> float:
        return float(2**self.level)

    def x(self, lon: Column) -> Column:
        return (lon - self.frame.west) / self.frame.width * self.side

    def y(self, lat: Column) -> Column:
        return (lat - self.frame.south) / self.frame.height * self.side

    def cell(self, place: Column) -> Column:
        """The number of the row or column of cells, or of the nearest one."""
        return F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(self.side - 1))).cast("bigint")

    def registered(self, spans: DataFrame) -> DataFrame:
        """``ix, iy, target_id, ax, ay, bx, by``: each span in all cells that it touches, once in each."""
        x1, x2, y1, y2 = self.x(F.col("ax")), self.x(F.col("bx")), self.y(F.col("ay")), self.y(F.col("by"))
        placed = spans.select("target_id", *ENDS, x1.alias("gx1"), x2.alias("gx2"), y1.alias("gy1"), y2.alias("gy2"))
        x1, x2, y1, y2 = (F.col(c) for c in ("gx1", "gx2", "gy1", "gy2"))
        first, last = (self.cell(end) for end in (F.least(y1, y2) - CELL_MARGIN, F.greatest(y1, y2) + CELL_MARGIN))
        rows = placed.withColumn("iy", F.explode(F.sequence(first, last)))

        def at(y: Column) -> Column:
            t = F.least(F.greatest(F.try_divide(y - y1, y2 - y1), F.lit(0.0)), F.lit(1.0))
            return F.when(t.isNull(), x1).otherwise(x1 + (x2 - x1) * t)

        low, high = at(F.col("iy") - CELL_MARGIN), at(F.col("iy") + 1 + CELL_MARGIN)
        # A flat span has no place at a height of its own: both its ends count.
        high = F.when(y1 == y2, x2).otherwise(high)
        columns = F.sequence(self.cell(F.least(low, high) - CELL_MARGIN), self.cell(F.greatest(low, high) + CELL_MARGIN))
        return rows.withColumn("ix", F.explode(columns)).select(*CELL, "target_id", *ENDS)

    def begun(self, spans: DataFrame) -> DataFrame:
        """``ix, iy, ax, ay, bx, by``: one of the spans that begin in a cell."""
        at = spans.select(self.cell(self.x(F.col("ax"))).alias("ix"), self.cell(self.y(F.col("ay"))).alias("iy"), *ENDS)
        return _any_span(at, *CELL)


def _any_span(spans: DataFrame, *keys: str) -> DataFrame:
    # Values of one row, not of several: each of these takes the first row that it sees, and there are no nulls.
    return spans.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ENDS])


def _visits(bounds: DataFrame, grid: Grid) -> tuple[DataFrame, Column]:
    """``px, py, kx, ky, bound, ix, iy``: the cells that may hold a span within the bound, and how many a point has at most.

    Points that have too many are left out.
    """
    frame, reach = grid.frame, F.col("bound") * SLACK + SLACK_METRES

    def span(at: Column, by: Column) -> tuple[Column, Column]:
        # Beyond the frame on either side there are no cells: an empty range.
        low, high = at - by - CELL_MARGIN, at + by + CELL_MARGIN
        out = (high < -CELL_MARGIN) | (low > grid.side)
        return F.when(~out, grid.cell(low)), F.when(~out, grid.cell(high))

    by_x = reach / F.col("kx") / frame.width * grid.side
    by_y = reach / F.col("ky") / frame.height * grid.side
    y_first, y_last = span(grid.y(F.col("py")), by_y)
    columns = [(turn, *span(grid.x(F.col("px") + turn), by_x)) for turn in (-360.0, 0.0, 360.0)]
    most = F.greatest(*[F.coalesce(last - first + 1, F.lit(0)) for _, first, last in columns])
    number = most * F.coalesce(y_last - y_first + 1, F.lit(0))
    turns = F.array(*[F.struct((F.col("px") + turn).alias("tx"), first.alias("first"), last.alias("last")) for turn, first, last in columns])
    each = bounds.filter(number <= MOST_VISITS).select("px", "py", "kx", "ky", "bound", y_first.alias("y_first"), y_last.alias("y_last"), F.inline(turns))
    # There is nothing to look at in an empty range.
    each = each.filter("first is not null and y_first is not null")
    cells = each.withColumn("ix", F.explode(F.sequence("first", "last"))).withColumn("iy", F.explode(F.sequence("y_first", "y_last")))

    def apart(at: Column, cell: str) -> Column:
        return F.greatest(F.col(cell) - CELL_MARGIN - at, at - F.col(cell) - 1 - CELL_MARGIN, F.lit(0.0))

    dx = apart(grid.x(F.col("tx")), "ix") / grid.side * frame.width * F.col("kx")
    dy = apart(grid.y(F.col("py")), "iy") / grid.side * frame.height * F.col("ky")
    near = cells.filter(F.sqrt(dx * dx + dy * dy) <= reach)
    return near.select("px", "py", "kx", "ky", "bound", *CELL), number


def _best(points: DataFrame, spans: DataFrame, n: int, length: float, frame: Frame, items: Callable[[], tuple[DataFrame, int]], metres: Callable[..., Column]) -> DataFrame:
    """``px, py, best``: for each of the different ``px, py`` the least ``(metres, target_id)`` over all targets.

    ``spans`` is a written table of ``target_id``, two ends ``ax, ay, bx, by`` and ``shape``;
    ``metres(kx, ky, px, py, shape)`` is the distance of a point to one. ``items`` gives the targets as
    ``_descended`` takes them, and how many.
    """
    grid = Grid.of(frame, n, length)
    light = grid.registered(spans)
    average, most = light.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n"), F.max("n")).first()
    if most > max(HEAVY_SPANS, HEAVY_TIMES * average):
        return _descended(points, *items(), frame, metres)
    kx, ky = metres_per_degree(F.col("py"))
    places = points.select("px", "py").distinct().select("px", "py", kx.alias("kx"), ky.alias("ky"))
    # Of spans and of places alike, by number: an end is a place.
    ax, ay, bx, by = (F.col(c) for c in ENDS)
    away = metres(F.col("kx"), F.col("ky"), F.col("px"), F.col("py"), {"x1": ax, "y1": ay, "x2": bx, "y2": by, "x": ax, "y": ay})
    place = ["px", "py", "kx", "ky"]
    fine = Grid(frame, grid.level + FINER)
    begun = fine.begun(spans)
    probes = places.withColumn("ix", fine.cell(fine.x(F.col("px")))).withColumn("iy", fine.cell(fine.y(F.col("py"))))
    near = keep(probes.join(begun, CELL, "left").select(*place, *CELL, away.alias("bound")))
    # Without a span there, some span of the smallest wider cell that has one; up to the whole frame.
    ups = F.explode(F.sequence(F.lit(1), F.lit(fine.level)))
    wider = [F.expr(f"shiftright({c}, up)").alias(c) for c in CELL]
    above = _any_span(begun.withColumn("up", ups).select("up", *wider, *ENDS), "up", *CELL)
    empty = near.filter("bound is null").withColumn("up", ups).select("up", *wider, *place)
    looked = empty.join(above, ["up", *CELL]).groupBy(*place).agg(F.min(away).alias("bound"))
    rough = near.filter("bound is not null").select(*place, "bound").unionByName(looked)
    # The spans of a point's own cell; most are farther than that one and never reach the aggregate.
    own = rough.withColumn("ix", grid.cell(grid.x(F.col("px")))).withColumn("iy", grid.cell(grid.y(F.col("py"))))
    closer = own.join(light.hint("merge"), CELL).withColumn("metres", away).filter("metres <= bound").select(*place, F.col("metres").alias("bound"))
    bounds = keep(closer.unionByName(rough).groupBy(*place).agg(F.min("bound").alias("bound")))
    _, number = _visits(bounds, grid)
    far = bounds.filter((number > FAR_VISITS) & (number <= MOST_VISITS))
    if not far.isEmpty():
        # Beside the spans one looks along them: one span of each of those cells tells how near the nearest is.
        looked, _ = _visits(far, grid)
        nearer = looked.select(*place, *CELL).join(_any_span(light, *CELL).hint("merge"), CELL).select(*place, away.alias("bound")).unionByName(far)
        nearer = nearer.groupBy(*place).agg(F.min("bound").alias("bound"))
        bounds = keep(bounds.filter((number <= FAR_VISITS) | (number > MOST_VISITS)).unionByName(nearer))
    visits, number = _visits(bounds, grid)
    rest = bounds.filter(number > MOST_VISITS).select("px", "py")
    # Most spans are farther than the bound and never reach the aggregate.
    # Sorted: Spark takes the points for few, before they are multiplied by cells.
    met = visits.join(light.hint("merge"), CELL).withColumn("metres", away).filter("metres <= bound")
    found = met.groupBy("px", "py").agg(F.min(F.struct("metres", "target_id")).alias("best"))
    if rest.isEmpty():
        return found
    return found.unionByName(_descended(rest, *items(), frame, metres))


def _located(points: DataFrame, point_id: str, lon: str, lat: str) -> DataFrame:
    return points.select(F.col(point_id).alias("point_id"), F.col(lon).alias("px"), F.col(lat).alias("py"))


def _answered(located: DataFrame, best: DataFrame | None, kind: str) -> DataFrame:
    if best is None:
        return located.selectExpr("point_id", f"cast(null as {kind}) as target_id", "cast(null as double) as metres")
    return join_lookup(located, best, ["px", "py"], "left").select("point_id", "best.target_id", "best.metres")


def nearest(
    points: DataFrame,
    targets: DataFrame,
    point_id: str = "point_id",
    target_id: str = "target_id",
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """``(point_id, target_id, metres)`` for every point; equal distances go to the lowest id.

    Distances are planar at the point's latitude on the WGS84 ellipsoid.
    """
    located, kind = _located(points, point_id, lon, lat), targets.schema[target_id].dataType.simpleString()
    placed = targets.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    n, *extent = placed.agg(F.count(F.lit(1)), F.min(lon), F.max(lon), F.min(lat), F.max(lat)).first()
    if not n:
        return _answered(located, None, kind)
    frame = Frame.of(*extent)
    # Copies of a place are one item with the lowest id.
    places = placed.groupBy(F.col(lon).alias("x0"), F.col(lat).alias("y0")).agg(F.min(target_id).alias("target_id"))
    x, y = F.col("x0"), F.col("y0")
    items = keep(frame.placed(places, x, y).select("target_id", "ux", "uy", "x0", x.alias("x1"), "y0", y.alias("y1"), x.alias("rx"), y.alias("ry"), F.struct(x.alias("x"), y.alias("y")).alias("shape")))
    spans = items.select("target_id", x.alias("ax"), y.alias("ay"), x.alias("bx"), y.alias("by"), "shape")
    usable = located.filter("px is not null and py is not null")
    best = _best(usable, spans, n, 0.0, frame, lambda: (items, n), lambda kx, ky, px, py, shape: planar_metres(kx, ky, px - shape["x"], py - shape["y"]))
    return _answered(located, best, kind)


def _pieces(spans: DataFrame, n: int, total: float, frame: Frame) -> tuple[DataFrame, int]:
    """Items out of spans; a long one has several boxes, four times as many as spans in all."""
    turned = spans.select("target_id", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), "shape")
    long_side = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    # About the side of a cell of evenly spread items, and not so short that there are too many.
    piece = max(max(frame.width, frame.height) / math.sqrt(max(n / CELL_CAPACITY, 1)), total / (3 * n), 1e-12)
    pieces = turned.withColumn("pieces", F.ceil(long_side / piece).cast("int")).withColumn("pieces", F.greatest("pieces", F.lit(1)))
    each = pieces.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

    def along(a: str, b: str, k: Column) -> Column:
        inner = F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("pieces"))
        return F.when(k == F.col("pieces"), F.col(b)).otherwise(inner)

    for name, k in (("f", F.col("k")), ("t", F.col("k") + 1)):
        each = each.withColumn(f"{name}x", along("x1", "x2", k)).withColumn(f"{name}y", along("y1", "y2", k))
    boxed = frame.placed(each, (F.col("fx") + F.col("tx")) / 2, (F.col("fy") + F.col("ty")) / 2)
    items = boxed.select(
        "target_id",
        "ux",
        "uy",
        F.least("fx", "tx").alias("x0"),
        F.greatest("fx", "tx").alias("x1"),
        F.least("fy", "ty").alias("y0"),
        F.greatest("fy", "ty").alias("y1"),
        F.col("fx").alias("rx"),
        F.col("fy").alias("ry"),
        "shape",
    )
    return keep(items), 4 * n


def _segments(geometries: DataFrame, target_id: str, lines: Column) -> DataFrame:
    """``target_id, x1, y1, x2, y2`` of lists of points, each different segment of a target once."""
    each = geometries.select(F.col(target_id).alias("target_id"), F.explode(lines).alias("line")).select("target_id", F.inline(ring_edges(F.col("line"))))
    whole = each.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    return whole.groupBy("x1", "y1", "x2", "y2").agg(F.min("target_id").alias("target_id"))


def _nearest_segment(located: DataFrame, segments: DataFrame) -> DataFrame | None:
    # The shorter way round the earth.
    turned = F.col("x1") + wrap_degrees(F.col("x2") - F.col("x1"))
    ends = segments.select("target_id", F.col("x1").alias("ax"), F.col("y1").alias("ay"), turned.alias("bx"), F.col("y2").alias("by"))
    spans = keep(ends.withColumn("shape", F.struct(F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))))
    dx, dy = F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))
    n, total, wide, high, west, east, south, north = spans.agg(
        F.count(F.lit(1)),
        F.sum(F.greatest(dx, dy)),
        F.sum(dx),
        F.sum(dy),
        F.min(F.least("ax", "bx")),
        F.max(F.greatest("ax", "bx")),
        F.min(F.least("ay", "by")),
        F.max(F.greatest("ay", "by")),
    ).first()
    if not n:
        return None
    frame = Frame.of(west, east, south, north)
    usable = located.filter("px is not null and py is not null")
    length = wide / frame.width + high / frame.height
    return _best(usable, spans, n, length, frame, lambda: _pieces(spans, n, total, frame), segment_metres)


def nearest_line(
    points: DataFrame,
    lines: DataFrame,
    point_id: str = "point_id",
    line_id: str = "line_id",
    paths: str = "paths",
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """``(point_id, target_id, metres)``: the line nearest to every point; equal distances go to the lowest id.

    ``paths`` is a list of lines, each a list of ``[lon, lat]`` points; a part goes the shorter way round
    the earth. Distances are planar at the point's latitude on the WGS84 ellipsoid.
    """
    located = _located(points, point_id, lon, lat)
    best = _nearest_segment(located, _segments(lines, line_id, F.col(paths)))
    return _answered(located, best, lines.schema[line_id].dataType.simpleString())


def nearest_polygon(
    points: DataFrame,
    polygons: DataFrame,
    point_id: str = "point_id",
    polygon_id: str = "polygon_id",
    rings: str = "rings",
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """``(point_id, target_id, metres)``: the polygon nearest to every point, 0 metres inside one.

    ``rings`` is a list of polygons, each a list of closed rings of ``[lon, lat]`` points. A point in a
    hole is as far as the ring of the hole. Equal distances, so several polygons around a point too, go
    to the lowest id. Distances are planar at the point's latitude on the WGS84 ellipsoid.
    """
    located, kind = _located(points, point_id, lon, lat), polygons.schema[polygon_id].dataType.simpleString()
    outlines = F.flatten(F.filter(rings, lambda part: part.isNotNull()))
    segments = _segments(polygons, polygon_id, outlines)
    places = located.select("px", "py").distinct().withColumn("place", F.struct("px", "py"))
    # At no distance: inside, or on an edge. Without an id comes last.
    first = F.struct(F.col(polygon_id).isNull(), F.col(polygon_id))
    at = first_holding(places, polygons, "place", "px", "py", polygon_id, rings, first, (_near_edge, _at_edge))
    zero = keep(at.select("px", "py", F.struct(F.lit(0.0).alias("metres"), F.col("polygon_id").alias("target_id")).alias("best")))
    # Only the others have a nearest edge to look for.
    best = _nearest_segment(places.select("px", "py").join(zero, ["px", "py"], "left_anti"), segments)
    return _answered(located, zero if best is None else best.unionByName(zero), kind)


def _near_edge(x: Column, y: Column, edge: Column) -> Column:
    """Whether a point is next to an edge, as far as a short test can tell."""

    def near(v: Column, a: Column, b: Column) -> Column:
        return ((v + 1e-9 >= a) | (v + 1e-9 >= b)) & ((v - 1e-9 <= a) | (v - 1e-9 <= b))

    # The box of a slanted edge is wide: off its line is off the edge, unless that goes over the date line.
    dx, dy = F.abs(edge["x2"] - edge["x1"]), F.abs(edge["y2"] - edge["y1"])
    on_line = (F.abs(edge_side(x, y, edge)) <= (dx + dy) * 1e-9) | (dx > 180)
    return near(x, edge["x1"], edge["x2"]) & near(y, edge["y1"], edge["y2"]) & on_line


def _at_edge(x: Column, y: Column, edge: Column) -> Column:
    """Whether the distance from a point to an edge is zero."""
    kx, ky = metres_per_degree(y)
    return segment_metres(kx, ky, x, y, edge) == 0
