"""SVG drawings of small results, and the frame table of a moving scene.

Drawings are for eyes: they take at most `limit` shapes to the driver and
refuse more.  Frames stay a DataFrame.
"""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OutOfRangeError, UnsupportedInputError
from ..operators.aggregates import figure_size
from ..operators.trajectories import snap_at

LIMIT = 20_000
#: From wide to narrow roads, and of kinds of building; a link road has the colour of its road.
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "footway")
BUILDINGS = ("house", "apartments", "retail", "office", "warehouse", "school", "hospital", "church")


def road_colour(kind: str | None) -> str:
    """From dark blue to light as roads get narrower; gray where the class is not known."""
    name = (kind or "").removesuffix("_link")
    return f"hsl(215, 60%, {25 + 6 * ROADS.index(name)}%)" if name in ROADS else "gray"


def building_colour(kind: str | None) -> str:
    """A hue of its own for each known kind; light gray for others."""
    return f"hsl({360 * BUILDINGS.index(kind) // len(BUILDINGS)}, 35%, 70%)" if kind in BUILDINGS else "lightgray"


def _take(df: DataFrame, limit: int) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise OutOfRangeError(f"a drawing takes at most {limit} shapes; filter or aggregate first")
    return rows


class Drawing:
    """Layers of shapes; save() writes one SVG file."""

    def __init__(self, swap: bool = False, limit: int = LIMIT):
        self.swap, self.limit, self.items, self.box = swap, limit, [], None

    def _at(self, p) -> tuple[float, float]:
        x, y = (p["y"], p["x"]) if self.swap else (p["x"], p["y"])
        self.box = (x, x, y, y) if self.box is None else (min(self.box[0], x), max(self.box[1], x), min(self.box[2], y), max(self.box[3], y))
        return x, y

    def points(self, df: DataFrame, loc: str = "loc", colour: str = "black", radius: float = 2.0, label: str | None = None) -> Drawing:
        for r in _take(df.select(F.col(loc).alias("p"), *([F.col(label).cast("string").alias("t")] if label else [])), self.limit):
            self.items.append(("point", [self._at(r["p"])], colour, radius, r["t"] if label else None))
        return self

    def polylines(self, df: DataFrame, seq: str = "seq", colour: str = "black", width: float = 1.0) -> Drawing:
        for r in _take(df.select(F.col(seq).alias("s")), self.limit):
            self.items.append(("line", [self._at(p) for p in r["s"]], colour, width, None))
        return self

    def arcs(self, df: DataFrame, arc: str = "arc", colour: str = "black", width: float = 1.0) -> Drawing:
        return self.polylines(df.select(F.array(F.col(f"{arc}.a"), F.col(f"{arc}.b")).alias("seq")), "seq", colour, width)

    def polygons(self, df: DataFrame, ring: str = "poly", colour: str = "gray", label: str | None = None) -> Drawing:
        for r in _take(df.select(F.col(ring).alias("s"), *([F.col(label).cast("string").alias("t")] if label else [])), self.limit):
            self.items.append(("area", [self._at(p) for p in r["s"]], colour, 1.0, r["t"] if label else None))
        return self

    def roads(self, df: DataFrame, shape: str = "shape") -> Drawing:
        for r in _take(df.select(F.col(shape).alias("s"), "class"), self.limit):
            self.items.append(("line", [self._at(p) for p in r["s"]], road_colour(r["class"]), 1.0, None))
        return self

    def buildings(self, df: DataFrame, shape: str = "shape") -> Drawing:
        for r in _take(df.select(F.col(shape).alias("s"), "type"), self.limit):
            self.items.append(("area", [self._at(p) for p in r["s"]], building_colour(r["type"]), 1.0, None))
        return self

    def svg(self, side: float = 600.0) -> str:
        box = self.box or (0.0, 1.0, 0.0, 1.0)
        w, h = figure_size(*box, side=side)
        sx, sy = (w - 20) / max(box[1] - box[0], 1e-9), (h - 20) / max(box[3] - box[2], 1e-9)
        put = lambda p: f"{10 + (p[0] - box[0]) * sx:.2f},{h - 10 - (p[1] - box[2]) * sy:.2f}"
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w:.0f}" height="{h:.0f}">']
        for kind, pts, colour, size, text in self.items:
            path, c = " ".join(map(put, pts)), escape(colour, quote=True)
            if kind == "point":
                x, y = path.split(",")
                out.append(f'<circle cx="{x}" cy="{y}" r="{size}" fill="{c}"/>')
            elif kind == "line":
                out.append(f'<polyline points="{path}" fill="none" stroke="{c}" stroke-width="{size}"/>')
            else:
                out.append(f'<polygon points="{path}" fill="{c}" fill-opacity="0.5" stroke="{c}"/>')
            if text:
                x, y = put(pts[0]).split(",")
                out.append(f'<text x="{x}" y="{y}" font-size="9">{escape(text)}</text>')
        return "\n".join([*out, "</svg>"])

    def save(self, path: str, side: float = 600.0) -> None:
        with open(path, "w") as f:
            f.write(self.svg(side))


class Drawing3D(Drawing):
    """Layers of shapes in space, seen from above at an angle (degrees around z, then of the view's height)."""

    def __init__(self, turn: float = 30.0, height: float = 30.0, limit: int = LIMIT):
        super().__init__(False, limit)
        self.turn, self.height = math.radians(turn), math.radians(height)

    def _at(self, p) -> tuple[float, float]:
        x, y, z = p["x"], p["y"], p["z"]
        right = x * math.cos(self.turn) + y * math.sin(self.turn)
        away = y * math.cos(self.turn) - x * math.sin(self.turn)
        return super()._at({"x": right, "y": away * math.sin(self.height) + z * math.cos(self.height)})

    def polyhedra(self, df: DataFrame, faces: str = "faces", colour: str = "gray") -> Drawing3D:
        """A column of faces, each an array of points."""
        return self.polygons(df.select(F.explode(faces).alias("poly")), "poly", colour)

    def cones(self, df: DataFrame, center: str = "center", height: str = "max_height", tan_alpha: float = 1.0, colour: str = "steelblue", sides: int = 24) -> Drawing3D:
        """Cones that stand on their tip at a place of the ground: the rim and every sixth line from the tip to it."""
        c, h = F.col(center), F.col(height)
        rim = lambda i: F.struct((c["x"] + h * tan_alpha * F.cos(i * (2 * math.pi / sides))).alias("x"), (c["y"] + h * tan_alpha * F.sin(i * (2 * math.pi / sides))).alias("y"), h.cast("double").alias("z"))
        tip = F.struct(c["x"].alias("x"), c["y"].alias("y"), F.lit(0.0).alias("z"))
        self.polygons(df.select(F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), rim).alias("poly")), "poly", colour)
        lines = F.explode(F.transform(F.sequence(F.lit(0), F.lit(sides - 1), F.lit(6)), lambda i: F.array(tip, rim(i))))
        return self.polylines(df.select(lines.alias("seq")), "seq", colour)


def region_map(boundaries: DataFrame, ring: str = "poly", label: str | None = None, colour: str = "gainsboro") -> Drawing:
    """A map of regions from a table of (lat, lon) rings, as `readers.region_polygons` gives them, east to the right."""
    return Drawing(swap=True).polygons(boundaries, ring, colour, label)


def gantt_rows(df: DataFrame, entity: str = "entity_id", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Bars of a Gantt chart: a lane for each entity; a bar that ends before it begins is an error."""
    bad = df.where(F.col(lo) > F.col(hi)).limit(1).count()
    if bad:
        raise UnsupportedInputError("a bar ends before it begins")
    lanes = df.select(entity).distinct().orderBy(entity).limit(LIMIT + 1).collect()
    if len(lanes) > LIMIT:
        raise OutOfRangeError(f"a chart takes at most {LIMIT} entities")
    order = F.create_map(*(x for i, r in enumerate(lanes) for x in (F.lit(r[0]), F.lit(i)))) if lanes else F.create_map().cast("map<string,int>")
    return df.withColumn("lane", order[F.col(entity)])


def gantt(df: DataFrame, entity: str = "entity_id", lo: str = "lo", hi: str = "hi") -> Drawing:
    """A drawing of gantt_rows."""
    y = F.col("lane").cast("double")
    corner = lambda x, dy: F.struct(F.col(x).cast("double").alias("x"), (y + dy).alias("y"))
    bars = gantt_rows(df, entity, lo, hi).withColumn("poly", F.array(corner(lo, 0.0), corner(hi, 0.0), corner(hi, 0.8), corner(lo, 0.8)))
    return Drawing().polygons(bars, "poly", "steelblue", entity)


def frames(fixes: DataFrame, key: str, start: float, end: float, speed: float = 1.0, fps: int = 12, t: str = "t") -> DataFrame:
    """State of every object at every tick of the clock: (key, tick, at, x, y, speed)."""
    n = int((end - start) * fps / speed)
    ticks = fixes.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("tick"))
    asks = ticks.withColumn("at", F.lit(float(start)) + F.col("tick") * (speed / fps))
    return snap_at(fixes, asks, key, t).join(asks, [key, "at"])


def shown(df: DataFrame, at: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows whose time window holds the clock; rows without a window always show."""
    return df.where((F.col(lo).isNull() | (F.col(lo) <= at)) & (F.col(hi).isNull() | (F.col(hi) >= at)))
