"""Ground-plane geometry as native columns: homographies, polygons, distances, boxes.

A homography is a struct with fields ``h00 .. h22``. A polygon is ``array<struct<x,y>>``; its closed edge list is
``array<struct<ax,ay,bx,by>>`` and is what the tests and distances read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

H_FIELDS = [f"h{r}{c}" for r in range(3) for c in range(3)]
MIN_W = 1e-9
MIN_DET = 1e-12
ON_EDGE = 1e-9


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once (inside array functions, where columns cannot be staged)."""
    return F.transform(F.array(value), then)[0]


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def valid_detection(x1: Column, y1: Column, x2: Column, y2: Column, conf: Column) -> Column:
    finite = is_finite(x1) & is_finite(y1) & is_finite(x2) & is_finite(y2) & is_finite(conf)
    return finite & (x2 > x1) & (y2 > y1)


def foot_point(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Bottom centre of the box."""
    return F.struct(((x1 + x2) / 2).alias("u"), y2.cast("double").alias("v"))


def foot_point_px(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Bottom centre truncated to whole pixels."""
    return F.struct(((x1 + x2) / 2).cast("bigint").alias("u"), y2.cast("bigint").alias("v"))


def bbox_center(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / 2).alias("u"), ((y1 + y2) / 2).alias("v"))


def bbox_size(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct((x2 - x1).alias("w"), (y2 - y1).alias("h"))


def bbox_to_label(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """Corner box to centre box, normalised by the image size and clamped to [0, 1]."""
    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    return F.struct(
        unit((x + w / 2) / img_w).alias("xc"), unit((y + h / 2) / img_h).alias("yc"),
        unit(w / img_w).alias("w"), unit(h / img_h).alias("h"),
    )


def apply_homography(h: Column, u: Column, v: Column) -> Column:
    """Homogeneous transform of a point; NULL without matrix, for a non-finite point or a vanishing scale."""
    w = h["h20"] * u + h["h21"] * v + h["h22"]
    x = (h["h00"] * u + h["h01"] * v + h["h02"]) / w
    y = (h["h10"] * u + h["h11"] * v + h["h12"]) / w
    usable = h.isNotNull() & is_finite(u) & is_finite(v) & (F.abs(w) >= MIN_W) & is_finite(x) & is_finite(y)
    return F.when(usable, F.struct(x.alias("x"), y.alias("y")))


def invert_homography(h: Column) -> Column:
    """Inverse by cofactors; NULL when the matrix is singular."""
    a, b, c, d, e, f, g, k, i = (h[n] for n in H_FIELDS)
    det = a * (e * i - f * k) - b * (d * i - f * g) + c * (d * k - e * g)
    s = F.lit(1.0) / det
    cells = [
        (e * i - f * k) * s, (c * k - b * i) * s, (b * f - c * e) * s,
        (f * g - d * i) * s, (a * i - c * g) * s, (c * d - a * f) * s,
        (d * k - e * g) * s, (b * g - a * k) * s, (a * e - b * d) * s,
    ]
    return F.when(F.abs(det) >= MIN_DET, F.struct(*[v.alias(n) for v, n in zip(cells, H_FIELDS)]))


def rescale_homography(h: Column, src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> Column:
    """Matrix for pixels of the ``dst`` resolution, normalised so that ``h22`` is 1 where it does not vanish."""
    sx, sy = src_w / dst_w, src_h / dst_h
    scaled = {f"h{r}{c}": h[f"h{r}{c}"] * (sx if c == 0 else sy if c == 1 else F.lit(1.0))
              for r in range(3) for c in range(3)}
    unit = F.when(F.abs(scaled["h22"]) > MIN_W, scaled["h22"]).otherwise(F.lit(1.0))
    usable = (src_w > 0) & (src_h > 0) & (dst_w > 0) & (dst_h > 0)
    return F.when(usable, F.struct(*[(scaled[n] / unit).alias(n) for n in H_FIELDS])).otherwise(h)


def resolution_distance(aw: Column, ah: Column, bw: Column, bh: Column) -> Column:
    usable = (aw > 0) & (ah > 0) & (bw > 0) & (bh > 0)
    return F.when(usable, F.abs(F.ln(aw / bw)) + F.abs(F.ln(ah / bh))).otherwise(F.lit(float("inf")))


def edges_of(polygon: Column) -> Column:
    """Closed edge list of a polygon."""
    def edges(pts: Column) -> Column:
        following = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
        return F.zip_with(pts, following, lambda p, q: F.struct(
            p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))

    return let(polygon, edges)


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return (
        (F.abs(cross) <= ON_EDGE)
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
    )


def _crosses(e: Column, x: Column, y: Column) -> Column:
    at = (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
    return ((e["ay"] > y) != (e["by"] > y)) & (x < at)


def point_in_polygon(edges: Column, x: Column, y: Column) -> Column:
    """Inside or on the border: border test first, then ray-crossing parity."""
    crossings = F.size(F.filter(edges, lambda e: _crosses(e, x, y)))
    return F.exists(edges, lambda e: _on_edge(e, x, y)) | (crossings % 2 == 1)


def distance_to_segment(e: Column, x: Column, y: Column) -> Column:
    """Distance to the closed segment; a degenerate segment is its first point."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    length2 = dx * dx + dy * dy
    along = ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.nullif(length2, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    qx, qy = x - (e["ax"] + t * dx), y - (e["ay"] + t * dy)
    return F.sqrt(qx * qx + qy * qy)


def distance_to_polygon(edges: Column, x: Column, y: Column) -> Column:
    """0 inside, else the distance to the nearest edge; NULL for an empty polygon."""
    nearest = F.array_min(F.transform(edges, lambda e: distance_to_segment(e, x, y)))
    return F.when(point_in_polygon(edges, x, y), F.lit(0.0)).otherwise(nearest)


def rescale_points(polygon: Column, sx: Column, sy: Column) -> Column:
    """Points moved to another resolution and rounded half to even."""
    return F.transform(
        polygon,
        lambda p: F.struct(
            F.bround(p["x"] * sx).cast("bigint").alias("x"), F.bround(p["y"] * sy).cast("bigint").alias("y")
        ),
    )


def project_polygon(h: Column, polygon: Column, digits: int | None = 2) -> Column:
    """Polygon through a homography; points that cannot be projected are dropped."""
    def rounded(q: Column) -> Column:
        if digits is None:
            return q
        return F.when(
            q.isNotNull(), F.struct(F.bround(q["x"], digits).alias("x"), F.bround(q["y"], digits).alias("y"))
        )

    points = F.transform(polygon, lambda p: let(apply_homography(h, p["x"], p["y"]), rounded))
    return F.filter(points, lambda p: p.isNotNull())


def metres_to_plan(x: Column, y: Column, scale: float, ox: float = 0.0, oy: float = 0.0) -> Column:
    """Whole plan pixels of a position in metres (truncated)."""
    return F.struct(
        (F.lit(ox) + x * scale).cast("bigint").alias("px"), (F.lit(oy) + y * scale).cast("bigint").alias("py")
    )


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)
