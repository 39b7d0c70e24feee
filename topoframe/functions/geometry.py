"""Geometry on boxes [x1, y1, x2, y2], points [x, y] and polylines, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col



def _at(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i))


def point(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def box_iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union; 0 unless both have four numbers and the union is positive."""
    a, b = col(a), col(b)
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    inter = side(F.greatest(_at(a, 0), _at(b, 0)), F.least(_at(a, 2), _at(b, 2))) * side(F.greatest(_at(a, 1), _at(b, 1)), F.least(_at(a, 3), _at(b, 3)))
    area = lambda c: side(_at(c, 0), _at(c, 2)) * side(_at(c, 1), _at(c, 3))
    union = area(a) + area(b) - inter
    return F.when((F.size(a) == 4) & (F.size(b) == 4) & (union > 0), inter / union).otherwise(0.0)


def point_box_distance(p: Column | str, box: Column | str) -> Column:
    p, box = col(p), col(box)
    gap = lambda i: F.greatest(_at(box, i) - _at(p, i), F.lit(0.0), _at(p, i) - _at(box, i + 2))
    return F.when(F.size(box) == 4, F.hypot(gap(0), gap(1))).otherwise(float("inf"))


def _distance(a: Column, b: Column) -> Column:
    return F.hypot(_at(a, 0) - _at(b, 0), _at(a, 1) - _at(b, 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def aligned_l2(a: Column | str, b: Column | str, points: int = 5) -> Column:
    return _total(F.zip_with(col(a), col(b), _distance)) / points


def chamfer(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    one = lambda s, t: _total(F.transform(s, lambda p: F.array_min(F.transform(t, lambda q: _distance(p, q))))) / F.size(s)
    return (one(a, b) + one(b, a)) / 2


def path_length(path: Column | str) -> Column:
    p = col(path)
    steps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), _distance)
    return F.when(F.size(p) >= 2, _total(steps)).otherwise(0.0)


def box_center(box: Column | str) -> Column:
    b = col(box)
    mid = lambda i: F.floor((_at(b, i) + _at(b, i + 2)) / 2).cast("int")  # noqa: E731  floor, also below zero
    return F.array(mid(0), mid(1))


def inset_box(box: Column | str, left: float = 0, top: float = 0, right: float = 0, bottom: float = 0) -> Column:
    b = col(box)
    return F.array(_at(b, 0) + left, _at(b, 1) + top, _at(b, 2) - right, _at(b, 3) - bottom)


def midpoint(path: Column | str) -> Column:
    """The middle element of three points or more, else the floored middle of the ends."""
    p = col(path)
    mid = lambda i: F.floor((_at(_at(p, 0), i) + _at(F.element_at(p, -1), i)) / 2)
    return F.when(F.size(p) >= 3, F.element_at(p, F.floor(F.size(p) / 2).cast("int") + 1)).otherwise(F.array(mid(0), mid(1)).cast("array<int>"))


def scale(values: Column | str, factor: float) -> Column:
    """Scaled and rounded half to even."""
    return F.transform(col(values), lambda v: F.bround(v * F.lit(float(factor))).cast("int"))


def translate(box: Column | str, dx: Column | float, dy: Column | float) -> Column:
    return F.transform(col(box), lambda v, i: v + F.when(i % 2 == 0, F.lit(dx)).otherwise(F.lit(dy)))


def translate_path(path: Column | str, dx: Column | float, dy: Column | float) -> Column:
    return F.transform(col(path), lambda p: F.array(_at(p, 0) + dx, _at(p, 1) + dy))


#: Sides in the order that ties are decided.
SIDES = ("left", "right", "top", "bottom")


def side_between(a: Column | str, b: Column | str) -> Column:
    """The side of box a that faces box b: by the dominant axis between the centres."""
    ca, cb = box_center(a), box_center(b)
    dx, dy = _at(cb, 0) - _at(ca, 0), _at(cb, 1) - _at(ca, 1)
    return F.when(F.abs(dx) >= F.abs(dy), F.when(dx >= 0, "right").otherwise("left")).otherwise(F.when(dy >= 0, "bottom").otherwise("top"))


def nearest_side(p: Column | str, box: Column | str) -> Column:
    p, b = col(p), col(box)
    gaps = [F.abs(_at(p, 0) - _at(b, 0)), F.abs(_at(p, 0) - _at(b, 2)), F.abs(_at(p, 1) - _at(b, 1)), F.abs(_at(p, 1) - _at(b, 3))]
    ranked = F.array(*(F.struct(g.cast("double").alias("d"), F.lit(i).alias("i"), F.lit(s).alias("side")) for i, (g, s) in enumerate(zip(gaps, SIDES, strict=True))))
    return F.array_min(ranked)["side"]


def side_anchor(box: Column | str, side: Column | str) -> Column:
    b, s, c = col(box), col(side), box_center(box)
    return F.when(s == "left", F.array(_at(b, 0), _at(c, 1))).when(s == "right", F.array(_at(b, 2), _at(c, 1))).when(s == "top", F.array(_at(c, 0), _at(b, 1))).otherwise(F.array(_at(c, 0), _at(b, 3)))


def boundary_point(box: Column | str, target: Column | str) -> Column:
    """Where the ray from a box's floored centre to a point leaves the box, in whole pixels (halves to even); the centre if it never does."""
    b, t, c = col(box), col(target), box_center(box)
    cx, cy = _at(c, 0).cast("double"), _at(c, 1).cast("double")
    dx, dy = _at(t, 0) - cx, _at(t, 1) - cy
    hits = []
    for i, wall in enumerate((0, 2, 1, 3)):  # of equally early hits the first counts
        upright = i < 2
        s = F.try_divide(_at(b, wall) - (cx if upright else cy), dx if upright else dy)
        other = cy + s * dy if upright else cx + s * dx
        low, high = (1, 3) if upright else (0, 2)
        x, y = (_at(b, wall), other) if upright else (other, _at(b, wall))
        hits.append(F.when((s > 0) & (other >= _at(b, low)) & (other <= _at(b, high)), F.struct(s.alias("s"), F.lit(i).alias("i"), F.bround(x.cast("double")).cast("int").alias("x"), F.bround(y.cast("double")).cast("int").alias("y"))))
    best = F.array_min(F.array(*hits))
    return F.when(best.isNull(), c).otherwise(F.array(best["x"], best["y"]))


def arrowhead(path: Column | str, size: float = 16.0, spread: float = 0.82 * math.pi) -> Column:
    """Three integer points of a head at the end of a path's last segment; none for a path of fewer than two points."""
    p = col(path)
    tip, prev = F.get(p, F.size(p) - 1), F.get(p, F.size(p) - 2)
    angle = F.atan2(_at(tip, 1) - _at(prev, 1), _at(tip, 0) - _at(prev, 0))
    wing = lambda turn: F.array((_at(tip, 0) + size * F.cos(angle + turn)).cast("int"), (_at(tip, 1) + size * F.sin(angle + turn)).cast("int"))
    head = F.array(F.array(_at(tip, 0).cast("int"), _at(tip, 1).cast("int")), wing(spread), wing(-spread))
    return F.when(F.size(p) >= 2, head).otherwise(F.expr("cast(array() as array<array<int>>)"))


def offset_point(a: Column | str, b: Column | str, distance: float) -> Column:
    """Point a moved towards b by a distance (away from it if negative), in whole pixels; a itself where both are one."""
    a, b = col(a), col(b)
    d = _distance(a, b)
    moved = lambda i: F.bround(_at(a, i) + (_at(b, i) - _at(a, i)) / d * distance).cast("int")
    return F.when(d > 0, F.array(moved(0), moved(1))).otherwise(F.transform(a, lambda v: v.cast("int")))


def visible_path(path: Column | str, clearance: float = 12) -> Column:
    """Both ends trimmed by a clearance, the first one first: on a path of two points the last one moves towards the trimmed first."""
    p = col(path)
    n, whole = F.size(p), F.transform(p, lambda q: F.transform(q, lambda v: v.cast("int")))
    first = offset_point(_at(p, 0), _at(p, 1), clearance)
    last = offset_point(F.get(p, n - 1), F.when(n == 2, first.cast("array<double>")).otherwise(F.get(p, n - 2).cast("array<double>")), clearance)
    return F.when(n >= 2, F.concat(F.array(first), F.slice(whole, F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(last))).otherwise(whole)


def boxes_overlap(a: Column | str, b: Column | str, margin: float = 8) -> Column:
    """Whether boxes overlap or come as near as the margin: a gap of exactly the margin is an overlap."""
    a, b = col(a), col(b)
    apart = (_at(a, 2) + margin < _at(b, 0)) | (_at(b, 2) + margin < _at(a, 0)) | (_at(a, 3) + margin < _at(b, 1)) | (_at(b, 3) + margin < _at(a, 1))
    return ~apart


def _turn(p: Column, q: Column, r: Column) -> Column:
    return (_at(q, 0) - _at(p, 0)) * (_at(r, 1) - _at(p, 1)) - (_at(q, 1) - _at(p, 1)) * (_at(r, 0) - _at(p, 0))


def _on(p: Column, q: Column, r: Column) -> Column:
    return (F.least(_at(p, 0), _at(q, 0)) <= _at(r, 0)) & (_at(r, 0) <= F.greatest(_at(p, 0), _at(q, 0))) & (F.least(_at(p, 1), _at(q, 1)) <= _at(r, 1)) & (_at(r, 1) <= F.greatest(_at(p, 1), _at(q, 1)))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    proper = (t1 * t2 < 0) & (t3 * t4 < 0)
    return proper | ((t1 == 0) & _on(a, b, c)) | ((t2 == 0) & _on(a, b, d)) | ((t3 == 0) & _on(c, d, a)) | ((t4 == 0) & _on(c, d, b))


def segment_hits_box(a: Column, b: Column, box: Column | str, inflate: float = 12) -> Column:
    k = col(box)
    x1, y1, x2, y2 = _at(k, 0) - inflate, _at(k, 1) - inflate, _at(k, 2) + inflate, _at(k, 3) + inflate
    inside = lambda p: (x1 <= _at(p, 0)) & (_at(p, 0) <= x2) & (y1 <= _at(p, 1)) & (_at(p, 1) <= y2)
    corner = [F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2)]
    out = inside(a) | inside(b)
    for i in range(4):
        out = out | segments_cross(a, b, corner[i], corner[(i + 1) % 4])
    return out


def path_blocks(path: Column | str, boxes: Column | str, inflate: float = 12) -> Column:
    """Number of (segment, box) hits."""
    p, k = col(path), col(boxes)
    hits = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.size(F.filter(k, lambda b: segment_hits_box(F.get(p, i - 1), F.get(p, i), b, inflate))))
    return F.when(F.size(p) >= 2, F.aggregate(hits, F.lit(0), lambda s, x: s + x)).otherwise(0)


def point_segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = _at(b, 0) - _at(a, 0), _at(b, 1) - _at(a, 1)
    t = F.coalesce(F.try_divide((_at(p, 0) - _at(a, 0)) * dx + (_at(p, 1) - _at(a, 1)) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(_at(p, 0) - (_at(a, 0) + t * dx), _at(p, 1) - (_at(a, 1) + t * dy))


def segment_clear(a: Column, b: Column, boxes: Column | str, margin: float = 6) -> Column:
    """Whether the segment between two centres keeps from every other node's centre by half its longer side and a margin; to touch is to keep.

    boxes: those of the other nodes, the two ends left out.
    """
    reach = lambda k: F.greatest(_at(k, 2) - _at(k, 0), _at(k, 3) - _at(k, 1)) / 2 + margin
    return F.forall(col(boxes), lambda k: point_segment_distance(box_center(k), a, b) >= reach(k))


def best_detour(paths: Column | str, boxes: Column | str) -> Column:
    """Of candidate paths the one with the fewest hits, then the shortest, then the first."""
    scored = F.transform(col(paths), lambda p, i: F.struct(path_blocks(p, boxes).alias("hits"), path_length(p).alias("length"), i.alias("i"), p.alias("path")))
    return F.array_min(scored)["path"]


def detour_candidates(start: Column | str, end: Column | str, boxes: Column | str, near: Column | float, far: Column | float, width: int = 1200, height: int = 800, edge: int = 32, reach: int = 40) -> Column:
    """Two paths of four points around the boxes between two points, beside the dominant axis: by ``near`` before the least and by ``far`` behind the greatest side, inside the canvas."""
    s, e, k = col(start), col(end), col(boxes)
    flat = F.abs(_at(e, 0) - _at(s, 0)) >= F.abs(_at(e, 1) - _at(s, 1))

    def around(along: int, across: int, size: int) -> Column:
        low, high = F.least(_at(s, along), _at(e, along)) - reach, F.greatest(_at(s, along), _at(e, along)) + reach
        met = F.filter(k, lambda b: (_at(box_center(b), along) >= low) & (_at(box_center(b), along) <= high))
        ends = F.array(_at(s, across).cast("double"), _at(e, across).cast("double"))
        least = F.array_min(F.concat(F.transform(met, lambda b: _at(b, across).cast("double")), ends))
        most = F.array_max(F.concat(F.transform(met, lambda b: _at(b, across + 2).cast("double")), ends))
        pair = (lambda a, c: point(a, c)) if along == 0 else (lambda a, c: point(c, a))
        bent = lambda at: F.array(point(_at(s, 0), _at(s, 1)), pair(_at(s, along), at), pair(_at(e, along), at), point(_at(e, 0), _at(e, 1)))
        return F.array(bent(F.greatest(F.lit(float(edge)), least - near)), bent(F.least(F.lit(float(size - edge)), most + far)))

    return F.when(flat, around(0, 1, height)).otherwise(around(1, 0, width))


def long_same_lane(a: Column | str, b: Column | str, beside: float = 72, apart: float = 220) -> Column:
    """Whether two centres lie in one row or column and far from each other."""
    a, b = col(a), col(b)
    dx, dy = F.abs(_at(b, 0) - _at(a, 0)), F.abs(_at(b, 1) - _at(a, 1))
    return ((dy <= beside) & (dx >= apart)) | ((dx <= beside) & (dy >= apart))


def orient(p: Column | str, orientation: Column | str, width: int, height: int) -> Column:
    """A left-to-right layout point on a canvas of another orientation; truncated to integers."""
    p, o = col(p), col(orientation)
    x, y = _at(p, 0), _at(p, 1)
    as_int = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    return F.when(o == "right_to_left", as_int(width - x, y)).when(o == "top_to_bottom", as_int(y * (width / height), x * (height / width))).when(o == "bottom_to_top", as_int(y * (width / height), height - x * (height / width))).otherwise(as_int(x, y))
