"""Planar hexagonal cells on projected metres (pointy-top, axial coordinates).

Positions are SQL text, cells are Columns of ``struct<q: bigint, r: bigint>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapulse.functions.geometry import expression, let, num

# Mean cell areas in m2 of the grains used, and the edge each one implies.
GRAIN_AREA_M2 = {7: 5.0e6, 8: 0.7e6, 9: 0.1e6}
JOIN_GRAIN = 9
MAP_GRAIN = 8
SQRT3 = math.sqrt(3.0)


def edge_of(grain: int) -> float:
    """Hexagon edge in metres for a grain: area = 3*sqrt(3)/2 * edge^2, rounded to the metre."""
    return float(round(math.sqrt(GRAIN_AREA_M2[grain] * 2.0 / (3.0 * SQRT3))))


@expression
def cell_of(x: str, y: str, edge: float) -> str:
    """Cell holding (x, y).

    Cube rounding: each of the three cube coordinates is rounded, and the one rounded furthest is
    rebuilt from the other two.
    """
    axial = (
        f"named_struct('q', (({x}) * {num(SQRT3 / 3.0)} - ({y}) / 3D) / {num(edge)}, "
        f"'r', ({y}) * {num(2.0 / 3.0)} / {num(edge)})"
    )
    near = (
        "named_struct('q', floor(c_hx.q + 0.5D), 'r', floor(c_hx.r + 0.5D), "
        "'s', floor(-c_hx.q - c_hx.r + 0.5D))"
    )
    off = (
        "named_struct('q', abs(n_hx.q - c_hx.q), 'r', abs(n_hx.r - c_hx.r), "
        "'s', abs(n_hx.s - (-c_hx.q - c_hx.r)))"
    )
    worst_q = "d_hx.q > d_hx.r AND d_hx.q > d_hx.s"
    repaired = (
        f"named_struct('q', CASE WHEN {worst_q} THEN -n_hx.r - n_hx.s ELSE n_hx.q END, "
        f"'r', CASE WHEN NOT ({worst_q}) AND d_hx.r > d_hx.s THEN -n_hx.q - n_hx.s ELSE n_hx.r END)"
    )
    return let("c_hx", axial, let("n_hx", near, let("d_hx", off, repaired)))


def cell_distance(a: Column, b: Column) -> Column:
    dq = a.getField("q") - b.getField("q")
    dr = a.getField("r") - b.getField("r")
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def cell_center(cell: Column, edge: float) -> tuple[Column, Column]:
    q, r = cell.getField("q").cast("double"), cell.getField("r").cast("double")
    return (
        F.lit(edge * SQRT3) * (q + r / F.lit(2.0)),
        F.lit(edge * 1.5) * r,
    )


@expression
def cell_boundary(cell: str, edge: float) -> str:
    """Closed ring of the cell, counter-clockwise."""
    corners = [math.radians(60.0 * (i % 6) - 30.0) for i in range(7)]
    points = [
        f"named_struct('x', p_cb.x + {num(edge * math.cos(a))}, 'y', p_cb.y + {num(edge * math.sin(a))})"
        for a in corners
    ]
    middle = (
        f"named_struct('x', {num(edge * SQRT3)} * (double(k_cb.q) + double(k_cb.r) / 2D), "
        f"'y', {num(edge * 1.5)} * double(k_cb.r))"
    )
    return let("k_cb", cell, let("p_cb", middle, f"array({', '.join(points)})"))


@expression
def disk(cell: str, k: int) -> str:
    """Array of the cells within ``k`` steps of ``cell``."""
    steps = ", ".join(
        f"named_struct('q', {dq}, 'r', {dr})"
        for dq in range(-k, k + 1)
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)
    )
    moved = "named_struct('q', k_di.q + o_di.q, 'r', k_di.r + o_di.r)"
    return let("k_di", cell, f"transform(array({steps}), o_di -> {moved})")


def inner_radius(k: int, edge: float) -> float:
    """Any point this near to some point of a cell lies in the cell's ``k``-disk."""
    return (1.5 * k - 0.5) * edge
