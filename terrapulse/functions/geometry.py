"""Geometry expressions over an edge array.

A polygon, multi-part polygon or line is one column ``array<struct<x1,y1,x2,y2>>``: every segment
of every ring, outer rings counter-clockwise and holes clockwise. The expressions are pure
functions of such columns, so measuring a feature never explodes or shuffles it.

Arguments are SQL text (a column name or an expression) and the result is a Column; ``f.sql`` gives
the text itself for use inside another expression. Each function names its own lambda variables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
ON_LINE = 1e-7
EDGES_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def expression(fn: Callable[..., str]) -> Callable[..., Column]:
    """Turn a function returning SQL text into one returning a Column; the text stays as ``.sql``."""

    @wraps(fn)
    def column(*args, **kwargs) -> Column:
        return F.expr(fn(*args, **kwargs))

    column.sql = fn
    return column


def let(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def num(value: float) -> str:
    """SQL double literal."""
    return f"{float(value)!r}D"


def _segment(x1: str, y1: str, x2: str, y2: str) -> str:
    return (
        f"named_struct('x1', double({x1}), 'y1', double({y1}), "
        f"'x2', double({x2}), 'y2', double({y2}))"
    )


segment = expression(_segment)


@expression
def ring_edges(ring: str) -> str:
    """Edge array of one path given as ``array<struct<x,y>>``."""
    here, there = f"get({ring}, i_re - 1)", f"get({ring}, i_re)"
    edge = _segment(f"{here}.x", f"{here}.y", f"{there}.x", f"{there}.y")
    return (
        f"CASE WHEN size({ring}) >= 2 THEN transform(sequence(1, size({ring}) - 1), i_re -> {edge}) "
        f"ELSE cast(array() AS {EDGES_TYPE}) END"
    )


@expression
def rings_edges(rings: str) -> str:
    """Edge array of ``array<array<struct<x,y>>>``."""
    return f"flatten(transform({rings}, g_rs -> {ring_edges.sql('g_rs')}))"


@expression
def line_edges(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"array({_segment(x1, y1, x2, y2)})"


@expression
def box_edges(minx: str, miny: str, maxx: str, maxy: str) -> str:
    """Counter-clockwise edges of an axis-aligned box."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return f"array({', '.join(_segment(*a, *b) for a, b in zip(corners, corners[1:]))})"


def _turn(e: str, o: str) -> str:
    """Shoelace term of edge ``e`` around ``o.x1, o.y1``, which keeps large coordinates precise."""
    return (
        f"({e}.x1 - {o}.x1) * ({e}.y2 - {o}.y1) - ({e}.x2 - {o}.x1) * ({e}.y1 - {o}.y1)"
    )


@expression
def signed_area(edges: str) -> str:
    total = f"aggregate({edges}, 0D, (acc_sa, e_sa) -> acc_sa + {_turn('e_sa', 'o_sa')})"
    return f"{let('o_sa', f'element_at({edges}, 1)', total)} / 2D"


@expression
def area(edges: str) -> str:
    return f"abs({signed_area.sql(edges)})"


@expression
def length(edges: str) -> str:
    return (
        f"aggregate({edges}, 0D, (acc_le, e_le) -> "
        "acc_le + hypot(e_le.x2 - e_le.x1, e_le.y2 - e_le.y1))"
    )


def bounds_sql(edges: str) -> dict[str, str]:
    return {
        f"{side}{axis}": (
            f"array_{side}(transform({edges}, e_bo -> {pick}(e_bo.{axis}1, e_bo.{axis}2)))"
        )
        for side, pick in (("min", "least"), ("max", "greatest"))
        for axis in "xy"
    }


def bounds(edges: str) -> dict[str, Column]:
    return {k: F.expr(v) for k, v in bounds_sql(edges).items()}


@expression
def center(edges: str) -> str:
    """Area centroid as ``struct<x,y>`` (shoelace weights around the first vertex)."""
    step = let(
        "c_ce",
        _turn("e_ce", "o_ce"),
        "named_struct('a', acc_ce.a + c_ce, "
        "'x', acc_ce.x + (e_ce.x1 - o_ce.x1 + e_ce.x2 - o_ce.x1) * c_ce, "
        "'y', acc_ce.y + (e_ce.y1 - o_ce.y1 + e_ce.y2 - o_ce.y1) * c_ce)",
    )
    done = (
        "named_struct('x', o_ce.x1 + t_ce.x / nullif(3D * t_ce.a, 0D), "
        "'y', o_ce.y1 + t_ce.y / nullif(3D * t_ce.a, 0D))"
    )
    folded = (
        f"aggregate({edges}, named_struct('a', 0D, 'x', 0D, 'y', 0D), "
        f"(acc_ce, e_ce) -> {step}, t_ce -> {done})"
    )
    return let("o_ce", f"element_at({edges}, 1)", folded)


def centroid(edges: str) -> tuple[Column, Column]:
    c = center(edges)
    return c.getField("x"), c.getField("y")


@expression
def contains_point(edges: str, x: str, y: str) -> str:
    """Crossing parity of a ray to the right of the point."""
    crossed = (
        f"CASE WHEN (e_cp.y1 > {y}) != (e_cp.y2 > {y}) AND {x} < e_cp.x1 + ({y} - e_cp.y1) "
        "* (e_cp.x2 - e_cp.x1) / nullif(e_cp.y2 - e_cp.y1, 0D) THEN 1 ELSE 0 END"
    )
    return f"(aggregate({edges}, 0, (acc_cp, e_cp) -> acc_cp + {crossed}) % 2 = 1)"


def _point_segment(e: str, x: str, y: str) -> str:
    """Distance of a point to an edge; greatest/least skip the NULL of a degenerate edge."""
    vectors = (
        f"named_struct('dx', {e}.x2 - {e}.x1, 'dy', {e}.y2 - {e}.y1, "
        f"'wx', {x} - {e}.x1, 'wy', {y} - {e}.y1)"
    )
    t = (
        "least(greatest((v_ps.wx * v_ps.dx + v_ps.wy * v_ps.dy) "
        "/ nullif(v_ps.dx * v_ps.dx + v_ps.dy * v_ps.dy, 0D), 0D), 1D)"
    )
    reach = "hypot(v_ps.wx - t_ps * v_ps.dx, v_ps.wy - t_ps * v_ps.dy)"
    return let("v_ps", vectors, let("t_ps", t, reach))


@expression
def outline_distance(edges: str, x: str, y: str) -> str:
    return f"array_min(transform({edges}, e_od -> {_point_segment('e_od', x, y)}))"


@expression
def point_distance(edges: str, x: str, y: str) -> str:
    """Distance from a polygon to a point, 0 inside."""
    inside = contains_point.sql(edges, x, y)
    return f"CASE WHEN {inside} THEN 0D ELSE {outline_distance.sql(edges, x, y)} END"


def _side(line: str, x: str, y: str) -> str:
    """Sign of the side of ``line`` the point lies on."""
    return (
        f"signum(({line}.x2 - {line}.x1) * ({y} - {line}.y1) "
        f"- ({line}.y2 - {line}.y1) * ({x} - {line}.x1))"
    )


def _sides(line: str, other: str) -> str:
    """-1 when the ends of ``other`` lie on both sides of ``line``, 0 when one lies on it."""
    return (
        f"{_side(line, f'{other}.x1', f'{other}.y1')} * {_side(line, f'{other}.x2', f'{other}.y2')}"
    )


def _cross_properly(a: str, b: str) -> str:
    """The two segments cross at a point interior to both."""
    return f"({_sides(b, a)} < 0 AND {_sides(a, b)} < 0)"


def _meet(a: str, b: str) -> str:
    """The two segments share a point, touching included."""
    boxes = " AND ".join(
        f"least({p}.{k}1, {p}.{k}2) <= greatest({q}.{k}1, {q}.{k}2)"
        for k in "xy"
        for p, q in ((a, b), (b, a))
    )
    return f"({boxes} AND {_sides(b, a)} <= 0 AND {_sides(a, b)} <= 0)"


def _segment_distance(a: str, b: str) -> str:
    ends = [
        _point_segment(line, f"{p}.x{i}", f"{p}.y{i}")
        for line, p in ((b, a), (a, b))
        for i in (1, 2)
    ]
    return f"CASE WHEN {_cross_properly(a, b)} THEN 0D ELSE least({', '.join(ends)}) END"


@expression
def outlines_distance(a: str, b: str) -> str:
    inner = f"array_min(transform({b}, f_ld -> {_segment_distance('e_ld', 'f_ld')}))"
    return f"array_min(transform({a}, e_ld -> {inner}))"


def _holds_start(polygon: str, other: str) -> str:
    """The first vertex of ``other`` lies inside; an open line has no inside."""
    head = f"element_at({other}, 1)"
    sums = " AND ".join(f"abs(aggregate({polygon}, 0D, (s_hs, e_hs) -> s_hs + e_hs.{k}2 - e_hs.{k}1)) < 1e-6D" for k in "xy")
    return f"({contains_point.sql(polygon, f'{head}.x1', f'{head}.y1')} AND {sums})"


@expression
def distance(a: str, b: str, a_filled: bool = True, b_filled: bool = True) -> str:
    """Distance between two features; a filled (polygon) side absorbs what lies inside it."""
    absorbed = [_holds_start(b, a)] * b_filled + [_holds_start(a, b)] * a_filled
    apart = outlines_distance.sql(a, b)
    return f"CASE WHEN {' OR '.join(absorbed)} THEN 0D ELSE {apart} END" if absorbed else apart


@expression
def intersects(a: str, b: str, a_filled: bool = True, b_filled: bool = True) -> str:
    """The features share at least one point: outlines meet, or one lies inside the other."""
    met = f"exists({a}, e_in -> exists({b}, f_in -> {_meet('e_in', 'f_in')}))"
    absorbed = [_holds_start(b, a)] * b_filled + [_holds_start(a, b)] * a_filled
    return f"({' OR '.join([met, *absorbed])})"


@expression
def is_valid(ring: str) -> str:
    """Closed, at least four vertices, positive area, no edge crossing another."""
    simple = f"NOT exists(r_va, e_va -> exists(r_va, f_va -> {_cross_properly('e_va', 'f_va')}))"
    sound = let("r_va", ring_edges.sql("g_va"), f"{area.sql('r_va')} > 0 AND {simple}")
    closed = "element_at(g_va, 1) = element_at(g_va, -1)"
    return let("g_va", ring, f"CASE WHEN size(g_va) >= 4 THEN {closed} AND {sound} ELSE false END")


@expression
def drop_z(coordinates: str) -> str:
    """``array<array<double>>`` positions of any arity to ``array<struct<x,y>>``."""
    return f"transform({coordinates}, c_dz -> named_struct('x', c_dz[0], 'y', c_dz[1]))"


def _crossing_params(edge: str, others: str) -> str:
    """Parameters in (0,1) at which ``edge`` crosses an edge of ``others``.

    A parallel edge has no crossing; it gives the parameter abreast of its start, so that a shared
    stretch begins and ends at a cut (its end is the start of the next edge).
    """
    vectors = (
        f"named_struct('ex', {edge}.x2 - {edge}.x1, 'ey', {edge}.y2 - {edge}.y1, "
        "'fx', f_cr.x2 - f_cr.x1, 'fy', f_cr.y2 - f_cr.y1, "
        f"'wx', f_cr.x1 - {edge}.x1, 'wy', f_cr.y1 - {edge}.y1)"
    )
    met = let(
        "d_cr",
        "v_cr.ex * v_cr.fy - v_cr.ey * v_cr.fx",
        "CASE WHEN abs(d_cr) < 1e-12D THEN (v_cr.wx * v_cr.ex + v_cr.wy * v_cr.ey) "
        "/ nullif(v_cr.ex * v_cr.ex + v_cr.ey * v_cr.ey, 0D) "
        f"WHEN (v_cr.wx * v_cr.ey - v_cr.wy * v_cr.ex) / d_cr BETWEEN {num(-EPS)} AND {num(1 + EPS)} "
        "THEN (v_cr.wx * v_cr.fy - v_cr.wy * v_cr.fx) / d_cr END",
    )
    found = f"transform({others}, f_cr -> {let('v_cr', vectors, met)})"
    return f"filter({found}, t_cr -> t_cr > {num(EPS)} AND t_cr < {num(1 - EPS)})"


def _touches(f: str, x: str, y: str) -> str:
    """The point lies on the edge, within a tolerance; most edges fail the first, cheap, test."""
    return (
        f"(abs(({f}.x2 - {f}.x1) * ({y} - {f}.y1) - ({f}.y2 - {f}.y1) * ({x} - {f}.x1)) "
        f"<= {num(ON_LINE)} * (abs({f}.x2 - {f}.x1) + abs({f}.y2 - {f}.y1)) "
        f"AND {x} BETWEEN least({f}.x1, {f}.x2) - {num(ON_LINE)} "
        f"AND greatest({f}.x1, {f}.x2) + {num(ON_LINE)} "
        f"AND {y} BETWEEN least({f}.y1, {f}.y2) - {num(ON_LINE)} "
        f"AND greatest({f}.y1, {f}.y2) + {num(ON_LINE)})"
    )


@expression
def inside_spans(edge: str, polygon: str, shared: str = "none") -> str:
    """Parts of ``edge`` inside ``polygon`` as ``array<struct<t0,t1>>``.

    A part running along the polygon's outline is kept according to ``shared``: ``none`` drops it,
    ``same`` / ``opposite`` keep it when both outlines run the same / opposite way, ``any`` always.
    """
    way = (
        "aggregate(n_is, 0D, (acc_is, f_is) -> acc_is + signum("
        f"({edge}.x2 - {edge}.x1) * (f_is.x2 - f_is.x1) "
        f"+ ({edge}.y2 - {edge}.y1) * (f_is.y2 - f_is.y1)))"
    )
    on_line = {
        "none": "false", "same": f"{way} > 0", "opposite": f"{way} < 0", "any": "true",
    }[shared]
    touched = f"filter({polygon}, g_is -> {_touches('g_is', 'm_is.x', 'm_is.y')})"
    judged = let(
        "n_is",
        touched,
        f"CASE WHEN size(n_is) > 0 THEN {on_line} "
        f"ELSE {contains_point.sql(polygon, 'm_is.x', 'm_is.y')} END",
    )
    at = "(p_is.t0 + p_is.t1) / 2D"
    middle = (
        f"named_struct('x', {edge}.x1 + {at} * ({edge}.x2 - {edge}.x1), "
        f"'y', {edge}.y1 + {at} * ({edge}.y2 - {edge}.y1))"
    )
    cuts = (
        "array_sort(array_distinct(concat(array(0D, 1D), "
        f"{_crossing_params(edge, polygon)})))"
    )
    pieces = let(
        "c_is",
        cuts,
        "transform(sequence(1, size(c_is) - 1), i_is -> "
        "named_struct('t0', c_is[i_is - 1], 't1', c_is[i_is]))",
    )
    return f"filter({pieces}, p_is -> {let('m_is', middle, judged)})"


@expression
def cut(edge: str, span: str) -> str:
    """The stretch ``span`` (``t0``, ``t1``) of an edge as a segment."""

    def at(axis: str, t: str) -> str:
        return f"{edge}.{axis}1 + {span}.{t} * ({edge}.{axis}2 - {edge}.{axis}1)"

    return _segment(at("x", "t0"), at("y", "t0"), at("x", "t1"), at("y", "t1"))


@expression
def parts_inside(edges: str, polygon: str, shared: str = "none") -> str:
    """Edge array of the stretches of ``edges`` inside ``polygon``."""
    spans = inside_spans.sql("e_pi", polygon, shared)
    return f"flatten(transform({edges}, e_pi -> transform({spans}, s_pi -> {cut.sql('e_pi', 's_pi')})))"


@expression
def overlap(a: str, b: str) -> str:
    """Edge array of the intersection of two counter-clockwise polygons (empty when apart).

    When the outlines do not meet, it is the inner polygon. Else its outline is made of the parts of
    each outline inside the other polygon; a shared stretch is taken once, from ``a``, when both run
    the same way.
    """
    met = f"exists({a}, e_ov -> exists({b}, f_ov -> {_meet('e_ov', 'f_ov')}))"
    parts = f"concat({parts_inside.sql(a, b, 'same')}, {parts_inside.sql(b, a, 'none')})"
    return (
        f"CASE WHEN {met} THEN {parts} WHEN {_holds_start(a, b)} THEN {b} "
        f"WHEN {_holds_start(b, a)} THEN {a} ELSE cast(array() AS {EDGES_TYPE}) END"
    )


@expression
def clipped(a: str, area: str) -> str:
    """Edge array of ``a``, polygon or line, inside a polygon; the edges of a polygon are not in order.

    Right for holes on either side: a ring that lies inside the other outline as a whole is kept as one.
    """
    sums = " AND ".join(f"abs(aggregate({a}, 0D, (s_cl, e_cl) -> s_cl + e_cl.{k}2 - e_cl.{k}1)) < 1e-6D" for k in "xy")
    rim = f"CASE WHEN {sums} THEN {parts_inside.sql(area, a, 'none')} ELSE cast(array() AS {EDGES_TYPE}) END"
    return f"concat({parts_inside.sql(a, area, 'same')}, {rim})"


@expression
def footprint_area(common: str) -> str:
    """Area of an outline made by ``overlap``, 0 when empty."""
    return f"CASE WHEN size({common}) = 0 THEN 0D ELSE greatest({signed_area.sql(common)}, 0D) END"


@expression
def overlap_area(a: str, b: str) -> str:
    """Area of the intersection of two counter-clockwise polygons (Green's theorem)."""
    return let("c_oa", overlap.sql(a, b), footprint_area.sql("c_oa"))


@expression
def scan_hits(edges: str, y: str) -> str:
    """Sorted abscissas where the horizontal line at ``y`` crosses the outline."""
    hit = (
        f"CASE WHEN (e_sh.y1 > {y}) != (e_sh.y2 > {y}) THEN e_sh.x1 + ({y} - e_sh.y1) "
        "* (e_sh.x2 - e_sh.x1) / nullif(e_sh.y2 - e_sh.y1, 0D) END"
    )
    return f"array_sort(filter(transform({edges}, e_sh -> {hit}), h_sh -> h_sh IS NOT NULL))"


@expression
def span_pairs(xs: str) -> str:
    """Consecutive pairs of a sorted array of even size as ``array<struct<a,b>>``."""
    pairs = (
        "CASE WHEN size(x_sp) >= 2 THEN transform(sequence(1, size(x_sp) div 2), i_sp -> "
        "named_struct('a', x_sp[int(i_sp * 2 - 2)], 'b', x_sp[int(i_sp * 2 - 1)])) "
        "ELSE cast(array() AS array<struct<a:double,b:double>>) END"
    )
    return let("x_sp", xs, pairs)


@expression
def representative_x(edges: str, c: str) -> str:
    spans = (
        f"transform({span_pairs.sql(scan_hits.sql(edges, f'{c}.y'))}, s_rp -> "
        "named_struct('width', s_rp.b - s_rp.a, 'mid', (s_rp.a + s_rp.b) / 2D))"
    )
    inside = contains_point.sql(edges, f"{c}.x", f"{c}.y")
    return f"CASE WHEN {inside} THEN {c}.x ELSE coalesce(array_max({spans}).mid, {c}.x) END"


def representative_point(edges: str) -> tuple[Column, Column]:
    """The centroid when inside, else the middle of the widest interior span on its scan-line."""
    x = let("c_rp", center.sql(edges), representative_x.sql(edges, "c_rp"))
    return F.expr(x), center(edges).getField("y")


@expression
def near_reach(y: str, obstacle: str, radius: float) -> str:
    """``a, b``: the one interval of the horizontal line at ``y`` within ``radius`` of the segment ``obstacle`` (NULLs if none).

    As ``near_span``, for lines parallel to the axis, where the parts in the end discs and in the slab are short terms.
    """
    r, e = num(radius), obstacle
    fx, fy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"

    def disc(end: int, sign: str) -> str:
        off = f"({y} - {e}.y{end})"
        return f"CASE WHEN abs({off}) <= {r} THEN {e}.x{end} {sign} sqrt({r} * {r} - {off} * {off}) END"

    upright = f"{y} BETWEEN least({e}.y1, {e}.y2) AND greatest({e}.y1, {e}.y2)"
    # Where the line is beside the segment, and where it is in the strip along it.
    begin = f"({e}.x1 - ({y} - {e}.y1) * {fy} / {fx})"
    end = f"({begin} + ({fx} + {fy} * {fy} / {fx}))"
    middle, half = f"({e}.x1 + {fx} * ({y} - {e}.y1) / {fy})", f"({r} * sqrt({fx} * {fx} + {fy} * {fy}) / abs({fy}))"
    low, high = f"greatest({middle} - {half}, least({begin}, {end}))", f"least({middle} + {half}, greatest({begin}, {end}))"

    def slab(own: str, upright_end: str) -> str:
        # Of a segment parallel to the line the discs give the ends of the interval.
        return f"CASE WHEN {fy} = 0 THEN NULL WHEN {fx} = 0 THEN CASE WHEN {upright} THEN {upright_end} END WHEN {low} <= {high} THEN {own} END"

    return (
        f"named_struct('a', least({disc(1, '-')}, {disc(2, '-')}, {slab(low, f'{e}.x1 - {r}')}), "
        f"'b', greatest({disc(1, '+')}, {disc(2, '+')}, {slab(high, f'{e}.x1 + {r}')}))"
    )


@expression
def near_span(edge: str, obstacle: str, radius: float) -> str:
    """The one interval of ``edge`` within ``radius`` of the segment ``obstacle`` (NULL if none).

    The points within ``radius`` of a segment form a convex set, so a line meets it in a single
    interval: the hull of its parts in the two end discs and in the slab between them.
    """
    r = num(radius)
    vectors = (
        f"named_struct('ex', {edge}.x2 - {edge}.x1, 'ey', {edge}.y2 - {edge}.y1, "
        f"'fx', {obstacle}.x2 - {obstacle}.x1, 'fy', {obstacle}.y2 - {obstacle}.y1, "
        f"'wx', {edge}.x1 - {obstacle}.x1, 'wy', {edge}.y1 - {obstacle}.y1)"
    )
    sizes = (
        "named_struct('ee', nullif(v_ns.ex * v_ns.ex + v_ns.ey * v_ns.ey, 0D), "
        "'ff', nullif(v_ns.fx * v_ns.fx + v_ns.fy * v_ns.fy, 0D))"
    )

    def interval(lo: str, hi: str) -> str:
        return f"named_struct('lo', {lo}, 'hi', {hi})"

    def disc(wx: str, wy: str) -> str:
        """Interval in the disc around the point at offset (wx, wy) from the edge start."""
        cross = f"(({wx}) * v_ns.ey - ({wy}) * v_ns.ex)"
        parts = (
            f"named_struct('m', (({wx}) * v_ns.ex + ({wy}) * v_ns.ey) / l_ns.ee, "
            f"'h', ({r} * {r} - {cross} * {cross} / l_ns.ee) / l_ns.ee)"
        )
        found = interval("d_ns.m - sqrt(d_ns.h)", "d_ns.m + sqrt(d_ns.h)")
        return let("d_ns", parts, f"CASE WHEN d_ns.h >= 0 THEN {found} END")

    def strip(at0: str, slope: str, lo: str, hi: str) -> str:
        """Interval with lo <= at0 + slope * t <= hi; the whole edge when the slope is 0."""
        ends = f"named_struct('a', ({lo} - k_ns.a) / k_ns.s, 'b', ({hi} - k_ns.a) / k_ns.s)"
        sloped = let("j_ns", ends, interval("least(j_ns.a, j_ns.b)", "greatest(j_ns.a, j_ns.b)"))
        flat = f"CASE WHEN k_ns.a BETWEEN {lo} AND {hi} THEN {interval('0D', '1D')} END"
        return let(
            "k_ns",
            f"named_struct('a', {at0}, 's', {slope})",
            f"CASE WHEN k_ns.s = 0 THEN {flat} ELSE {sloped} END",
        )

    along = strip(
        "(v_ns.wx * v_ns.fx + v_ns.wy * v_ns.fy) / l_ns.ff",
        "(v_ns.ex * v_ns.fx + v_ns.ey * v_ns.fy) / l_ns.ff", "0D", "1D",
    )
    across = strip(
        "(v_ns.wx * v_ns.fy - v_ns.wy * v_ns.fx) / sqrt(l_ns.ff)",
        "(v_ns.ex * v_ns.fy - v_ns.ey * v_ns.fx) / sqrt(l_ns.ff)", f"-{r}", r,
    )
    common = interval("greatest(b_ns.p.lo, b_ns.q.lo)", "least(b_ns.p.hi, b_ns.q.hi)")
    slab = let(
        "b_ns",
        f"named_struct('p', {along}, 'q', {across})",
        f"CASE WHEN b_ns.p IS NOT NULL AND b_ns.q IS NOT NULL THEN {common} END",
    )
    candidates = (
        f"array({disc('-v_ns.wx', '-v_ns.wy')}, {disc('v_ns.fx - v_ns.wx', 'v_ns.fy - v_ns.wy')}, "
        f"CASE WHEN l_ns.ff > 0 THEN {slab} END)"
    )
    kept = f"filter({candidates}, i_ns -> i_ns IS NOT NULL AND i_ns.lo <= i_ns.hi)"
    hull = (
        "named_struct('t0', greatest(array_min(transform(h_ns, x_ns -> x_ns.lo)), 0D), "
        "'t1', least(array_max(transform(h_ns, x_ns -> x_ns.hi)), 1D))"
    )
    clipped = let("h_ns", kept, f"CASE WHEN size(h_ns) > 0 THEN {hull} END")
    whole = let("v_ns", vectors, let("l_ns", sizes, clipped))
    # Most pairs are out of reach already by their boxes.
    apart = " OR ".join(
        f"least({p}.{k}1, {p}.{k}2) - {r} > greatest({q}.{k}1, {q}.{k}2)"
        for k in "yx"
        for p, q in ((edge, obstacle), (obstacle, edge))
    )
    spanned = let("s_ns", whole, "CASE WHEN s_ns.t1 > s_ns.t0 THEN s_ns END")
    return f"CASE WHEN NOT ({apart}) THEN {spanned} END"
