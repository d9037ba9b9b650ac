"""Geometry in and out: WKB and WKT to the edge array and back.

Reading drops Z and M, turns outer rings counter-clockwise and holes clockwise, whatever the file holds. A point is one
edge without length. Writing walks the edges to rings and paths again, also when they don't lie in order, puts every
hole into the smallest ring around it, and writes the simplest type that holds them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapulse.functions import geometry as G

Position = tuple[float, float]
Ring = list[Position]

# Type numbers of the format.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)

_EDGES = pa.list_(pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")]))


def turn(ring: Ring) -> float:
    """Twice the signed area, around the first position."""
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:], strict=False))


def read_wkb(data: bytes) -> list[Ring]:
    """The paths of a geometry: outer rings counter-clockwise, holes clockwise, lines as they run, points of one position."""
    at, out = 0, []

    def take(order: str, kind: str) -> tuple:
        nonlocal at
        at += struct.calcsize(kind)
        return struct.unpack_from(order + kind, data, at - struct.calcsize(kind))

    def path(order: str, count: int, size: int) -> Ring:
        values = take(order, f"{count * size}d")
        return list(zip(values[::size], values[1::size], strict=True))

    def one() -> None:
        order = "<" if take("<", "B")[0] else ">"
        (number,) = take(order, "I")
        plain = number & 0x0FFFFFFF
        size = 2 + bool(number & 0x80000000 or plain // 1000 in (1, 3)) + bool(number & 0x40000000 or plain // 1000 in (2, 3))
        if number & 0x20000000:
            take(order, "I")  # the reference system
        kind = plain % 1000
        if kind == POINT:
            spot = path(order, 1, size)
            out.extend([spot] if spot[0] == spot[0] and spot[0][0] == spot[0][0] else [])
        elif kind == LINE:
            out.append(path(order, take(order, "I")[0], size))
        elif kind == POLYGON:
            for number in range(take(order, "I")[0]):
                ring = path(order, take(order, "I")[0], size)
                if ring and (turn(ring) < 0) == (number == 0):
                    ring.reverse()
                out.append(ring)
        elif kind in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION):
            for _ in range(take(order, "I")[0]):
                one()
        else:
            raise ValueError(f"geometry type {kind} has curves or surfaces, which edges can't hold")

    one()
    return [p for p in out if p]


def edges_of(paths: list[Ring]) -> list[dict[str, float]]:
    pairs = [(a, b) for p in paths for a, b in (zip(p, p[1:], strict=False) if len(p) > 1 else [(p[0], p[0])])]
    return [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for a, b in pairs]


def walk(edges: list[dict[str, float]]) -> list[Ring]:
    """Paths that use every edge once: the next edge begins where one ends, the one after it in the array by preference."""
    starts: dict[Position, list[int]] = {}
    ends: dict[Position, int] = {}
    for i, e in enumerate(edges):
        starts.setdefault((e["x1"], e["y1"]), []).append(i)
        ends[e["x2"], e["y2"]] = ends.get((e["x2"], e["y2"]), 0) + 1
    used, out = [False] * len(edges), []
    # Open paths first, from where more edges begin than end; what is left are rings.
    firsts = [i for p, own in starts.items() for i in own[: max(0, len(own) - ends.get(p, 0))]]
    for first in [*firsts, *range(len(edges))]:
        if used[first]:
            continue
        at, path = first, [(edges[first]["x1"], edges[first]["y1"])]
        while at is not None:
            used[at] = True
            path.append((edges[at]["x2"], edges[at]["y2"]))
            after = [i for i in starts.get(path[-1], []) if not used[i]]
            if path[-1] == path[0]:
                break
            at = at + 1 if at + 1 in after else (after[0] if after else None)
        out.append(path)
    return out


def holds(ring: Ring, x: float, y: float) -> bool:
    crossed = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:], strict=False))
    return crossed % 2 == 1


def shapes(edges: list[dict[str, float]]) -> tuple[list[Position], list[Ring], list[list[Ring]]]:
    """Points, open lines and polygons (outer ring and holes)."""
    paths = walk(edges)
    points = [p[0] for p in paths if len(p) == 2 and p[0] == p[1]]
    rings = [p for p in paths if len(p) > 3 and p[0] == p[-1]]
    lines = [p for p in paths if not (len(p) == 2 and p[0] == p[1]) and not (len(p) > 3 and p[0] == p[-1])]
    outer = [[r] for r in rings if turn(r) >= 0]
    for hole in (r for r in rings if turn(r) < 0):
        around = [o for o in outer if holds(o[0], *[(a + b) / 2 for a, b in zip(hole[0], hole[1], strict=True)])]
        if around:
            min(around, key=lambda o: turn(o[0])).append(hole)
        else:
            outer.append([hole])  # no ring around it
    return points, lines, outer


def _pack(kind: int, body: bytes) -> bytes:
    return struct.pack("<BI", 1, kind) + body


def _path(path: Ring) -> bytes:
    return struct.pack(f"<I{2 * len(path)}d", len(path), *[v for p in path for v in p])


def write_wkb(edges: list[dict[str, float]]) -> bytes:
    points, lines, polygons = shapes(edges)
    single = {POINT: [_pack(POINT, struct.pack("<2d", *p)) for p in points], LINE: [_pack(LINE, _path(p)) for p in lines]}
    single[POLYGON] = [_pack(POLYGON, struct.pack("<I", len(p)) + b"".join(map(_path, p))) for p in polygons]
    groups = [(k, v) for k, v in single.items() if v]

    def several(kind: int, parts: list[bytes]) -> bytes:
        return _pack(kind, struct.pack("<I", len(parts)) + b"".join(parts))

    whole = [v[0] if len(v) == 1 else several(k + 3, v) for k, v in groups]
    return whole[0] if len(whole) == 1 else several(COLLECTION, whole)


def write_wkt(edges: list[dict[str, float]]) -> str:
    points, lines, polygons = shapes(edges)

    def listed(parts: list[str]) -> str:
        return f"({', '.join(parts)})"

    def path(positions: Ring) -> str:
        return listed([f"{x!r} {y!r}" for x, y in positions])

    parts = {"POINT": [path([p]) for p in points], "LINESTRING": [path(p) for p in lines], "POLYGON": [listed([path(r) for r in p]) for p in polygons]}
    found = [f"{k} {v[0]}" if len(v) == 1 else f"MULTI{k} {listed(v)}" for k, v in parts.items() if v]
    return found[0] if len(found) == 1 else f"GEOMETRYCOLLECTION {listed(found)}" if found else "GEOMETRYCOLLECTION EMPTY"


def ordered(edges: list[dict[str, float]], near: float = 1e-6) -> list[dict[str, float]]:
    """The same edges in the order of a walk; ends that rounding keeps apart, less than ``near``, are one.

    Ends meet in the cell of a grid or in the one beside it.
    """
    known: dict[tuple[int, int], Position] = {}

    def spot(x: float, y: float) -> Position:
        i, j = round(x / near), round(y / near)
        for at in ((i, j), *[(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]):
            if at in known:
                return known[at]
        known[i, j] = (x, y)
        return x, y

    joined = []
    for e in edges:
        (x1, y1), (x2, y2) = spot(e["x1"], e["y1"]), spot(e["x2"], e["y2"])
        if (x1, y1) != (x2, y2):
            joined.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
    return edges_of(walk(joined))


#: Outlines of a batch that are Python objects at once.
SLICE = 500


def _mapped(kind: str | pa.DataType, work, out: pa.DataType):
    @F.arrow_udf(kind)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # Outlines as Python objects are many times their size: few at a time.
            parts = [batch.slice(at, SLICE) for at in range(0, len(batch), SLICE)]
            yield pa.chunked_array([pa.array([None if v is None else work(v) for v in part.to_pylist()], out) for part in parts], out).combine_chunks()

    return column


def wkb_edges(column: Column) -> Column:
    """The edge array of a binary column; null stays null, an empty geometry has no edges."""
    return _mapped(G.EDGES_TYPE, lambda data: edges_of(read_wkb(data)), _EDGES)(column)


def edges_wkb(column: Column) -> Column:
    """Little-endian WKB of an edge array."""
    return _mapped("binary", write_wkb, pa.binary())(column)


def ordered_edges(column: Column) -> Column:
    """An edge array with its edges in the order of a walk."""
    return _mapped(G.EDGES_TYPE, ordered, _EDGES)(column)


def edges_wkt(column: Column) -> Column:
    return _mapped("string", write_wkt, pa.string())(column)


def wkt_edges(text: str) -> Column:
    """The edge array of a text column (SQL text), in the JVM: brackets and numbers make JSON, which Spark reads.

    Every type becomes polygons of rings; only polygons are turned. A collection of several types has no edges here.
    """
    body = f"regexp_replace(upper({text}), '^.*?;', '')"
    number = r"[-+0-9.E]+"
    spots = f"regexp_replace({body}, r'({number})\\s+({number})(\\s+{number})*', '[$1,$2]')"
    json = f"translate(regexp_replace(regexp_replace({spots}, '[A-Z]{{2,}}( ZM| Z| M)?', ''), 'EMPTY', ''), '()', '[]')"
    kind = f"regexp_extract({body}, '([A-Z]+)', 1)"
    level = {"POINT": 1, "MULTIPOINT": 1, "LINESTRING": 1, "MULTILINESTRING": 2, "POLYGON": 2, "MULTIPOLYGON": 3}
    position = "array<double>"

    # Each position of a set of points may have brackets of its own.
    bare = f"regexp_replace({json}, r'\\[\\s*(\\[[^\\[\\]]*\\])\\s*\\]', '$1')"

    def parsed(depth: int) -> str:
        text = f"CASE WHEN {kind} = 'MULTIPOINT' AND {json} LIKE '%[[[%' THEN {bare} ELSE {json} END" if depth == 1 else json
        rings = f"from_json({text}, '{'array<' * depth}{position}{'>' * depth}')"
        path = "transform({}, p -> named_struct('x', p[0], 'y', p[1]))"
        if depth == 1:
            return f"array(array({path.format(rings)}))"
        if depth == 2:
            return f"array(transform({rings}, r -> {path.format('r')}))"
        return f"transform({rings}, g -> transform(g, r -> {path.format('r')}))"

    cases = " ".join(f"WHEN '{k}' THEN {parsed(d)}" for k, d in level.items())
    turned = f"""transform(g, (r, i) -> CASE WHEN {kind} LIKE '%POLYGON' AND size(r) > 3
        AND ({G.signed_area.sql(G.ring_edges.sql('r'))} < 0) = (i = 0) THEN reverse(r) ELSE r END)"""
    # A path of one position, or a set of points, is made of edges without length.
    spot = "transform(r, p -> named_struct('x1', p.x, 'y1', p.y, 'x2', p.x, 'y2', p.y))"
    edges = f"CASE WHEN {kind} LIKE '%POINT' THEN {spot} ELSE {G.ring_edges.sql('r')} END"
    whole = f"flatten(transform(flatten(transform(CASE {kind} {cases} END, g -> {turned})), r -> {edges}))"
    return F.expr(f"CASE WHEN {text} IS NULL THEN NULL WHEN {body} LIKE '%EMPTY%' THEN cast(array() AS {G.EDGES_TYPE}) ELSE {whole} END")
