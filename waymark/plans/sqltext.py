"""SQL text of window sets, built from the same parameters as the Spark side."""

from __future__ import annotations

from waymark.functions.times import TimeSpan
from waymark.operators.windows import Shape, WindowRow
from waymark.plans.fixtures import mx_sql, my_sql, with_ctes


def num(v: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({v!r} AS DOUBLE)"


def stamp(v) -> str:
    return "CAST(NULL AS TIMESTAMP)" if v is None else f"TIMESTAMP '{v.isoformat(sep=' ')}'"


def shapes_cte(shapes: list[Shape]) -> str:
    rows = ", ".join(
        f"('{s.geom_id}', {', '.join(num(v) for v in s.box)}, {', '.join(num(v) for v in (s.circle or (None,) * 3))}, "
        f"{s.level}, {'TRUE' if s.edges else 'FALSE'})" for s in shapes)
    edges = ", ".join(
        f"('{s.geom_id}', {', '.join(num(v) for v in e)})" for s in shapes for e in s.edges
    ) or "(NULL, NULL, NULL, NULL, NULL)"
    return (f"shapes(geom_id, xmin, ymin, xmax, ymax, mx, my, metres, lvl, poly) AS (VALUES {rows}), "
            f"edges(geom_id, x1, y1, x2, y2) AS (VALUES {edges})")


def windows_cte(rows: list[WindowRow]) -> str:
    values = ", ".join(
        f"('{r.name}', '{r.geom_id}', {stamp(r.span.lo)}, {stamp(r.span.hi)}, {'TRUE' if r.span.closed else 'FALSE'})"
        for r in rows)
    return f"windows(name, geom_id, lo, hi, closed) AS (VALUES {values})"


# A point is in a polygon if it lies on an edge or an odd number of edges passes to its right.
_SIDE = "((e.x2-e.x1)*(f.lat-e.y1)-(f.lon-e.x1)*(e.y2-e.y1))"


def hits_cte(features: str, mode: str = "exact") -> str:
    """``hits(fid, geom_id)``: features in shapes, by nested loops over all edges."""
    if mode == "loose":
        n = "pow(2e0, s.lvl)"
        # of a polygon's cells those that an edge's box touches or whose centre is inside, as the cover has them
        side = "((e.x2-e.x1)*(t.my-e.y1)-(t.mx-e.x1)*(e.y2-e.y1))"
        return (
            f"celled AS (SELECT f.fid, s.geom_id, s.poly, {n} AS n, floor((f.lon+180e0)/360e0*{n}) AS cx, floor((f.lat+90e0)/180e0*{n}) AS cy FROM {features} f JOIN shapes s ON "
            f"floor((f.lon+180e0)/360e0*{n}) BETWEEN floor((s.xmin+180e0)/360e0*{n}) AND floor((s.xmax+180e0)/360e0*{n}) AND "
            f"floor((f.lat+90e0)/180e0*{n}) BETWEEN floor((s.ymin+90e0)/180e0*{n}) AND floor((s.ymax+90e0)/180e0*{n})), "
            "tiles AS (SELECT *, (ax+bx)/2e0 AS mx, (ay+b_y)/2e0 AS my FROM (SELECT DISTINCT geom_id, cx, cy, cx/n*360e0-180e0-1e-9 AS ax, cy/n*180e0-90e0-1e-9 AS ay, "
            "(cx+1)/n*360e0-180e0+1e-9 AS bx, (cy+1)/n*180e0-90e0+1e-9 AS b_y FROM celled WHERE poly)), "
            "cover AS (SELECT t.geom_id, t.cx, t.cy FROM tiles t JOIN edges e ON e.geom_id = t.geom_id GROUP BY ALL "
            "HAVING bool_or(greatest(e.x1,e.x2) >= t.ax AND least(e.x1,e.x2) <= t.bx AND e.y2 >= t.ay AND e.y1 <= t.b_y) "
            f"OR count(*) FILTER (WHERE t.my >= e.y1 AND t.my < e.y2 AND {side} > 0) % 2 = 1), "
            "hits AS (SELECT fid, geom_id FROM celled WHERE NOT poly UNION ALL SELECT c.fid, c.geom_id FROM celled c JOIN cover USING (geom_id, cx, cy))")
    return (
        f"boxed AS (SELECT f.fid, f.lon, f.lat, s.geom_id, s.poly FROM {features} f JOIN shapes s ON "
        "f.lon BETWEEN s.xmin AND s.xmax AND f.lat BETWEEN s.ymin AND s.ymax "
        f"AND (s.metres IS NULL OR pow({mx_sql('f.lon')}-s.mx,2)+pow({my_sql('f.lat')}-s.my,2) <= s.metres*s.metres)), "
        f"ringed AS (SELECT f.fid, f.geom_id, count(*) FILTER (WHERE f.lat >= e.y1 AND f.lat < e.y2 AND {_SIDE} > 0) % 2 = 1 "
        f"OR bool_or(f.lat BETWEEN e.y1 AND e.y2 AND f.lon BETWEEN least(e.x1,e.x2) AND greatest(e.x1,e.x2) AND {_SIDE} = 0) AS inside "
        "FROM boxed f JOIN edges e ON e.geom_id = f.geom_id WHERE f.poly GROUP BY f.fid, f.geom_id), "
        "hits AS (SELECT fid, geom_id FROM boxed WHERE NOT poly UNION ALL SELECT fid, geom_id FROM ringed WHERE inside)"
    )


def span_test(ts: str, w: str = "w") -> str:
    return (f"({w}.lo IS NULL OR {ts} > {w}.lo OR ({w}.closed AND {ts} = {w}.lo)) AND "
            f"({w}.hi IS NULL OR {ts} < {w}.hi OR ({w}.closed AND {ts} = {w}.hi))")


def span_literal(ts: str, span: TimeSpan) -> str:
    """The test of one known span, ends written out."""
    eq = "=" if span.closed else ""
    tests = [f"{ts} >{eq} {stamp(span.lo)}"] if span.lo else []
    tests += [f"{ts} <{eq} {stamp(span.hi)}"] if span.hi else []
    return " AND ".join(tests) or "TRUE"


def count_windows_sql(features: str, shapes: list[Shape], rows: list[WindowRow], time_col: str = "ts",
                      mode: str = "exact") -> str:
    """``name, n`` for all windows."""
    extra = [windows_cte(rows)]
    if shapes:
        extra += [shapes_cte(shapes), hits_cte(features, mode)]
        pairs = (f"SELECT w.name, count(*) AS n FROM hits h JOIN {features} f ON f.fid = h.fid "
                 f"JOIN windows w ON w.geom_id = h.geom_id AND {span_test('f.' + time_col)} GROUP BY w.name")
    else:
        pairs = f"SELECT w.name, count(*) AS n FROM {features} f JOIN windows w ON {span_test('f.' + time_col)} GROUP BY w.name"
    return with_ctes(features, f"SELECT w.name, coalesce(c.n, 0) AS n FROM windows w LEFT JOIN ({pairs}) c ON c.name = w.name", *extra)
