"""Named query sets: which shapes are asked over which periods, and what each window is called."""

from __future__ import annotations

from calendar import month_abbr
from collections.abc import Iterable
from itertools import pairwise

from waymark.functions.times import ALL_TIME, TimeSpan, during
from waymark.operators.windows import Shape, WindowRow, box_shape, buffer_shape, envelope_shape, polygon_shape
from waymark.plans import regions as R

Preset = tuple[list[Shape], list[WindowRow]]
Period = tuple[str, TimeSpan]

ALL_YEARS = range(1980, 2016)


def combine(prefix: str, shapes: Iterable[tuple[str, Shape]], periods: Iterable[Period]) -> Preset:
    """Every shape in every period; the name is prefix, period and shape label."""
    shapes, periods = list(shapes), list(periods)
    rows = [
        WindowRow("-".join(p for p in (prefix, when, label) if p), shape.geom_id, span)
        for when, span in periods for label, shape in shapes
    ]
    return [s for _, s in shapes], rows


def loose_name(name: str, loose: bool) -> str:
    return f"{name}-LOOSE" if loose else name


# ---- periods -----------------------------------------------------------------------------------

def month_periods(years: Iterable[int], last_day: int | None = None) -> list[Period]:
    """Calendar months, or the part of each month before ``last_day``."""
    out = []
    for y in years:
        for m in range(1, 13):
            end = f"{y}-{m:02d}-{last_day:02d}" if last_day else (f"{y + 1}-01-01" if m == 12 else f"{y}-{m + 1:02d}-01")
            out.append((f"{y}-{month_abbr[m].upper()}", during(f"{y}-{m:02d}-01", end)))
    return out


# The words of the half years, with first and last day and years later.
HALF_PERIODS = [("firsthalf", "01-01", "06-01", 0), ("lasthalf", "06-01", "01-01", 1)]


def half_periods(years: Iterable[int]) -> list[Period]:
    return [(f"{y}-{word}", during(f"{y}-{a}", f"{y + later}-{b}")) for y in years for word, a, b, later in HALF_PERIODS]


# First and last day of the regional periods, as (label suffix, start, end, years later).
REGION_PERIODS = {
    "TWO-YEARS": [("", "01-04", "01-01", 2)],
    "ONE-YEAR": [("", "01-04", "01-01", 1)],
    "TEN-MONTHS": [("", "01-04", "11-01", 0)],
    "SIX-MONTHS": [("-summerhalf", "01-04", "10-01", 0), ("-winterhalf", "10-01", "04-01", 1)],
    "THREE-MONTHS": [("-quarter1", "01-01", "04-01", 0), ("-quarter2", "04-01", "07-01", 0),
                     ("-quarter3", "07-01", "10-01", 0)],
}
# The same for the city buffers.
CITY_PERIODS = {
    "FOURTEEN-MONTHS": ("01-01", "03-01", 1), "TEN-MONTHS": ("01-01", "11-01", 0),
    "six-MONTHS": ("01-01", "07-01", 0), "TWO-MONTHS": ("01-01", "03-01", 0),
    "TWO-WEEKS": ("05-14", "05-29", 0), "SIX-DAYS": ("05-01", "05-07", 0),
}


def region_periods(kind: str, year: int) -> list[Period]:
    return [(f"{year}{label}", during(f"{year}-{a}", f"{year + later}-{b}")) for label, a, b, later in REGION_PERIODS[kind]]


def city_period(kind: str, year: int) -> Period:
    a, b, later = CITY_PERIODS[kind]
    return f"{year}", during(f"{year}-{a}", f"{year + later}-{b}")


# ---- shapes ------------------------------------------------------------------------------------

def beijing() -> Shape:
    return polygon_shape("beijing", *R.BEIJING)


def beijing_center() -> Shape:
    return polygon_shape("beijing-center", *R.BEIJING_CENTER)


def beijing_box() -> Shape:
    return box_shape("beijing-box", R.BEIJING_BOX)


def california(bbox: bool = False) -> Shape:
    shape = polygon_shape("california", *R.CALIFORNIA)
    return envelope_shape("california-box", shape) if bbox else shape


def usa() -> Shape:
    return polygon_shape("usa", *R.USA)


def france_regions() -> dict[str, Shape]:
    return {name: polygon_shape(name, *rings) for name, rings in R.FRANCE_REGIONS.items()}


def france(bbox: bool = False) -> Shape:
    """All regions as one multipolygon, or its box. Edges two regions share cancel out under the even-odd
    rule only when both have them vertex by vertex, as these outlines do; overlaps would not be right."""
    shape = polygon_shape("France", *[ring for rings in R.FRANCE_REGIONS.values() for ring in rings])
    return envelope_shape("France-box", shape) if bbox else shape


def countries() -> dict[str, Shape]:
    return {name: polygon_shape(name, *rings) for name, rings in R.SOUTH_AMERICA.items()}


def city_buffers(city: str, sizes: Iterable[int] = R.CITY_BUFFER_KM, mode: str = "distance") -> list[tuple[str, Shape]]:
    lon, lat = next((s[2], s[3]) for s in R.SITES if s[1] == city)
    return [(f"{city}-{km}-KM", buffer_shape(f"{city}-{km}-KM", lon, lat, km * 1000.0, mode)) for km in sizes]


def paris_buffers() -> list[tuple[str, Shape]]:
    _, _, lon, lat = R.SITES[0]
    return [(f"{km * 1000}-METERS", buffer_shape(f"{km * 1000}-METERS", lon, lat, km * 1000.0)) for km in R.PARIS_BUFFER_KM]


def grid(box, cols: int, rows: int) -> list[tuple[int, int, tuple[float, float, float, float]]]:
    """Cells between evenly spaced edges, as column, row from the top, and box; neighbours share their edge exactly."""
    west, south, east, north = box
    meridians = [west + (east - west) * i / cols for i in range(cols + 1)]
    parallels = [north - (north - south) * j / rows for j in range(rows + 1)]
    bands = [(j, low, high) for j, (high, low) in enumerate(pairwise(parallels))]
    strips = [(i, left, right) for i, (left, right) in enumerate(pairwise(meridians))]
    return [(i, j, (left, low, right, high)) for j, low, high in bands for i, left, right in strips]


# ---- trajectory queries ------------------------------------------------------------------------

def month_span(year: int, month: int) -> TimeSpan:
    end = f"{year + 1}-01-01" if month == 12 else f"{year}-{month + 1:02d}-01"
    return during(f"{year}-{month:02d}-01", end)


def life(area: str | None, year: int | None = None, month: int | None = None, how: str = "COUNT", loose: bool = False) -> Preset:
    """Beijing, its centre or a box of either, over all time, a year or a month."""
    shape = {
        None: None, "BEIJING": beijing(), "BEIJING-CENTER": beijing_center(), "BEIJING-BBOX": beijing_box(),
        "CENTER-BEIJING": beijing_center(),
        "CENTER-BEIJING-BBOX": envelope_shape("beijing-center-box", beijing_center()),
    }[area]
    span = ALL_TIME if year is None else (month_span(year, month) if month else during(f"{year}-01-01", f"{year + 1}-01-01"))
    words = ["GEOLIFE-IN", area, month_abbr[month].upper() if month else None, str(year) if year else None, how]
    name = loose_name("-".join(w for w in words if w), loose)
    return ([shape] if shape else []), [WindowRow(name, shape.geom_id if shape else "everywhere", span)]


def life_tiles(tile_width: int) -> Preset:
    shapes = [(f"{c}-{r}", box_shape(f"tile-{c}-{r}", box)) for c, r, box in grid(R.BEIJING_BOX, tile_width, tile_width)]
    return combine(f"GEOLIFE-BEIJING-BBOXES-ITERATE-{tile_width}", shapes, [("", ALL_TIME)])


# ---- event queries -----------------------------------------------------------------------------

def event_prefix(context: str | None) -> str:
    """``GDELT``, or ``CITIES-<context>`` for the query set run in a test context."""
    return f"CITIES-{context.upper()}" if context else "GDELT"


def france_region_bbox_7d(context: str | None = None, year: int = 2001) -> Preset:
    name, shape = next(iter(france_regions().items()))
    span = during(f"{year}-01-01", f"{year}-01-07")
    return combine(f"{event_prefix(context)}-IN-FRANCE-REGION-BBOX-7-DAYS", [("", envelope_shape(f"{name}-box", shape))], [("", span)])


def france_halves(bbox: bool, years: Iterable[int] = ALL_YEARS, context: str | None = None) -> Preset:
    label = "FRANCE-BBOX" if bbox else "FRANCE"
    return combine(f"{event_prefix(context)}-IN-{label}-SIX-MONTHS", [("", france(bbox))], half_periods(years))


def france_months(bbox: bool, years: Iterable[int] = ALL_YEARS, context: str | None = None) -> Preset:
    label = "FRANCE-BBOX" if bbox else "FRANCE"
    return combine(f"{event_prefix(context)}-IN-{label}-ONE-MONTH", [("", france(bbox))], month_periods(years))


def france_by_region(kind: str, year: int, context: str | None = None, region: str | None = None) -> Preset:
    shapes = [(n, s) for n, s in france_regions().items() if region in (None, n)]
    if kind == "TEN-MONTHS" and region is None:
        shapes.append(("France", france()))
    return combine(f"{event_prefix(context)}-IN-FRANCE-REGIONS-{kind}", shapes, region_periods(kind, year))


def city_windows(kind: str, year: int, cities: Iterable[str], sizes: Iterable[int] = R.CITY_BUFFER_KM,
                 context: str | None = None, mode: str = "distance") -> Preset:
    shapes = [pair for city in cities for pair in city_buffers(city, sizes, mode)]
    return combine(f"{event_prefix(context)}-IN-CITY-BUFFERS-{kind}", shapes, [city_period(kind, year)])


def south_america_3w(year: int, context: str | None = None, country: str | None = None) -> Preset:
    shapes = [(n, s) for n, s in countries().items() if country in (None, n)]
    return combine(f"{event_prefix(context)}-IN-SOUTH-AMERICA-COUNTRIES-THREE-WEEKS", shapes, month_periods([year], last_day=22))


# ---- track queries -----------------------------------------------------------------------------

def tracks_california(bbox: bool, period: str | None, year: int = 2015) -> Preset:
    span = {None: ALL_TIME, "7-DAY": during(f"{year}-01-01", f"{year}-01-07"),
            "1-MONTH": during(f"{year}-01-01", f"{year}-02-01")}[period]
    words = ["TRACKS-IN-CA", "BBOX" if bbox else None, period]
    return combine("-".join(w for w in words if w), [("", california(bbox))], [("", span)])


def tracks_california_months(year: int = 2015) -> Preset:
    return combine("TRACKS-IN-CALIFORNIA-MONTHS", [("", california())], month_periods([year]))


# The period words of the grid queries with their length in days; None is a calendar month.
GRID_PERIODS = {"5DAY": 5, "1WEEK": 7, "9DAY": 9, "18DAY": 18, "27DAY": 27, "1MONTH": None}


# How often each of them follows itself in the year.
GRID_STEPS = {"1MONTH": 12, "27DAY": 13, "18DAY": 20, "9DAY": 40, "1WEEK": 52, "5DAY": 73}


def grid_span(period: str, index: int, year: int = 2015) -> TimeSpan:
    """``start + index periods .. start + (index + 1) periods - 2 s``."""
    from datetime import datetime, timedelta
    first = datetime(year, 1, 1, 0, 0, 1)
    days = GRID_PERIODS[period]

    def start(k: int) -> datetime:
        if days:
            return first + timedelta(days=days * k)
        return first.replace(year=year + k // 12, month=k % 12 + 1)

    return during(start(index), start(index + 1), minus_seconds=2)


def tracks_grid(context: str, period: str, levels: Iterable[int], indexes: Iterable[int], year: int = 2015) -> Preset:
    """All cells of the pyramid levels in the given spans of a period."""
    shapes, rows = [], []
    for z in levels:
        for c, r, box in grid(usa().box, 2**z, 2**(z - 1)):
            shapes.append(box_shape(f"{z}-{c}-{r}", box))
    for k in indexes:
        rows += [WindowRow(f"TRACKS-USA-GRID-{context.upper()}-{period}-{k}-{s.geom_id}", s.geom_id, grid_span(period, k, year)) for s in shapes]
    return shapes, rows


def tracks_grid_spans(year: int = 2015) -> list[WindowRow]:
    """Every index of every period, for any cell."""
    return [WindowRow(f"{period}-{k}", span=grid_span(period, k, year)) for period, n in GRID_STEPS.items() for k in range(n)]


# ---- other sets --------------------------------------------------------------------------------

def free_buffers(lon: float, lat: float) -> Preset:
    shapes = [(f"({lon},{lat})-{km}-KM", buffer_shape(f"free-{km}-KM", lon, lat, km * 1000.0)) for km in R.FREE_BUFFER_KM]
    return combine("TRANS-VIENNA-BUFFERS", shapes, [("", ALL_TIME)])


def plan_cities(years: Iterable[int], cities: Iterable[str] = tuple(s[1] for s in R.SITES[:10])) -> Preset:
    """City x size x year x four windows."""
    shapes = [pair for city in cities for pair in city_buffers(city)]
    kinds = {"6_months": "six-MONTHS", "2_months": "TWO-MONTHS", "2_weeks": "TWO-WEEKS", "6_days": "SIX-DAYS"}
    periods = [(f"{label}-{y}", city_period(kind, y)[1]) for y in years for label, kind in kinds.items()]
    return combine("plan", shapes, periods)


def plan_countries(years: Iterable[int]) -> Preset:
    """Country x month x year, first three weeks."""
    return combine("plan", countries().items(), month_periods(years, last_day=22))
