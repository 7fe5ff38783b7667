"""Column expressions over records: cleaning of JSON, labels, neighbours, views, regions, nominal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which kinds of dimension may describe which kind of feature.
DIMENSIONS_OF = {"hole": ["diameter", "radius"], "cylinder": ["diameter", "height"], "plane": ["length", "width", "distance"]}


def clean_json(text: Column) -> Column:
    """JSON text in which no key or string value begins or ends with white space, however deep it stands."""
    return F.regexp_replace(text, r'"\s*((?:[^"\\]|\\.)*?)\s*"', '"$1"')


def clean_map(m: Column) -> Column:
    """A map of strings with trimmed keys and values."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value"))))


def label_number(label: Column) -> Column:
    """A label given as a number or as an object with `feature_id` or `label`; an object with neither is an error."""
    value = F.coalesce(F.get_json_object(label, "$.feature_id"), F.get_json_object(label, "$.label"))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int")
    return F.when(F.ltrim(label).startswith("{"), F.when(value.isNotNull(), value.cast("int")).otherwise(unknown)).otherwise(F.trim(label).cast("double").cast("int"))


def neighbour(item: Column) -> Column:
    """Struct (segment, relation) of a neighbour given as an object or as a bare segment number."""
    named = F.ltrim(item).startswith("{")
    segment = F.when(named, F.get_json_object(item, "$.segment")).otherwise(F.format_string("seg_%03d", F.trim(item).cast("int")))
    relation = F.when(named, F.coalesce(F.get_json_object(item, "$.relation"), F.lit("unknown"))).otherwise("unknown")
    return F.struct(segment.alias("segment"), relation.alias("relation"))


def region(x: Column, y: Column, view_box: Column, width: Column, height: Column, size: tuple[int, int] = (80, 40), least: int = 10) -> Column:
    """Struct (x1, y1, x2, y2, valid): the pixels around a text's place in an image of width x height.

    The place is mapped from `view_box` ("x y w h", with spaces or commas) if that has four numbers; edges are cut off
    towards zero and kept in the image; a region under `least` pixels either way is not valid."""
    box = F.split(F.trim(F.regexp_replace(F.coalesce(view_box, F.lit("")), r"[,\s]+", " ")), " ")
    part = lambda k: F.get(box, F.lit(k)).try_cast("double")
    whole = F.size(box) == 4
    scale = lambda n, k: F.when(part(k) > 0, n / part(k)).otherwise(1.0)
    px = F.when(whole, (x - part(0)) * scale(width, 2)).otherwise(x)
    py = F.when(whole, (y - part(1)) * scale(height, 3)).otherwise(y)
    low = lambda p, s: F.greatest(F.lit(0), (p - s / 2).cast("int"))
    high = lambda p, s, n: F.least(n.cast("int"), (p + s / 2).cast("int"))
    x1, x2, y1, y2 = low(px, size[0]), high(px, size[0], width), low(py, size[1]), high(py, size[1], height)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x2 - x1 >= least) & (y2 - y1 >= least)).alias("valid"))


def view_name(x: Column, y: Column, z: Column, reach: float = 0.3) -> Column:
    """The view that a direction looks at, if it is within `reach` of an axis in every component (relative 1e-5)."""
    n = F.sqrt(x * x + y * y + z * z)
    u = [c / n for c in (x, y, z)]
    near = lambda k: sum(((F.abs(F.abs(u[i]) - float(i == k)) > reach + 1e-5 * (i == k)).cast("int") for i in range(3)), F.lit(0)) == 0
    side = lambda k, a, b: F.when(u[k] > 0, a).otherwise(b)
    return F.when(near(2), side(2, "front", "back")).when(near(1), side(1, "top", "bottom")).when(near(0), side(0, "right", "left")).otherwise("isometric")


def ray(u: Column, v: Column, rotation: list[Column], shift: tuple[Column, Column], scale: Column) -> Column:
    """Struct (ox, oy, oz, dx, dy, dz) of the ray that an orthographic projection maps to (u, v). `rotation`: nine
    columns, by rows."""
    a, b = (u - shift[0]) / scale, (v - shift[1]) / scale
    origin = [rotation[k] * a + rotation[3 + k] * b for k in range(3)]
    return F.struct(*(o.alias(f"o{n}") for o, n in zip(origin, "xyz")), *((-rotation[6 + k]).alias(f"d{n}") for k, n in enumerate("xyz")))


def nominal_of(diameter: Column, radius: Column, dimensions: Column, low: Column, high: Column) -> Column:
    """A feature's nominal value: its diameter, twice its radius, its largest dimension or side of its box, else 1."""
    box = F.array_max(F.zip_with(high, low, lambda a, b: a - b))
    return F.coalesce(diameter, 2 * radius, F.array_max(dimensions), box, F.lit(1.0))


def dimension_fits(feature_type: Column, dimension_type: Column) -> Column:
    out = F.lit(False)
    for kind, types in DIMENSIONS_OF.items():
        out = out | ((feature_type == kind) & dimension_type.isin(types))
    return F.coalesce(out, F.lit(False))


def dimensions_of(feature_type: Column) -> Column:
    """The dimension types that may describe a feature type (`dimension_fits`), none for an unknown one."""
    known = F.create_map(*(x for kind, types in DIMENSIONS_OF.items() for x in (F.lit(kind), F.array(*map(F.lit, types)))))
    return F.coalesce(F.try_element_at(known, feature_type), F.array().cast("array<string>"))


def name_of(names: list[str], label: Column) -> Column:
    """The name of a class number; null outside the list."""
    return F.get(F.array(*map(F.lit, names)), label.cast("int"))
