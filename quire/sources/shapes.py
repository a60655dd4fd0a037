"""JSON documents checked against a shape, as column expressions over variants: where each fault is, and what it is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    least: int = 0


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Number:
    """whole: without a fraction; least: the smallest allowed; above: the largest no longer allowed below."""

    whole: bool = False
    least: int | None = None
    above: int | None = None


@dataclass(frozen=True)
class Flag:
    pass


@dataclass(frozen=True)
class Nullable:
    of: object


@dataclass(frozen=True)
class Optional:
    of: object


@dataclass(frozen=True)
class List:
    of: object
    size: int | None = None


@dataclass(frozen=True)
class Object:
    """strict: other fields than these are a fault."""

    fields: dict = field(hash=False)
    strict: bool = True


def kind(v: Column) -> Column:
    """What a variant is: string, number, boolean, object, array, null, or undefined where there is none."""
    schema = F.schema_of_variant(v)
    found = F.when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
    found = found.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("number")
    return F.when(v.isNull(), "undefined").when(F.is_variant_null(v), "null").otherwise(found)


def faults(v: Column, shape: object, path: Column | None = None) -> Column:
    """An array of the faults of a variant, in the order of the shape: path and message. Unknown fields are named in order of name."""
    path = F.lit("") if path is None else path
    none = F.array().cast("array<string>")
    said = lambda *m: F.array(F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit(": "))), *map(lit, m)))
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    below = lambda key: F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))
    not_a = lambda name: said(f"Invalid input: expected {name}, received ", kind(v))

    if isinstance(shape, Nullable):
        return F.when(F.coalesce(F.is_variant_null(v), F.lit(False)), none).otherwise(faults(v, shape.of, path))
    if isinstance(shape, Optional):
        return F.when(v.isNull(), none).otherwise(faults(v, shape.of, path))
    if isinstance(shape, Text):
        text = F.try_variant_get(v, "$", "string")
        small = said(f"Too small: expected string to have >={shape.least} characters")
        return F.when(kind(v) != "string", not_a("string")).when(F.length(text) < shape.least, small).otherwise(none)
    if isinstance(shape, OneOf):
        known = (kind(v) == "string") & F.try_variant_get(v, "$", "string").isin(*shape.values)
        listed = "|".join(f'"{x}"' for x in shape.values)
        return F.when(F.coalesce(known, F.lit(False)), none).otherwise(said(f"Invalid option: expected one of {listed}"))
    if isinstance(shape, Number):
        x = F.try_variant_get(v, "$", "double")
        out = F.when(kind(v) != "number", not_a("number"))
        if shape.whole:
            out = out.when(x != F.floor(x), said("Invalid input: expected int, received number"))
        if shape.least is not None:
            out = out.when(x < shape.least, said(f"Too small: expected number to be >={shape.least}"))
        if shape.above is not None:
            out = out.when(x <= shape.above, said(f"Too small: expected number to be >{shape.above}"))
        return out.otherwise(none)
    if isinstance(shape, Flag):
        return F.when(kind(v) != "boolean", not_a("boolean")).otherwise(none)
    if isinstance(shape, List):
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        each = F.flatten(F.transform(items, lambda e, i: faults(e, shape.of, below(i.cast("string")))))
        out = F.when(kind(v) != "array", not_a("array"))
        if shape.size is not None:
            out = out.when(F.size(items) != shape.size, said(f"Invalid input: expected array to have {shape.size} items"))
        return out.otherwise(each)
    if isinstance(shape, Object):
        own = F.try_variant_get(v, "$", "map<string,variant>")
        parts = [faults(F.try_element_at(own, F.lit(k)), s, below(F.lit(k))) for k, s in shape.fields.items()]
        if shape.strict:
            odd = F.array_except(F.map_keys(own), F.array(*map(F.lit, shape.fields)))
            names = F.array_join(F.transform(odd, lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ", ")
            word = F.when(F.size(odd) > 1, "Unrecognized keys: ").otherwise("Unrecognized key: ")
            parts.append(F.when(F.size(odd) > 0, said(word, names)).otherwise(none))
        return F.when(kind(v) != "object", not_a("object")).otherwise(F.concat(*parts))
    raise TypeError(f"no such shape: {shape}")


def summed_up(found: Column, most: int = 5, more: bool = True) -> Column:
    """The first faults in one line, and how many more there are; null where there are none."""
    line = F.array_join(F.slice(found, 1, most), "; ")
    rest = F.when(F.size(found) > most, F.concat(F.lit(" (+"), F.size(found) - most, F.lit(" more)"))).otherwise("")
    return F.when(F.size(found) > 0, F.concat(line, rest) if more else line)
