"""Vectors, hashes, page numbers and money as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 for equal directions; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def sign_bits(a: Column, first: int = 0, bits: int = 32) -> Column:
    """A long with a bit for each positive component of a stretch of a vector."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(F.when(F.element_at(a, i + first + 1) > 0, 1).otherwise(0).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def snapped(width: Column, widths: tuple[int, ...] = (240, 480, 960, 1600), default: int = 480) -> Column:
    """The smallest offered width that is not below the wanted one; the largest beyond all; the default for none."""
    fitting = reduce(lambda rest, w: F.when(width <= w, w).otherwise(rest), reversed(widths), F.lit(widths[-1]))
    return F.when(width.isNull(), default).otherwise(fitting)


def pdf_page(printed: Column, offset: Column) -> Column:
    return printed + offset


def spread_folios(page: Column, pages: int, anchor_page: int, anchor_folio: int) -> Column:
    """The two folios of a spread page; none for pages before the anchor or at the last page and beyond."""
    first = anchor_folio + 2 * (page - anchor_page)
    return F.when((page >= anchor_page) & (page <= pages), F.array(first, first + 1)).otherwise(F.array().cast("array<int>"))


def spread_of_folio(folio: Column, pages: int, anchor_page: int, anchor_folio: int) -> Column:
    page = F.floor((folio - anchor_folio) / 2).cast("int") + anchor_page
    return F.when((folio >= anchor_folio) & (page <= pages), page)


def cost_usd(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars for token counts at prices per million; cached input at a tenth, writing the cache at 1.25 times."""
    return (tokens_in * price_in + cache_read * price_in * 0.1 + cache_write * price_in * 1.25 + tokens_out * price_out) / 1e6


def item_key(prompt: Column, books: Column) -> Column:
    """Sixteen hex digits that change with the prompt or the set of books."""
    return F.substring(F.sha2(F.concat_ws("\n", prompt, F.array_join(F.array_sort(books), ",")), 256), 1, 16)


def short_version(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def union_box(boxes: Column) -> Column:
    """The smallest box (left, top, right, bottom) that holds all of an array of boxes."""
    side = lambda i, f: f(F.transform(boxes, lambda b: b[i]))
    return F.when(F.size(boxes) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def contained_share(inner: Column, outer: Column) -> Column:
    """The share of a box's area that lies in another."""
    w = F.greatest(F.lit(0.0), F.least(inner[2], outer[2]) - F.greatest(inner[0], outer[0]))
    h = F.greatest(F.lit(0.0), F.least(inner[3], outer[3]) - F.greatest(inner[1], outer[1]))
    return w * h / F.nullif((inner[2] - inner[0]) * (inner[3] - inner[1]), F.lit(0.0))


def cache_header(version: Column, current: Column, max_age: int = 31_536_000) -> Column:
    """Files asked for by their current version keep for long, others are asked for again."""
    return F.when(version.eqNullSafe(current) & version.isNotNull(), F.lit(f"private, max-age={max_age}, immutable")).otherwise(F.lit("no-cache"))


def brightness_hash(pixels: Column) -> Column:
    """The 64-bit hash of a picture's eight by eight grey values: a bit is set where one is over their mean; the first is the
    highest."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    bits = F.transform(pixels, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(63) - i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda h, b: h.bitwiseOR(b))


def aspect_off(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """By what share a photo's shape differs from its page's."""
    return F.abs((width / height) / (page_width / page_height) - 1)
