"""Small scalar rules that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: colours of classes that no preset names, and of blank ones
PALETTE = ("#00BFC4", "#F8766D", "#7CAE00", "#C77CFF", "#E69F00", "#56B4E9", "#CC79A7")
BLANK = "#00BFC4"


def label_or(column: Column, other: str) -> Column:
    """The label, or `other` where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(other))


def namespace_id(*parts: Column) -> Column:
    """Parts percent-encoded (a space as %20) and joined by ::."""
    return F.concat_ws("::", *[F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")) for p in parts])


def stable_colour(label: Column) -> Column:
    """A palette colour from the sum of the lower-case name's code points times their places."""
    name = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    total = F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), F.lit(0).cast("long"), lambda s, i: s + F.ascii(F.get(chars, i)).cast("long") * (i + 1))
    picked = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (total % len(PALETTE) + 1).cast("int"))
    return F.when(F.size(chars) > 0, picked).otherwise(F.lit(BLANK))


def colour(value: Column) -> Column:
    """#RRGGBB from #rgb, #rrggbb, 0xRRGGBB or a packed whole number; null for anything else."""
    v = F.upper(F.trim(value.cast("string")))
    short = F.regexp_replace(v, r"^#([0-9A-F])([0-9A-F])([0-9A-F])$", "#$1$1$2$2$3$3")
    packed = F.concat(F.lit("#"), F.lpad(F.hex(v.try_cast("long").bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))
    return F.when(v.rlike("^#[0-9A-F]{6}$"), v).when(v.rlike("^#[0-9A-F]{3}$"), short).when(v.rlike("^0X[0-9A-F]{6}$"), F.concat(F.lit("#"), F.substring(v, 3, 6))).when(v.rlike(r"^-?\d+$"), packed)


def hash_order(seed: int, key: Column) -> Column:
    """A seeded order that every engine can repeat: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def first_number(properties: Column, keys: list[str]) -> Column:
    """The first property, by priority, that is a number above 0."""
    value = lambda k: F.element_at(properties, k).try_cast("double")
    return F.coalesce(*[F.when(value(k) > 0, value(k)) for k in keys])
