"""Text filters, header resolution and tolerant parsing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Building uses counted as professional.
PROFESSIONAL_USES = ("Commercial et services", "Industriel")
# Substrings naming a wooded nature.
FOREST_HINTS = ("forêt", "foret", "bois", "haie")


def header_key(name: str) -> str:
    return str(name).strip().lower().replace(" ", "_").replace("-", "_")


def find_column(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate present among ``columns``, compared on normalised names."""
    known = {header_key(c): c for c in columns}
    for candidate in candidates:
        if header_key(candidate) in known:
            return known[header_key(candidate)]
    return None


def is_professional(df: DataFrame, uses: Sequence[str] = PROFESSIONAL_USES) -> Column:
    """True when either use column names a target use; a missing column or NULL counts as false."""
    tests = [
        F.coalesce(F.col(c).isin(*uses), F.lit(False))
        for c in ("usage_1", "usage_2")
        if c in df.columns
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_forest(nature: Column, hints: Sequence[str] = FOREST_HINTS) -> Column:
    text = F.lower(F.coalesce(nature, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(h) for h in hints])


def parse_coordinate(text: Column) -> Column:
    """Decimal-comma tolerant number; NULL when blank or invalid."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast(T.DoubleType())


def coordinate_error(text: Column, name: str) -> Column:
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit(f"missing {name}")).when(
        parse_coordinate(text).isNull(), F.lit(f"invalid {name}")
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def supplier_id(text: Column, row_number: Column) -> Column:
    generated = F.format_string("SUP-%06d", row_number)
    return F.coalesce(blank_to_null(text), generated)


USE_COMMODITY_COLUMN = "Use CSV COMMODITY column"  # Fixed value of the selector.


def raw_material(commodity: Column, selected: str) -> Column:
    if selected == USE_COMMODITY_COLUMN:
        return F.coalesce(commodity, F.lit("Unknown"))
    return F.lit(selected)
