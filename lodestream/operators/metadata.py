"""Free-form metadata as one VARIANT column, with filters that extract what they compare.

`as_variant` parses a JSON column once; written to Parquet, the column keeps its binary form, and only the paths that filters name are
decoded. A filter compares values of its own kind: numbers with numbers, strings with strings, truth values with truth values. Where the
kinds differ nothing is equal, and no order holds. A value that is missing or null passes only neq and not_in. Numbers are compared with
six places after the point; larger ones than 38 digits count as of another kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "decimal(38,6)"


def as_variant(df: DataFrame, column: str, into: str = "metadata") -> DataFrame:
    """df with a JSON column as VARIANT; text that is no JSON is null."""
    return df.withColumn(into, F.try_parse_json(F.col(column)))


def path_of(field: str) -> str:
    """a.b as the path $['a']['b']; the names may hold anything but a point."""
    return "$" + "".join("['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']" for part in field.split("."))


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, str):
        return "string"
    raise ValueError(f"no filter on a {type(value).__name__}")


def literal(value: Any) -> Column:
    return F.lit(str(value)).cast(NUMBER) if kind_of(value) == NUMBER else F.lit(value)


class FieldFilter(NamedTuple):
    """field (with points between levels), operator (eq neq gt gte lt lte in not_in contains), value."""

    field: str
    operator: str
    value: Any

    def column(self, metadata: str = "metadata") -> Column:
        m, path = F.col(metadata), path_of(self.field)
        raw = F.try_variant_get(m, path, "variant")
        is_of = F.schema_of_variant(raw)
        names = {"boolean": is_of == "BOOLEAN", "string": is_of == "STRING", NUMBER: is_of.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")}

        def one(kind: str) -> Column:
            return F.when(names[kind], F.try_variant_get(m, path, kind))

        def equal(value: Any) -> Column:
            return F.coalesce(one(kind_of(value)) == literal(value), F.lit(False))

        def held(value: Any) -> Column:
            items = F.when(is_of.startswith("ARRAY"), F.try_variant_get(m, path, "array<variant>"))
            kind = kind_of(value)
            same = {"boolean": lambda k: k == "BOOLEAN", "string": lambda k: k == "STRING", NUMBER: lambda k: k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")}[kind]
            inside = F.exists(items, lambda x: F.coalesce(same(F.schema_of_variant(x)) & (F.try_variant_get(x, "$", kind) == literal(value)), F.lit(False)))
            text = F.contains(one("string"), F.lit(value)) if kind == "string" else F.lit(False)
            return F.coalesce(inside, F.lit(False)) | F.coalesce(text, F.lit(False))

        order = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
        some = lambda values: reduce(Column.__or__, [equal(v) for v in values], F.lit(False))
        if self.operator in order:
            return F.coalesce(order[self.operator](one(kind_of(self.value)), literal(self.value)), F.lit(False))
        made = {"eq": equal, "neq": lambda v: ~equal(v), "in": some, "not_in": lambda v: ~some(v), "contains": held}
        if self.operator not in made:
            raise ValueError(f"no such operator: {self.operator}")
        return made[self.operator](self.value)


def passing(df: DataFrame, filters: Sequence[FieldFilter], metadata: str = "metadata") -> DataFrame:
    """The rows that pass all filters."""
    return df.where(reduce(Column.__and__, [f.column(metadata) for f in filters])) if filters else df
