"""$apply: a fold of steps over a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ast import Aggregate, FilterStep
from ..edm import EntitySpec
from ..errors import ValidationError
from .expression import Translator


def _aggregate(a: Aggregate, df: DataFrame) -> Column:
    if a.prop is not None and a.prop not in df.columns:
        raise ValidationError(f"no property {a.prop!r} to aggregate", target=a.prop)
    if a.prop is None:
        return F.count(F.lit(1)).alias(a.alias)
    kind = dict(df.dtypes)[a.prop]
    if a.method in ("sum", "avg") and not kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        raise ValidationError(f"{a.method} of {a.prop} needs a number", target=a.prop)
    build = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "countdistinct": F.count_distinct}
    return build[a.method](F.col(a.prop)).alias(a.alias)


def apply_steps(df: DataFrame, spec: EntitySpec, steps: tuple, translator: Translator) -> DataFrame:
    for step in steps:
        if isinstance(step, FilterStep):
            df = translator.where(df, spec, step.expr)
            continue
        for name in step.by or ():
            if name not in df.columns:
                raise ValidationError(f"no property {name!r} to group by", target=name)
        if set(step.by or ()) & {a.alias for a in step.aggregates}:
            raise ValidationError("an alias has the name of a grouping property")
        columns = [_aggregate(a, df) for a in step.aggregates]
        if step.by is None:
            df = df.agg(*columns)
        elif columns:
            df = df.groupBy(*step.by).agg(*columns)
        else:
            df = df.select(*step.by).distinct()
    return df
