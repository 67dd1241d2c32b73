"""Parsed queries to lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..ast import ODataQuery
from ..edm import EntitySpec, Registry
from ..errors import ValidationError
from ..operators.apply import apply_steps
from ..operators.expand import expand
from ..operators.expression import Translator


@dataclass
class Plan:
    """df: the result; all_rows: before ordering and paging, for counts."""

    df: DataFrame
    all_rows: DataFrame
    aggregated: bool


def check_limits(query: ODataQuery, spec: EntitySpec, registry: Registry) -> None:
    top = spec.max_top or registry.options.max_top
    if query.top is not None and query.top > top:
        raise ValidationError(f"$top is over {top}", target="$top")


def plan(registry: Registry, spec: EntitySpec, query: ODataQuery, request: Any = None, operation: str = "read", limit: int | None = None) -> Plan:
    """Order of lowering: scope, filter, search, apply, order, page, expand, select."""
    options = registry.options
    tr = Translator(registry, request, spec.max_filter_depth, operation)
    df = registry.df(spec, operation, (), request)
    if query.filter is not None:
        df = tr.where(df, spec, query.filter)
    if query.search is not None:
        df = tr.search(df, spec, query.search)
    if query.apply:
        df = apply_steps(df, spec, query.apply, tr)
        paged = df
        if query.skip or query.top is not None or limit is not None:
            paged = paged.orderBy(*df.columns)
        return Plan(_page(paged, query.skip, query.top if limit is None else limit), df, True)
    for name in query.select or ():
        registry.property(spec, name)
    all_rows, n = df, query.top if limit is None else limit
    paging = bool(query.skip) or n is not None
    if query.orderby or paging:
        df = _page(tr.sorted(df, spec, query.orderby), query.skip, n)
    if query.expand:
        small = n is not None and n <= (spec.max_top or options.max_top)
        df = expand(df, spec, query.expand, tr, spec.max_expand_depth or options.max_expand_depth, page=None if n is None else df, small=small)
        if query.orderby or paging:  # joins do not keep the order
            df = tr.sorted(df, spec, query.orderby)
    if query.select is not None:
        extra = [c for c in df.columns if c not in all_rows.columns]
        df = df.select(*dict.fromkeys([*query.select, *spec.key]), *[f"`{c}`" for c in extra])
    return Plan(df, all_rows, False)


def _page(df: DataFrame, skip: int | None, top: int | None) -> DataFrame:
    if skip:
        df = df.offset(skip)
    return df if top is None else df.limit(top)
