"""$expand: related entities as struct and array columns.

Children are filtered, paged and gathered by their parent's key before the left join, so sibling
collections never multiply each other and a nested condition never drops a parent.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ast import Expand
from ..edm import EntitySpec
from ..errors import ValidationError
from .expression import Translator, all_of


def unroll(item: Expand, recursive: bool, limit: int, depth: int) -> Expand:
    """$levels as that many nested expands."""
    if item.levels is None:
        return item
    levels = limit - depth + 1 if item.levels == "max" else item.levels
    if levels > 1 and not recursive:
        raise ValidationError(f"$levels of {item.nav}, which does not lead to its own type")
    if depth + levels - 1 > limit:
        raise ValidationError(f"$expand is deeper than {limit}")
    out = None
    for _ in range(max(1, levels)):
        nested = item.query.expand if out is None else (*item.query.expand, out)
        out = replace(item, levels=None, query=replace(item.query, expand=nested))
    return out


def expand(
    df: DataFrame, spec: EntitySpec, items: tuple[Expand, ...], tr: Translator, limit: int, depth: int = 1, path: tuple[str, ...] = (), page: DataFrame | None = None, small: bool = False
) -> DataFrame:
    """df with one column for each navigation, and `nav@odata.count` where asked for.

    page: the rows that df is made of, where paging left few of all; only their children are ranked and
    gathered then. small: it has at most max_top rows, and its keys are broadcast.
    """
    if items and depth > limit:
        raise ValidationError(f"$expand is deeper than {limit}")
    for item in items:
        nav = tr.registry.nav(spec, item.nav)
        if nav is None:
            raise ValidationError(f"{spec.name} has no navigation {item.nav!r}", target=item.nav)
        target = tr.registry.target(nav)
        item = unroll(item, target.name == spec.name, limit, depth)
        q, here = item.query, (*path, item.nav)
        if not nav.many and (item.count_only or q.count):
            raise ValidationError(f"$count of {item.nav}, which is not a collection", target=item.nav)
        child = tr.registry.df(target, "expand", here, tr.request)
        if q.filter is not None:
            child = tr.where(child, target, q.filter, allow_it=False)
        if q.search is not None:
            child = tr.search(child, target, q.search)
        own = list(child.columns)
        keys = [f"__{len(here)}_{i}" for i in range(len(nav.on))]
        if nav.through is not None:
            j, c = tr.new_alias("junction"), tr.new_alias(nav.name)
            pairs = nav.through(tr.registry.spark).select(*{x for _, x in nav.on} | {x for x, _ in nav.via}).distinct()
            pairs = _of_page(pairs, page, small, list(nav.on))
            child = pairs.alias(j).join(child.alias(c), all_of([F.col(f"{j}.{a}") == F.col(f"{c}.{b}") for a, b in nav.via]))
            child = child.select(*[F.col(f"{c}.{x}") for x in own], *[F.col(f"{j}.{b}").alias(k) for k, (_, b) in zip(keys, nav.on)])
        else:
            child = child.select(*own, *[F.col(b).alias(k) for k, (_, b) in zip(keys, nav.on)])
            child = _of_page(child, page, small, [(a, k) for k, (a, _) in zip(keys, nav.on)])
        counts = child.groupBy(*keys).agg(F.count("*").alias("__count")) if nav.many and (q.count or item.count_only) else None
        names = list(df.columns)
        if not item.count_only:
            if nav.many and (q.top is not None or q.skip or q.orderby):
                ranked = tr.order(child, target, q.orderby)
                child = child.alias(tr._order_alias).withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranked)))
                skip = q.skip or 0
                if q.top is not None:
                    child = child.where(F.col("__rn") <= skip + q.top)
                if skip:
                    child = child.where(F.col("__rn") > skip)
            sort = ["__rn"] if "__rn" in child.columns else [F.col(k).alias(f"__k{i}") for i, k in enumerate(target.key)]
            child = expand(child, target, q.expand, tr, limit, depth + 1, here, None if page is None else child)
            shown = _shown(tr, target, own, q, child.columns)
            row = F.struct(*[F.col(f"`{x}`") for x in shown])
            if nav.many:
                child = child.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*sort).alias("at"), row.alias("row")))), lambda x: x["row"]).alias("__nav"))
            else:
                child = child.select(*keys, row.alias("__nav"))
            df = _attach(df, child, nav, keys, names, F.coalesce(F.col("__nav"), F.array()) if nav.many else F.col("__nav"), item.nav)
            names = list(df.columns)
        if counts is not None:
            df = _attach(df, counts, nav, keys, names, F.coalesce("__count", F.lit(0)), f"{item.nav}@odata.count")
    return df


def _of_page(rows: DataFrame, page: DataFrame | None, small: bool, on: list[tuple[str, str]]) -> DataFrame:
    """Those rows that a row of the page has the keys of; on: columns of the page and of rows."""
    if page is None:
        return rows
    names = [f"__page_{i}" for i in range(len(on))]
    keys = page.select(*[F.col(f"`{a}`").alias(n) for n, (a, _) in zip(names, on)])
    return rows.join(F.broadcast(keys) if small else keys, all_of([F.col(b) == F.col(n) for n, (_, b) in zip(names, on)]), "left_semi")


def _attach(df, child, nav, keys, names, column, name):
    p = "__parent"
    on = all_of([F.col(f"{p}.{a}") == F.col(k) for k, (a, _) in zip(keys, nav.on)])
    return df.alias(p).join(child, on, "left").select(*[F.col(f"{p}.`{x}`") for x in names], column.alias(name))


def _shown(tr: Translator, spec: EntitySpec, own: list[str], q, columns: list[str]) -> list[str]:
    extra = [c for c in columns if c not in own and not c.startswith("__")]
    if q.select is None:
        return [*own, *extra]
    for name in q.select:
        tr.registry.property(spec, name)
    return [*dict.fromkeys([*q.select, *spec.key]), *extra]
