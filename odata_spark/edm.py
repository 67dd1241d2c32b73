"""The entity data model: sets, navigations, options, and the registry that hands out scoped DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ODataError, ValidationError

#: Spark type -> EDM type.
EDM_TYPES = {
    "tinyint": "Edm.SByte", "smallint": "Edm.Int16", "int": "Edm.Int32", "bigint": "Edm.Int64", "float": "Edm.Single", "double": "Edm.Double",
    "string": "Edm.String", "boolean": "Edm.Boolean", "date": "Edm.Date", "timestamp": "Edm.DateTimeOffset", "timestamp_ntz": "Edm.DateTimeOffset", "binary": "Edm.Binary",
}
#: EDM type -> Spark type, for overrides.
SPARK_TYPES = {v: k for k, v in EDM_TYPES.items() if k != "timestamp"} | {"Edm.Byte": "smallint", "Edm.Guid": "string", "Edm.TimeOfDay": "string"}


@dataclass(frozen=True)
class Nav:
    """An edge to another entity type.

    on: pairs (own property, target property). Many-to-many: through gives a junction,
    on pairs own with junction columns, and via junction with target columns.
    """

    name: str
    target: str
    on: tuple[tuple[str, str], ...]
    many: bool = False
    through: Callable[[SparkSession], DataFrame] | None = None
    via: tuple[tuple[str, str], ...] = ()
    nullable: bool = True
    partner: str | None = None


@dataclass(frozen=True)
class EntitySpec:
    """A set and its type. `source` gives the raw DataFrame; `scope(df, ctx)` restricts its rows."""

    name: str
    key: tuple[str, ...]
    source: Callable[[SparkSession], DataFrame]
    set_name: str | None = None
    columns: dict[str, str] = field(default_factory=dict)  # property -> column, where they differ
    exclude: frozenset[str] = frozenset()
    overrides: dict[str, str] = field(default_factory=dict)  # property -> Edm type, with (p,s) or (n)
    computed: frozenset[str] = frozenset()
    defaults: dict[str, Any] = field(default_factory=dict)
    searchable: tuple[str, ...] = ()
    navs: tuple[Nav, ...] = ()
    etag: str | Callable | None = None
    require_if_match: bool = False
    read_only: bool = False
    view: tuple[str, ...] = ()  # of a projection: the properties shown
    scope: Callable[[DataFrame, "ScopeContext"], DataFrame] | None = None
    unscoped: bool = False
    search: Callable | None = None
    max_top: int | None = None
    max_expand_depth: int | None = None
    max_filter_depth: int | None = None
    unmapped: str = "skip"  # skip, string-fallback or error
    handlers: dict[str, Callable] | None = None

    @property
    def set(self) -> str:
        return self.set_name or pluralize(self.name)


@dataclass(frozen=True)
class ScopeContext:
    set_name: str
    type_name: str
    operation: str  # read, count, by-key, expand, lambda, navigation, write
    path: tuple[str, ...] = ()
    request: Any = None


@dataclass(frozen=True)
class ServiceOptions:
    namespace: str = "Default"
    root: str = "/odata"
    max_top: int = 1000
    max_expand_depth: int = 2
    max_filter_depth: int = 10
    max_deep_insert_depth: int = 5
    require_scope: bool = False
    ignore_unknown: bool = False
    error_language: str = "en"
    list_properties: bool = False  # name the properties there are in 400 details
    batch: bool = True
    batch_timeout_s: float = 30.0
    batch_allowed: Callable[[str, str], bool] | None = None
    error_mapper: Callable[[Exception], ODataError | None] | None = None


def pluralize(name: str) -> str:
    """English plural of a type name."""
    if re.search(r"[^aeiou]y$", name, re.I):
        return name[:-1] + "ies"
    return name + ("es" if re.search(r"(s|x|z|ch|sh)$", name, re.I) else "s")


class Registry:
    """Types by name, sets by name. Every scan of any query goes through df()."""

    def __init__(self, spark: SparkSession, specs: list[EntitySpec], options: ServiceOptions = ServiceOptions()):
        self.spark, self.options = spark, options
        self.types: dict[str, EntitySpec] = {}
        self.sets: dict[str, EntitySpec] = {}
        self._raw: dict[str, DataFrame] = {}
        self.overlay: dict[str, DataFrame] = {}  # staged by a changeset
        for spec in specs:
            self.register(spec)

    def register(self, spec: EntitySpec) -> None:
        known = self.types.get(spec.name)
        if known is not None and known != spec:
            raise ValueError(f"another type is registered as {spec.name}")
        if self.options.require_scope and spec.scope is None and not spec.unscoped:
            raise ValueError(f"{spec.set} needs a scope")
        self.types[spec.name] = self.sets[spec.set] = spec

    def spec(self, set_name: str) -> EntitySpec:
        if set_name not in self.sets:
            raise ODataError(f"no entity set {set_name}", 404)
        return self.sets[set_name]

    def target(self, nav: Nav) -> EntitySpec:
        return self.types[nav.target]

    def nav(self, spec: EntitySpec, name: str) -> Nav | None:
        return next((n for n in spec.navs if n.name == name), None)

    def raw(self, spec: EntitySpec) -> DataFrame:
        """Exposed columns under their property names, with overrides cast; unscoped."""
        if spec.set in self.overlay:
            return self.overlay[spec.set]
        if spec.set not in self._raw:
            df = spec.source(self.spark)
            names = {c: p for p, c in spec.columns.items()}
            out = []
            for f in df.schema.fields:
                prop = names.get(f.name, f.name)
                if prop in spec.exclude or f.name in spec.exclude or spec.view and prop not in (*spec.view, *spec.key):
                    continue
                col = F.col(f"`{f.name}`")
                if prop in spec.overrides:
                    col = col.cast(spark_type(spec.overrides[prop]))
                elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                    if spec.unmapped == "skip":
                        continue
                    if spec.unmapped == "error":
                        raise ValueError(f"{spec.name}.{prop} has no EDM type")
                    col = F.to_json(col)
                out.append(col.alias(prop))
            self._raw[spec.set] = df.select(*out)
        return self._raw[spec.set]

    def refresh(self, spec: EntitySpec) -> None:
        self._raw.pop(spec.set, None)

    def df(self, spec: EntitySpec, operation: str = "read", path: tuple[str, ...] = (), request: Any = None) -> DataFrame:
        df = self.raw(spec)
        if spec.scope is None:
            if self.options.require_scope and not spec.unscoped:
                raise ODataError(f"{spec.set} has no scope", 500)
            return df
        return spec.scope(df, ScopeContext(spec.set, spec.name, operation, path, request))

    def properties(self, spec: EntitySpec) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.raw(spec).schema.fields}

    def property(self, spec: EntitySpec, name: str) -> T.DataType:
        found = self.properties(spec)
        if name not in found:
            details = [{"code": "AvailableProperties", "message": ", ".join(found)}] if self.options.list_properties else []
            raise ValidationError(f"{spec.name} has no property {name!r}", target=name, details=details)
        return found[name]


def spark_type(edm: str) -> str:
    m = re.fullmatch(r"(Edm\.\w+)(?:\((\d+)(?:,(\d+))?\))?", edm)
    if not m or m[1] not in SPARK_TYPES and m[1] != "Edm.Decimal":
        raise ValueError(f"unknown type {edm}")
    if m[1] == "Edm.Decimal":
        return f"decimal({m[2] or 38},{m[3] or 0})" if m[2] else "decimal(38,18)"
    return SPARK_TYPES[m[1]]


def edm_type(kind: T.DataType, override: str | None = None) -> str:
    if override:
        return override.split("(")[0]
    if isinstance(kind, T.DecimalType):
        return "Edm.Decimal"
    return EDM_TYPES.get(kind.simpleString(), "Edm.String")
