"""Create, update, replace and delete as DataFrame derivations of a set's current snapshot."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edm import EntitySpec, Registry
from .errors import ODataError, ValidationError


def body_of(registry: Registry, spec: EntitySpec, body: Any, update: bool) -> tuple[dict, dict]:
    """Own properties, and related entities by navigation. Annotations and computed properties go; keys go on updates."""
    if not isinstance(body, dict):
        raise ValidationError("the body must be an object")
    kinds, own, related, unknown = registry.properties(spec), {}, {}, []
    for name, value in body.items():
        if "@" in name:
            continue
        if name in kinds:
            if name in spec.computed or update and name in spec.key:
                continue
            own[name] = coerce(value, kinds[name], name)
        elif registry.nav(spec, name):
            related[name] = value
        elif not registry.options.ignore_unknown:
            unknown.append(name)
    if unknown:
        raise ValidationError(f"unknown properties of {spec.name}", details=[{"code": "UnknownProperty", "target": n, "message": f"no property {n!r}"} for n in unknown])
    return own, related


def coerce(value: Any, kind: T.DataType, name: str) -> Any:
    """A Python value that fits the column."""
    try:
        if value is None:
            return None
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            at = datetime.fromisoformat(value)
            return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
        if isinstance(kind, T.DateType):
            return datetime.fromisoformat(value).date()
        if isinstance(kind, T.BooleanType):
            if not isinstance(value, bool):
                raise ValueError
            return value
        if isinstance(kind, T.IntegralType):
            if isinstance(value, bool) or int(value) != float(value):
                raise ValueError
            return int(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            if isinstance(value, bool):
                raise ValueError
            return float(value)
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            return round(Decimal(str(value)), kind.scale)
        if isinstance(kind, T.BinaryType):
            import base64

            return base64.urlsafe_b64decode(value)
        if not isinstance(value, str):
            raise ValueError
        return value
    except (ValueError, TypeError, ArithmeticError):
        raise ValidationError(f"bad value of {name}", target=name) from None


def literal(value: Any, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


def matches(spec: EntitySpec, registry: Registry, key: dict) -> Column:
    kinds, out = registry.properties(spec), F.lit(True)
    for name in spec.key:
        out = out & (F.col(name) == literal(coerce(key[name], kinds[name], name), kinds[name]))
    return out


def created(registry: Registry, spec: EntitySpec, own: dict) -> DataFrame:
    """The current rows and the new one."""
    missing = [k for k in spec.key if own.get(k) is None]
    if missing:
        raise ValidationError(f"a new {spec.name} needs {', '.join(missing)}")
    df = registry.raw(spec)
    if not df.where(matches(spec, registry, own)).isEmpty():
        raise ODataError(f"there is already such a {spec.name}", 409)
    new = full_row(registry, spec, own)
    return df.unionByName(registry.spark.createDataFrame([tuple(new[f.name] for f in df.schema)], df.schema))


def full_row(registry: Registry, spec: EntitySpec, own: dict) -> dict:
    """Body over defaults over null; computed times are now."""
    row = {}
    for name, kind in registry.properties(spec).items():
        if name in own:
            row[name] = own[name]
        elif name in spec.computed and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            row[name] = datetime.now(UTC).replace(tzinfo=None)
        elif name in spec.computed and isinstance(kind, T.IntegralType):
            row[name] = 1
        else:
            row[name] = coerce(spec.defaults.get(name), kind, name)
    return row


def updated(registry: Registry, spec: EntitySpec, key: dict, own: dict, replace: bool) -> DataFrame:
    """PATCH merges; PUT sets every unmanaged property from the body, its default or null."""
    df, hit = registry.raw(spec), matches(spec, registry, key)
    kinds = registry.properties(spec)
    if replace:
        own = {n: own.get(n, coerce(spec.defaults.get(n), k, n)) for n, k in kinds.items() if n not in spec.key and n not in spec.computed}
    changes = {n: literal(v, kinds[n]) for n, v in own.items()}
    if isinstance(spec.etag, str) and spec.etag in spec.computed:  # managed: moves on with each write
        kind = kinds[spec.etag]
        changes[spec.etag] = F.col(spec.etag) + 1 if isinstance(kind, T.IntegralType) else literal(datetime.now(UTC).replace(tzinfo=None), kind)
    return df.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def deleted(registry: Registry, spec: EntitySpec, key: dict) -> DataFrame:
    return registry.raw(spec).where(~matches(spec, registry, key))


def tag_matches(header: str, tag: str | None) -> bool:
    """Weak comparison with a list of entity tags, or *."""
    weak = lambda x: x[2:] if x.startswith("W/") else x
    if header.strip() == "*":
        return True
    return tag is not None and weak(tag) in [weak(x) for x in re.findall(r'(?:W/)?"[^"]*"', header)]


def precondition(spec: EntitySpec, headers: dict, tag: str | None) -> None:
    given = headers.get("if-match")
    if given is None and spec.require_if_match:
        raise ODataError("If-Match is required", 428)
    if given is not None and not tag_matches(given, tag):
        raise ODataError("the entity has changed", 412)
    if "if-none-match" in headers and tag_matches(headers["if-none-match"], tag):
        raise ODataError("the entity exists", 412)
