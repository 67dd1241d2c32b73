"""Rows to OData JSON."""

from __future__ import annotations

import base64
import json
import math
import re
from datetime import date, datetime
from decimal import Decimal
from typing import Any
from urllib.parse import parse_qsl, quote, urlencode

from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edm import EntitySpec, Registry


def plain(value: Any) -> Any:
    """A JSON value."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, datetime):
        return iso(value)
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.urlsafe_b64encode(bytes(value)).decode()
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "INF" if value > 0 else "-INF"
    return value


def iso(value: datetime) -> str:
    return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"


def etag_of(value: Any) -> str | None:
    if value is None:
        return None
    text = iso(value) if isinstance(value, datetime) else str(value)
    return f'W/"{base64.b64encode(text.encode()).decode()}"'


def etag_column(column: Column, kind: T.DataType) -> Column:
    """The same on whole columns."""
    text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else column.cast("string")
    return F.concat(F.lit('W/"'), F.base64(F.encode(text, "UTF-8")), F.lit('"'))


def key_text(spec: EntitySpec, row: dict) -> str:
    """The key as it stands in a URL: strings quoted, quotes doubled, all percent-encoded."""

    def one(v: Any) -> str:
        return "'" + quote(v.replace("'", "''"), safe="") + "'" if isinstance(v, str) else quote(str(plain(v)), safe="")

    if len(spec.key) == 1:
        return one(row[spec.key[0]])
    return ",".join(f"{k}={one(row[k])}" for k in spec.key)


def context(root: str, set_name: str, columns: tuple[str, ...] | None = None, single: bool = False) -> str:
    return f"{root}/$metadata#{set_name}" + (f"({','.join(columns)})" if columns else "") + "/$entity" * single


def annotate(registry: Registry, spec: EntitySpec, row: dict) -> dict:
    """@odata.id, @odata.type, @odata.etag and navigation links of a root entity."""
    root, out = registry.options.root, {}
    if all(k in row for k in spec.key):
        out["@odata.id"] = f"{root}/{spec.set}({key_text(spec, row)})"
        out["@odata.type"] = f"#{registry.options.namespace}.{spec.name}"
        for nav in spec.navs:
            if nav.name not in row:
                out[f"{nav.name}@odata.navigationLink"] = f"{out['@odata.id']}/{nav.name}"
    if tag := row_etag(spec, row):
        out["@odata.etag"] = tag
    return out | row


def row_etag(spec: EntitySpec, row: dict) -> str | None:
    if callable(spec.etag):
        return etag_of(spec.etag(row))
    return etag_of(row.get(spec.etag)) if spec.etag else None


def next_link(path: str, query: str, skip: int, top: int) -> str:
    """The same request further on; other parameters stay."""
    kept = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in ("$skip", "$top")]
    return path + "?" + urlencode([*kept, ("$top", top), ("$skip", skip)], quote_via=quote, safe="$(),/'")


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=plain)


def preference(header: str | None) -> str | None:
    m = re.search(r"(?:^|[,;\s])return\s*=\s*\"?(minimal|representation)\b", header or "", re.I)
    return m[1].lower() if m else None
