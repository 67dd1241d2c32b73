"""The service: queries as DataFrames, and requests as responses."""

from __future__ import annotations

import json
import re
from contextvars import ContextVar
from dataclasses import dataclass, field, replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metadata, response, write
from .ast import ODataQuery
from .edm import EntitySpec, Registry
from .errors import ODataError, ParseError, ValidationError
from .parser import parse_query_options, parse_query_string
from .plans import check_limits, plan
from .sources import LOCK, SnapshotStore

REQUEST: ContextVar[Any] = ContextVar("request", default=None)


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: Any = None  # dict, str or None

    def text(self) -> str:
        return "" if self.body is None else self.body if isinstance(self.body, str) else response.dumps(self.body)


def split_segments(path: str) -> list[str]:
    """At slashes outside of quotes."""
    out, quote, cur = [], False, ""
    for c in path:
        if c == "'":
            quote = not quote
        if c == "/" and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [x for x in [*out, cur] if x]


def parse_key(text: str, spec: EntitySpec) -> dict[str, str]:
    """`7`, `'a''b'` or `x=1,y='b'`; values as written, quotes undone."""
    parts = re.findall(r"\s*(?:([A-Za-z_]\w*)\s*=\s*)?('(?:[^']|'')*'|[^,'=]+)\s*(?:,|$)", text)
    if not parts or "".join("".join(p) for p in parts).replace(" ", "") != re.sub(r",(?=(?:[^']*'[^']*')*[^']*$)|=(?=(?:[^']*'[^']*')*[^']*$)|\s", "", text):
        raise ParseError(f"bad key {text!r}")
    undo = lambda v: v[1:-1].replace("''", "'") if v.startswith("'") else v.strip()
    if len(parts) == 1 and not parts[0][0] and len(spec.key) == 1:
        return {spec.key[0]: undo(parts[0][1])}
    found = {n: undo(v) for n, v in parts}
    if set(found) != set(spec.key) or len(parts) != len(spec.key):
        raise ValidationError(f"the key of {spec.name} is {', '.join(spec.key)}")
    return found


class Service:
    def __init__(self, registry: Registry, store: SnapshotStore | None = None):
        self.registry, self.store = registry, store
        self.options = registry.options
        self._csdl: str | None = None
        self._staged: dict[str, DataFrame] | None = None

    # -- DataFrames

    def query(self, set_name: str, options: dict[str, str] | str | None = None, request: Any = None) -> DataFrame:
        """The set under the options, lazily and without a page limit."""
        parsed = parse_query_string(options) if isinstance(options, str) else parse_query_options(options or {})
        return plan(self.registry, self.registry.spec(set_name), parsed, request).df

    def count(self, set_name: str, options: dict[str, str] | None = None, request: Any = None) -> DataFrame:
        """One row, cnt."""
        parsed = parse_query_options(options or {})
        kept = ODataQuery(filter=parsed.filter, search=parsed.search)
        return plan(self.registry, self.registry.spec(set_name), kept, request, "count").df.agg(F.count("*").alias("cnt"))

    def by_key(self, set_name: str, key: Any, request: Any = None) -> DataFrame:
        spec = self.registry.spec(set_name)
        key = key if isinstance(key, dict) else {spec.key[0]: key}
        return self.registry.df(spec, "by-key", (), request).where(write.matches(spec, self.registry, _typed(self.registry, spec, key)))

    def etags(self, set_name: str, request: Any = None) -> DataFrame:
        """Key columns and etag of every row."""
        spec = self.registry.spec(set_name)
        df = self.registry.df(spec, "read", (), request)
        return df.select(*spec.key, response.etag_column(F.col(spec.etag), df.schema[spec.etag].dataType).alias("etag"))

    # -- requests

    def handle(self, method: str, url: str, headers: dict[str, str] | None = None, body: Any = None, request: Any = None) -> Response:
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        token = REQUEST.set(request)
        try:
            out = self._route(method.upper(), url, headers, body, request)
        except Exception as e:  # every failure is an OData error
            out = self.failure(e)
        finally:
            REQUEST.reset(token)
        out.headers.setdefault("OData-Version", "4.0")
        if isinstance(out.body, dict):
            out.headers.setdefault("Content-Type", "application/json;odata.metadata=minimal")
        return out

    def failure(self, e: Exception) -> Response:
        mapped = self.options.error_mapper(e) if self.options.error_mapper else None
        error = mapped or (e if isinstance(e, ODataError) else ODataError(str(e)))
        return Response(error.status, {"Content-Language": self.options.error_language} | error.headers, error.body())

    def _route(self, method: str, url: str, headers: dict, body: Any, request: Any) -> Response:
        path, _, query = url.partition("?")
        if path.rstrip("/") != self.options.root and not path.startswith(self.options.root + "/"):
            raise ODataError("not found", 404)
        rest = path[len(self.options.root) :]
        if rest.strip("/") == "":
            self._only(method, "GET")
            return Response(200, body=metadata.service_document(self.registry))
        segments = [unquote(s) for s in split_segments(rest)]
        if segments == ["$metadata"]:
            self._only(method, "GET")
            self._csdl = self._csdl or metadata.csdl(self.registry)
            return Response(200, {"Content-Type": "application/xml"}, self._csdl)
        if segments == ["$batch"]:
            from .batch import run_batch

            if not self.options.batch:
                raise ODataError("not found", 404)
            self._only(method, "POST")
            return run_batch(self, headers, body, request)
        m = re.fullmatch(r"(\w+)(?:\((.*)\))?", segments[0], re.S)
        if not m:
            raise ODataError("not found", 404)
        spec = self.registry.spec(m[1])
        if m[2] is None and len(segments) == 2 and segments[1] == "$count":
            self._only(method, "GET")
            kept = parse_query_string(query)
            n = plan(self.registry, spec, ODataQuery(filter=kept.filter, search=kept.search), request, "count").df.count()
            return Response(200, {"Content-Type": "text/plain"}, str(n))
        key = m[2] if m[2] is not None else segments[1] if len(segments) == 2 else None
        if len(segments) > (1 if m[2] is not None else 2):
            raise ODataError("not found", 404)
        if key is None:
            if method == "GET":
                return self._collection(spec, path, query, request)
            self._only(method, "POST", "GET, POST")
            return self._create(spec, headers, body, request)
        key = _typed(self.registry, spec, parse_key(key, spec))
        if method == "GET":
            return self._entity(spec, key, query, headers, request)
        if method in ("PATCH", "PUT", "DELETE"):
            return self._change(method, spec, key, headers, body, request)
        raise ODataError("method not allowed", 405, headers={"Allow": "GET, PATCH, PUT, DELETE"})

    @staticmethod
    def _only(method: str, allowed: str, header: str | None = None) -> None:
        if method != allowed:
            raise ODataError("method not allowed", 405, headers={"Allow": header or allowed})

    def _collection(self, spec: EntitySpec, path: str, query: str, request: Any) -> Response:
        parsed = parse_query_string(query)
        check_limits(parsed, spec, self.registry)
        most = spec.max_top or self.options.max_top
        size = min(most if parsed.top is None else parsed.top, most)
        planned = plan(self.registry, spec, parsed, request, limit=size + 1)
        rows = planned.df.take(size + 1)  # one more than the page tells whether there is another
        more, rows = len(rows) > size, [response.plain(r) for r in rows[:size]]
        columns = tuple(planned.df.columns) if planned.aggregated else parsed.select
        out = {"@odata.context": response.context(self.options.root, spec.set, columns)}
        if parsed.count:
            out["@odata.count"] = planned.all_rows.count()
        out["value"] = rows if planned.aggregated else [response.annotate(self.registry, spec, r) for r in rows]
        if more and parsed.top is None:
            out["@odata.nextLink"] = response.next_link(path, query, (parsed.skip or 0) + size, size)
        return Response(200, body=out)

    def _entity(self, spec: EntitySpec, key: dict, query: str, headers: dict, request: Any) -> Response:
        parsed = parse_query_string(query)
        row = self._row(spec, key, request, parsed)
        full = row if isinstance(spec.etag, str) and spec.etag in row else self._row(spec, key, request)
        tag = response.row_etag(spec, full)
        if tag and "if-none-match" in headers and write.tag_matches(headers["if-none-match"], tag):
            return Response(304, {"ETag": tag})
        body = {"@odata.context": response.context(self.options.root, spec.set, parsed.select, True)} | response.annotate(self.registry, spec, row)
        return Response(200, {"ETag": tag} if tag else {}, body)

    def _row(self, spec: EntitySpec, key: dict, request: Any, query: ODataQuery = ODataQuery(), operation: str = "by-key") -> dict:
        keyed = _Keyed(self.registry, spec, write.matches(spec, self.registry, key))
        found = plan(keyed, spec, ODataQuery(select=query.select, expand=query.expand), request, operation).df.take(1)
        if not found:
            raise ODataError(f"no such {spec.name}", 404)
        return response.plain(found[0])

    # -- writes

    def commit(self, frames: dict[str, DataFrame]) -> None:
        """Now, or with the changeset that is open."""
        if self._staged is not None:
            self._staged |= frames
            self.registry.overlay |= frames
            return
        if self.store is None:
            raise ODataError("the service is read-only", 405)
        self.store.commit(frames)
        for name in frames:
            self.registry.refresh(self.registry.sets[name])

    def _writable(self, spec: EntitySpec, what: str) -> Any:
        if spec.handlers is not None:
            if what not in spec.handlers:
                names = {"create": "POST", "update": "PATCH", "replace": "PUT", "delete": "DELETE"}
                raise ODataError("method not allowed", 405, headers={"Allow": ", ".join(["GET", *(v for k, v in names.items() if k in spec.handlers)])})
            return spec.handlers[what]
        if spec.read_only or self.store is None:
            raise ODataError(f"{spec.set} is read-only", 405, headers={"Allow": "GET"})
        return None

    def _create(self, spec: EntitySpec, headers: dict, body: Any, request: Any) -> Response:
        body = json.loads(body) if isinstance(body, (str, bytes)) else body
        own, related = write.body_of(self.registry, spec, body, False)
        handler = self._writable(spec, "deepInsert" if related and spec.handlers and "deepInsert" in spec.handlers else "create")
        with LOCK:
            if handler:
                row = handler(own | related, request)
            else:
                frames: dict[str, DataFrame] = {}
                self._insert(spec, own, related, frames, 1)
                self.commit(frames)
                row = self._row(spec, {k: own[k] for k in spec.key}, request, operation="write")
        return self._written(201, spec, row, headers)

    def _insert(self, spec: EntitySpec, own: dict, related: dict, frames: dict, depth: int) -> None:
        """Parent first, then its children with the foreign key set; all in one commit."""
        if depth > self.options.max_deep_insert_depth:
            raise ValidationError(f"deep insert is deeper than {self.options.max_deep_insert_depth}")
        before = dict(self.registry.overlay)
        try:
            self.registry.overlay |= frames
            frames[spec.set] = write.created(self.registry, spec, own)
            for name, value in related.items():
                nav = self.registry.nav(spec, name)
                target = self.registry.target(nav)
                if not nav.many or nav.through is not None or not isinstance(value, list):
                    raise ValidationError(f"{name} cannot be inserted with its parent", target=name)
                for i, item in enumerate(value):
                    try:
                        child, more = write.body_of(self.registry, target, item, False)
                        child |= {b: own[a] for a, b in nav.on}
                        self._insert(target, child, more, frames, depth + 1)
                    except ODataError as e:
                        raise ODataError(f"{name}[{i}]: {e.message}", 400 if e.status < 500 else e.status, target=f"{name}[{i}]", details=e.details) from e
        finally:
            self.registry.overlay = before

    def _change(self, method: str, spec: EntitySpec, key: dict, headers: dict, body: Any, request: Any) -> Response:
        what = {"PATCH": "update", "PUT": "replace", "DELETE": "delete"}[method]
        handler = self._writable(spec, what)
        with LOCK:
            row = self._row(spec, key, request, operation="write")
            write.precondition(spec, headers, response.row_etag(spec, row))
            if method == "DELETE":
                handler(key, request) if handler else self.commit({spec.set: write.deleted(self.registry, spec, key)})
                return Response(204)
            body = json.loads(body) if isinstance(body, (str, bytes)) else body
            own, _ = write.body_of(self.registry, spec, body, True)
            if handler:
                row = handler(key, own, request)
            else:
                self.commit({spec.set: write.updated(self.registry, spec, key, own, method == "PUT")})
                row = self._row(spec, key, request, operation="write")
        return self._written(200, spec, row, headers)

    def _written(self, status: int, spec: EntitySpec, row: dict, headers: dict) -> Response:
        out = Response(status)
        if tag := response.row_etag(spec, row):
            out.headers["ETag"] = tag
        if status == 201:
            out.headers["Location"] = f"{self.options.root}/{spec.set}({response.key_text(spec, row)})"
        prefer = response.preference(headers.get("prefer"))
        if prefer:
            out.headers["Preference-Applied"] = f"return={prefer}"
        if prefer == "minimal":
            if status == 201:
                out.headers["OData-EntityId"] = out.headers["Location"]
            out.status = 204
            return out
        out.body = {"@odata.context": response.context(self.options.root, spec.set, None, True)} | response.annotate(self.registry, spec, row)
        return out


class _Keyed:
    """A registry whose root set has one row: the key's condition reaches the scan before anything else."""

    def __init__(self, registry: Registry, spec: EntitySpec, condition):
        self._registry, self._spec, self._condition = registry, spec, condition

    def __getattr__(self, name: str):
        return getattr(self._registry, name)

    def df(self, spec: EntitySpec, operation: str = "read", path: tuple[str, ...] = (), request: Any = None) -> DataFrame:
        df = self._registry.df(spec, operation, path, request)
        return df.where(self._condition) if spec is self._spec and not path else df


def _typed(registry: Registry, spec: EntitySpec, key: dict) -> dict:
    kinds = registry.properties(spec)
    out = {}
    for name in spec.key:
        value = key[name]
        if isinstance(value, str) and kinds[name].simpleString() == "boolean":
            value = value == "true"
        out[name] = write.coerce(value, kinds[name], name)
    return out
