"""$batch: multipart requests, changesets, Content-ID references."""

from __future__ import annotations

import re
from email.message import Message
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from typing import Any

from .errors import ODataError, ParseError
from .service import Response, Service

MAX_OPERATIONS, MAX_BYTES = 100, 10 * 1024 * 1024


@dataclass
class Operation:
    method: str
    url: str
    headers: dict[str, str]
    body: str
    content_id: str | None = None


@dataclass
class Changeset:
    operations: list[Operation] = field(default_factory=list)


def _headers(text: str) -> dict[str, str]:
    out = {}
    for line in text.split("\n"):
        if line.strip():
            name, colon, value = line.partition(":")
            if not colon:
                raise ParseError(f"bad header line {line.strip()!r}")
            out[name.strip().lower()] = value.strip()
    return out


def _boundary(content_type: str) -> str:
    message = Message()
    message["Content-Type"] = " ".join((content_type or "").split())
    found = message.get_boundary()
    if not found or message.get_content_type() != "multipart/mixed":
        raise ParseError("multipart/mixed with a boundary is needed")
    return found


def _parts(text: str, boundary: str) -> list[tuple[dict, str]]:
    chunks = re.split(rf"(?:^|\n)--{re.escape(boundary)}(--)?[ \t]*(?=\n|$)", text)
    if "--" not in chunks[2::2] + chunks[1::2]:
        raise ParseError("the batch has no end")
    out = []
    for i in range(2, len(chunks), 2):
        if chunks[i - 1] == "--":
            break
        head, gap, body = chunks[i].lstrip("\n").partition("\n\n")
        out.append((_headers(head), body if gap else ""))
    return out


def _operation(headers: dict, body: str) -> Operation:
    if not headers.get("content-type", "").lower().startswith("application/http"):
        raise ParseError("a part must be application/http")
    first, _, rest = body.lstrip("\n").partition("\n")
    m = re.fullmatch(r"([A-Z]+)\s+(\S+)(?:\s+HTTP/1\.[01])?\s*", first)
    if not m:
        raise ParseError(f"bad request line {first!r}")
    head, _, content = rest.partition("\n\n") if not rest.startswith("\n") else ("", "", rest[1:])
    inner = _headers(head)
    return Operation(m[1], m[2], inner, content.strip("\n"), headers.get("content-id") or inner.get("content-id"))


def parse_batch(text: str, content_type: str) -> list[Operation | Changeset]:
    if len(text.encode()) > MAX_BYTES:
        raise ODataError("the batch is too large", 413)
    out: list[Operation | Changeset] = []
    for headers, body in _parts(text.replace("\r\n", "\n"), _boundary(content_type)):
        kind = headers.get("content-type", "")
        if kind.lower().startswith("multipart/mixed"):
            operations = [_operation(h, b) for h, b in _parts(body, _boundary(kind))]
            if any(o.method == "GET" for o in operations):
                raise ParseError("a changeset takes changes only")
            out.append(Changeset(operations))
        else:
            out.append(_operation(headers, body))
    if sum(len(x.operations) if isinstance(x, Changeset) else 1 for x in out) > MAX_OPERATIONS:
        raise ParseError(f"more than {MAX_OPERATIONS} operations")
    return out


def _refer(text: str, known: dict[str, str]) -> str:
    return re.sub(r"\$(\w+)", lambda m: known.get(m[1], m[0]), text)


def _dispatch(service: Service, op: Operation, inherited: dict, known: dict[str, str], request: Any) -> Response:
    root = service.options.root
    url = op.url
    first = re.match(r"/?\$(\w+)(?=/|$)", url)
    if first and first[1] in known:
        url = known[first[1]] + url[first.end() :]
    url = re.sub(r"^https?://[^/]+", "", url)
    if not url.startswith("/"):
        url = f"{root}/{url}"
    if not url.startswith(root + "/") or "/../" in url:
        return service.failure(ODataError("the address is outside of the service", 400))
    if re.match(rf"{re.escape(root)}/\$batch\b", url):
        return service.failure(ODataError("a batch inside a batch", 400))
    if service.options.batch_allowed and not service.options.batch_allowed(op.method, url):
        return service.failure(ODataError("not allowed in a batch", 403))
    body = _refer(op.body, known) if op.body else None
    call = lambda: service.handle(op.method, url, inherited | op.headers, body, request)
    if not service.options.batch_timeout_s:
        return call()
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(service.options.batch_timeout_s)
    except Late:
        return service.failure(ODataError("the operation took too long", 504))
    finally:
        pool.shutdown(wait=False)


def run_changeset(service: Service, changes: Changeset, inherited: dict, request: Any) -> list[tuple[Operation, Response]] | Response:
    """All or nothing: the first failure is the only answer."""
    known: dict[str, str] = {}
    out = []
    service._staged, before = {}, dict(service.registry.overlay)
    try:
        for op in changes.operations:
            r = _dispatch(service, op, inherited, known, request)
            if r.status >= 400:
                return r
            if op.content_id and "Location" in r.headers:
                known[op.content_id] = r.headers["Location"]
            out.append((op, r))
        frames, service._staged = service._staged, None
        service.registry.overlay = before
        if frames:
            service.commit(frames)
        return out
    finally:
        service._staged, service.registry.overlay = None, before


def _part(op: Operation | None, r: Response) -> str:
    lines = ["Content-Type: application/http", "Content-Transfer-Encoding: binary"]
    if op and op.content_id:
        lines.append(f"Content-ID: {op.content_id}")
    body = r.text()
    return "\r\n".join([*lines, "", f"HTTP/1.1 {r.status}", *(f"{k}: {v}" for k, v in r.headers.items()), "", body])


def _multipart(parts: list[str], boundary: str) -> str:
    return "".join(f"--{boundary}\r\n{p}\r\n" for p in parts) + f"--{boundary}--\r\n"


def run_batch(service: Service, headers: dict, body: Any, request: Any) -> Response:
    text = body.decode() if isinstance(body, bytes) else body or ""
    inherited = {k: v for k, v in headers.items() if k not in ("content-type", "content-length", "if-match", "if-none-match", "prefer")}
    parts = []
    for item in parse_batch(text, headers.get("content-type", "")):
        if isinstance(item, Operation):
            parts.append(_part(item, _dispatch(service, item, inherited, {}, request)))
            continue
        done = run_changeset(service, item, inherited, request)
        if isinstance(done, Response):
            parts.append(_part(None, done))
            continue
        inner = f"changesetresponse_{uuid.uuid4().hex}"
        parts.append(f"Content-Type: multipart/mixed; boundary={inner}\r\n\r\n" + _multipart([_part(o, r) for o, r in done], inner))
    boundary = f"batchresponse_{uuid.uuid4().hex}"
    return Response(200, {"Content-Type": f"multipart/mixed; boundary={boundary}"}, _multipart(parts, boundary))
