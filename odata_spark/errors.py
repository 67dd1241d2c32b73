"""Errors with the HTTP status they answer."""

from __future__ import annotations

CODES = {400: "BadRequest", 401: "Unauthorized", 403: "Forbidden", 404: "NotFound", 405: "MethodNotAllowed", 409: "Conflict", 412: "PreconditionFailed", 428: "PreconditionRequired", 500: "InternalServerError", 501: "NotImplemented", 504: "GatewayTimeout"}


class ODataError(Exception):
    """status, message, and optionally target, details and headers of the answer."""

    status = 500

    def __init__(self, message: str, status: int | None = None, target: str | None = None, details: list | None = None, headers: dict | None = None):
        super().__init__(message)
        self.message, self.target, self.details, self.headers = message, target, details or [], headers or {}
        if status:
            self.status = status

    def body(self) -> dict:
        hidden = self.status >= 500 and self.status != 501
        error = {"code": CODES.get(self.status, str(self.status)), "message": "Internal server error" if hidden else self.message}
        if self.target:
            error["target"] = self.target
        return {"error": error | {"details": self.details}}


class ParseError(ODataError):
    """Malformed option; `position` counts from 0."""

    status = 400

    def __init__(self, message: str, position: int | None = None, **more):
        super().__init__(message if position is None else f"{message} at position {position}", **more)
        self.position = position


class ValidationError(ODataError):
    """Well-formed, but against the model or the limits."""

    status = 400


class Unsupported(ODataError):
    """Valid OData that this service does not carry out."""

    status = 501
