"""What a domain tells about itself (manifest, OpenAPI), and reads by callers who were
built against one version of it."""

from __future__ import annotations

import hashlib
from typing import Any

from .api import Api
from .domain import Domain
from .errors import require
from .sinks import canonical_json
from .types import category

FORMAT, VERSION = "lodestone.remote-read", 1
JSON_TYPES = {
    "integer": {"type": "integer"},
    "decimal": {"type": "number"},
    "boolean": {"type": "boolean"},
    "date": {"type": "string", "format": "date"},
    "datetime": {"type": "string", "format": "date-time"},
    "json": {},
}
#: What a remote read may ask for: scalar fields of single rows.
ASKED = {"select", "filters", "order_by", "limit", "offset", "row_format"}
TESTS = {"eq", "ne", "gt", "gte", "lt", "lte", "is_null", "not_null"}


def fields(domain: Domain) -> list[dict[str, Any]]:
    """The public fields of the root."""
    return [{"field": c.name, "type": c.type, "category": category(c.type), "computed": c.computed is not None} for c in domain.root.columns.values() if domain.is_public(c.name)]


def fingerprint(domain: Domain) -> str:
    """Changes with anything that a caller can see of a domain's fields and relations."""
    seen = {"name": domain.name, "key": domain.primary_key, "fields": fields(domain), "associations": sorted(f"{a.name}:{a.queryable}:{a.cardinality}" for a in domain.root.associations.values())}
    return hashlib.sha256(canonical_json(seen).encode()).hexdigest()


def routes(base: str) -> list[dict[str, str]]:
    return [
        {"method": "get", "path": base, "operation": "describe"},
        {"method": "post", "path": f"{base}/query", "operation": "query"},
        {"method": "get", "path": f"{base}/rows/{{key}}", "operation": "row"},
    ]


def manifest(domain: Domain, base: str = "/") -> dict[str, Any]:
    base = base.rstrip("/")
    return {"format": FORMAT, "format_version": VERSION, "domain": {"name": domain.name, "primary_key": domain.primary_key, "fingerprint": fingerprint(domain)}, "fields": fields(domain), "routes": routes(base)}


def openapi(domain: Domain, base: str = "/") -> dict[str, Any]:
    """An OpenAPI 3.1 document of the routes, with the row as a schema."""
    row = {f["field"]: JSON_TYPES.get(f["category"], {"type": "string"}) for f in fields(domain)}
    body = {"type": "object", "properties": {"select": {"type": "array"}, "filters": {"type": "array"}, "order_by": {"type": "array"}, "limit": {"type": "integer", "minimum": 0}, "offset": {"type": "integer", "minimum": 0}}}
    answer = lambda schema: {"200": {"description": "the answer", "content": {"application/json": {"schema": schema}}}, "422": {"description": "a refusal with its code"}}
    of = {
        "describe": {"responses": answer({"type": "object"})},
        "query": {"requestBody": {"required": True, "content": {"application/json": {"schema": body}}}, "responses": answer({"type": "object", "properties": {"columns": {"type": "array"}, "rows": {"type": "array"}}})},
        "row": {"parameters": [{"name": "key", "in": "path", "required": True, "schema": row.get(domain.primary_key, {"type": "string"})}], "responses": answer({"$ref": "#/components/schemas/Row"})},
    }
    paths: dict[str, Any] = {}
    for r in routes(base.rstrip("/")):
        paths.setdefault(r["path"] or "/", {})[r["method"]] = {"operationId": r["operation"], **of[r["operation"]]}
    return {"openapi": "3.1.0", "info": {"title": domain.name, "version": fingerprint(domain)[:12]}, "paths": paths, "components": {"schemas": {"Row": {"type": "object", "properties": row}}}}


class RemoteReads:
    """Reads bound to a fingerprint: a caller built against another version of the
    domain is refused instead of answered by guess."""

    def __init__(self, api: Api):
        self.api, self.fingerprint = api, fingerprint(api.domain)

    def read(self, request: Any) -> dict[str, Any]:
        require(isinstance(request, dict) and request.keys() <= {"format", "format_version", "fingerprint", "query", "request_id"}, "malformed_request", "expected format, format_version, fingerprint and query")
        require(request.get("format") == FORMAT and isinstance(request.get("query"), dict), "malformed_request", "expected another format, or a query")
        require(request.get("format_version") == VERSION, "unsupported_protocol_version", "only version 1 is spoken here")
        require(request.get("fingerprint") == self.fingerprint, "stale_domain_fingerprint", "the domain has changed since the caller read about it")
        domain, query = self.api.domain, request["query"]
        require(not (domain.required_selected or domain.required_group_by or domain.required_order_by), "operation_unsupported", "the domain adds to every query what a remote caller doesn't ask for")
        self._check(query)
        found = self.api.run(query)
        return found | {"meta": {"request_id": request.get("request_id"), "fingerprint": self.fingerprint}}

    def _check(self, query: dict[str, Any]) -> None:
        foreign = sorted(query.keys() - ASKED)
        require(not foreign, "operation_unsupported", "remote reads know no such part of a query", keys=foreign)
        plain = all(isinstance(e, str) or isinstance(e, dict) and e.keys() <= {"field", "alias"} for e in query.get("select", ()))
        require(plain, "operation_unsupported", "remote reads select plain fields")
        tests = [f.get("op") if isinstance(f, dict) else None for f in query.get("filters", ())]
        require(set(tests) <= TESTS, "operation_unsupported", "remote reads compare one field at a time")
