"""Requests on the driver: validation, a cache of results, clipboard signals, model manifests."""

from __future__ import annotations

import json
import os
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from trovesift.operators.rewrite import words

MODES = ("auto", "strict", "relaxed")


@dataclass(frozen=True)
class Request:
    """A search as it will be run."""

    query: str
    limit: int = 20
    mode: str = "auto"
    types: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    after: float | None = None
    before: float | None = None
    least: int | None = None
    most: int | None = None
    cwd: str = ""
    app: str = ""


def parse(raw: dict[str, Any]) -> Request:
    """A request from plain values: limits are clamped to 1 to 200, unknown modes are auto, types lose their dot; a query is needed, and ranges must not be empty."""
    query = str(raw.get("query") or "").strip()
    if not query:
        raise ValueError("a query is needed")
    limit, mode = raw.get("limit", 20), str(raw.get("mode") or "auto").strip().lower()
    if not isinstance(limit, int) or isinstance(limit, bool):
        raise ValueError("the limit must be a whole number")
    names = lambda key: tuple(str(x).strip() for x in raw.get(key) or () if str(x).strip())
    number = lambda key, kind: None if raw.get(key) is None else kind(raw[key])
    out = Request(
        query, min(200, max(1, limit)), mode if mode in MODES else "auto", tuple(x.lower().lstrip(".") for x in names("types")), names("include"), names("exclude"),
        number("after", float), number("before", float), number("least", int), number("most", int), str(raw.get("cwd") or ""), str(raw.get("app") or ""),
    )
    if out.after is not None and out.before is not None and out.after > out.before or out.least is not None and out.most is not None and out.least > out.most:
        raise ValueError("the range is empty")
    return out


class Cache:
    """The latest results by request, for a while; `clock` tells the seconds."""

    def __init__(self, most: int = 128, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.seconds, self.clock = most, seconds, clock
        self.kept: OrderedDict[Request, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(request: Request) -> Request:
        """Equal for requests that differ in the order of types and folders only."""
        return Request(**{**request.__dict__, "types": tuple(sorted(request.types)), "include": tuple(sorted(request.include)), "exclude": tuple(sorted(request.exclude))})

    def get(self, request: Request) -> Any | None:
        key = self.key(request)
        found = self.kept.get(key)
        if found is None or self.clock() - found[0] > self.seconds:
            self.kept.pop(key, None)
            self.misses += 1
            return None
        self.kept.move_to_end(key)
        self.hits += 1
        return found[1]

    def put(self, request: Request, value: Any) -> None:
        key = self.key(request)
        self.kept[key] = self.clock(), value
        self.kept.move_to_end(key)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)

    def clear(self) -> None:
        self.kept.clear()


def clipboard(text: str, home: str = "/") -> dict[str, str]:
    """name, folder and extension that the first line of a clipboard points to, lower-case; empty if it points nowhere."""
    line = text.split("\n", 1)[0].strip()
    if not line or len(line) > 2048:
        return {}
    if line.lower().startswith("file://"):
        host, _, rest = line[7:].partition("/")
        if host not in ("", "localhost"):
            return {}
        line = "/" + rest
    if line.startswith("~/"):
        line = os.path.join(home, line[2:])
    extension = lambda name: {"extension": name.rpartition(".")[2]} if "." in name.strip(".") else {}
    if "/" in line or "\\" in line or line.startswith("."):
        path = os.path.normpath(line).lower()
        folder, name = os.path.basename(os.path.dirname(path)), os.path.basename(path)
        return ({"name": name, **extension(name)} if name else {}) | ({"folder": folder} if folder not in ("", ".") else {})
    found = re.search(r"\b([A-Za-z0-9._-]+\.[A-Za-z0-9]{1,10})\b", line)
    return {"name": found[1].lower(), **extension(found[1].lower())} if found else {}


@dataclass(frozen=True)
class Model:
    """An entry of a model manifest."""

    role: str
    name: str
    path: str
    dimensions: int = 0
    generation: str = "v1"
    sha256: str = ""


def load_manifest(text: str) -> dict[str, Model]:
    """Models by role of a JSON manifest {"models": [{"role", "name", "path", ...}]}; entries without these three are refused, the first of a role counts."""
    out: dict[str, Model] = {}
    for row in json.loads(text).get("models", []):
        missing = [k for k in ("role", "name", "path") if not row.get(k)]
        if missing:
            raise ValueError(f"a model without {', '.join(missing)}")
        known = {k: row[k] for k in Model.__dataclass_fields__ if k in row}
        out.setdefault(row["role"], Model(**known))
    return out


def query_length(query: str) -> int:
    return len(words(query))
