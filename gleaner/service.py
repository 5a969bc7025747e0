"""Tools for other programs, and a server that offers them on standard input and output.

Messages are JSON-RPC 2.0, one per line, in the way of the Model Context Protocol:
``initialize``, ``ping``, ``tools/list`` and ``tools/call``. Nothing but answers is
written to the output; all else goes to the log.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from typing import IO

log = logging.getLogger(__name__)

#: Fixed values of the protocol.
PROTOCOL = "2025-06-18"
NOT_JSON, NOT_A_REQUEST, NO_METHOD, WRONG_PARAMETERS = -32700, -32600, -32601, -32602

_WHOLE = {"type": "integer"}
_NAMES = {"type": "array", "items": {"type": "string"}}
#: Columns of a hit that a caller gets, in this order.
HIT = ("source_name", "source_path", "heading_path", "text", "score", "cosine", "bm25", "char_start", "char_end", "chunk_index", "note_date", "status", "tags")


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    arguments: dict[str, dict]
    needed: tuple[str, ...]
    run: Callable[..., object]

    def described(self) -> dict:
        return {"name": self.name, "description": self.about, "inputSchema": {"type": "object", "properties": self.arguments, "required": list(self.needed)}}


def build_tools(app) -> list[Tool]:
    """The tools of an ``App`` of the command line."""
    search = {"query": {"type": "string"}, "sources": _NAMES, "k": _WHOLE | {"minimum": 1, "maximum": 100}, "context_chunks": _WHOLE | {"minimum": 0, "maximum": 5}}

    def hits(query: str, sources: list[str] | None = None, k: int = 10, context_chunks: int = 0) -> list[dict]:
        return [{c: row[c] for c in HIT} for row in (h.asDict() for h in app.search(query, sources, k, context_chunks))]

    return [
        Tool("search", "Chunks of the indexed sources that fit a query best, by meaning and by words.", search, ("query",), hits),
        Tool("list_sources", "Every indexed source with its number of chunks.", {}, (), app.list_sources),
        Tool("index_status", "How many chunks each source has, when it was last indexed, and what failed.", {}, (), app.index_status),
    ]


def _plain(value: object) -> str:
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} has no JSON form")


class Server:
    """Answers messages one after another until the input ends."""

    def __init__(self, tools: list[Tool], name: str = "gleaner") -> None:
        self.tools, self.name = {t.name: t for t in tools}, name
        self.methods: dict[str, Callable[[dict], object]] = {
            "initialize": lambda p: {"protocolVersion": p.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": "1"}},
            "ping": lambda p: {},
            "tools/list": lambda p: {"tools": [t.described() for t in self.tools.values()]},
            "tools/call": self._call,
        }

    def _call(self, params: dict) -> dict:
        tool, given = self.tools.get(params.get("name")), params.get("arguments") or {}
        if tool is None:
            raise ValueError(f"no tool {params.get('name')!r}")
        odd = sorted(set(given) - set(tool.arguments)) + [n for n in tool.needed if n not in given]
        if odd:
            raise ValueError(f"{tool.name}: arguments that are missing or unknown: {', '.join(odd)}")
        try:
            text, failed = json.dumps(tool.run(**given), default=_plain, ensure_ascii=False), False
        except Exception as e:  # the caller is told; the server goes on
            log.exception("tool %s failed", tool.name)
            text, failed = f"{type(e).__name__}: {e}".split("\n")[0], True
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def answer(self, line: str) -> dict | None:
        """The answer to a message, or None to one that asks for none."""
        def wrong(code: int, what: str, number: object = None) -> dict:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": what}}

        try:
            message = json.loads(line)
        except ValueError as e:
            return wrong(NOT_JSON, str(e))
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return wrong(NOT_A_REQUEST, "not a request")
        if "id" not in message:
            return None
        method, params = self.methods.get(message["method"]), message.get("params") or {}
        if method is None:
            return wrong(NO_METHOD, f"no method {message['method']!r}", message["id"])
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": method(params)}
        except (ValueError, TypeError, AttributeError) as e:
            return wrong(WRONG_PARAMETERS, str(e), message["id"])

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            if line.strip():
                answer = self.answer(line)
                if answer is not None:
                    out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                    out.flush()
