"""The tools over JSON-RPC 2.0 on lines of stdin and stdout: ``python -m skeinery serve-tools [--url URL]``.

A request is a line, and so is a response. Known methods: initialize, ping, tools/list, tools/call. Notifications (requests
without an id) are not answered. What a tool returns, an error document too, is text content; a failure in it is marked.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from typing import TextIO

from skeinery.serving.http import tools

# Fixed values of the protocol.
VERSION = "2024-11-05"
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _checked(schema: dict, given) -> dict:
    """Arguments that fit the tool's schema: an object with what is required, of the right types, and nothing else."""
    if not isinstance(given, dict):
        raise Refused(PARAMS, "arguments must be an object")
    for name in schema.get("required", []):
        if name not in given:
            raise Refused(PARAMS, f"argument {name} is missing")
    for name, value in given.items():
        if name not in schema["properties"]:
            raise Refused(PARAMS, f"unknown argument {name}")
        if schema["properties"][name]["type"] == "string" and not isinstance(value, str):
            raise Refused(PARAMS, f"argument {name} must be a string")
    return given


def result(method: str, params: dict, offered: dict[str, dict]) -> dict:
    """The result of a method; ``Refused`` where there is none."""
    if method == "initialize":
        return {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "skeinery", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": t["description"], "inputSchema": t["input_schema"]} for n, t in offered.items()]}
    if method == "tools/call":
        tool = offered.get(params.get("name")) if isinstance(params.get("name"), str) else None
        if tool is None:
            raise Refused(PARAMS, f"no tool {params.get('name')}")
        document = tool["call"](**_checked(tool["input_schema"], params.get("arguments", {})))
        return {"content": [{"type": "text", "text": json.dumps(document)}], "isError": isinstance(document, dict) and "error" in document}
    raise Refused(METHOD, f"no method {method}")


def respond(line: str, offered: dict[str, dict]) -> dict | None:
    """The response to a line; None for a notification. Never raises."""
    number = None
    try:
        try:
            request = json.loads(line)
        except ValueError:
            raise Refused(PARSE, "not JSON") from None
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            raise Refused(REQUEST, "not a JSON-RPC 2.0 request")
        if "id" not in request:
            return None
        number = request["id"]
        params = request.get("params", {})
        if not isinstance(params, dict):
            raise Refused(PARAMS, "params must be an object")
        return {"jsonrpc": "2.0", "id": number, "result": result(request["method"], params, offered)}
    except Refused as e:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}}
    except Exception as e:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": INTERNAL, "message": f"{type(e).__name__}: {e}"}}


def serve(lines: Iterable[str] | None = None, out: TextIO | None = None, url: str | None = None, offer: Callable[[str | None], dict] = tools) -> None:
    """Answer line by line until the input ends."""
    offered, out = offer(url), out or sys.stdout
    for line in sys.stdin if lines is None else lines:
        if line.strip() and (said := respond(line, offered)) is not None:
            out.write(json.dumps(said) + "\n")
            out.flush()
