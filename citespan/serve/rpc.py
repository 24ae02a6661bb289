"""JSON-RPC over standard input and over HTTP on the loopback address: one tool, ``ask``."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from .. import __version__

PROTOCOL_VERSION = "2024-11-05"
PARSE_ERROR, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32601, -32602, -32603
ASK_TOOL = {
    "name": "ask",
    "description": "Ask a question about the project. The answer is grounded in source that was read for it, with path:line citations.",
    "inputSchema": {"type": "object", "properties": {"question": {"type": "string", "description": "A question about the project."}}, "required": ["question"], "additionalProperties": False},
}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def response(id_: object, result: object = None, error: RpcError | None = None) -> dict:
    body = {"error": {"code": error.code, "message": str(error)}} if error else {"result": result}
    return {"jsonrpc": "2.0", "id": id_, **body}


def text_result(text: str, is_error: bool = False) -> dict:
    return {"content": [{"type": "text", "text": text}], "isError": is_error}


class Server:
    """ask: the question's answer as text."""

    def __init__(self, ask: Callable[[str], str]):
        self.ask = ask
        empty = lambda key: lambda params: {key: []}
        self.methods: dict[str, Callable[[dict], object]] = {
            "initialize": lambda p: {"protocolVersion": PROTOCOL_VERSION, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "citespan", "version": __version__}},
            "ping": lambda p: {}, "tools/list": lambda p: {"tools": [ASK_TOOL]}, "tools/call": self._call, "resources/list": empty("resources"), "prompts/list": empty("prompts"),
        }

    def _call(self, params: dict) -> dict:
        name = params.get("name")
        if not isinstance(name, str):
            raise RpcError(INVALID_PARAMS, "missing 'name'")
        if name != "ask":
            raise RpcError(INVALID_PARAMS, f"unknown tool: {name}")
        question = (params.get("arguments") or {}).get("question")
        if not isinstance(question, str):
            raise RpcError(INVALID_PARAMS, "missing 'question'")
        if not question.strip():
            return text_result("question is empty", True)
        try:
            return text_result(self.ask(question.strip()))
        except Exception as e:  # the agent's failure is the tool's answer
            return text_result(f"agent error: {e}", True)

    def handle(self, request: dict) -> dict | None:
        """The response, or None for a notification, which is carried out all the same."""
        method, silent = request.get("method"), request.get("id") is None
        if method in ("notifications/initialized", "notifications/cancelled"):
            return None
        try:
            if method not in self.methods:
                raise RpcError(METHOD_NOT_FOUND, f"method not found: {method}")
            params = request.get("params")
            out = response(request.get("id"), self.methods[method](params if isinstance(params, dict) else {}))
        except RpcError as e:
            out = response(request.get("id"), error=e)
        return None if silent else out

    def handle_text(self, text: str) -> dict | None:
        try:
            request = json.loads(text)
            if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                raise ValueError("not a request")
        except ValueError as e:
            return response(None, error=RpcError(PARSE_ERROR, f"parse error: {e}"))
        return self.handle(request)


def serve_stdio(server: Server, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in source:
        if line.strip() and (out := server.handle_text(line)) is not None:
            print(json.dumps(out, ensure_ascii=False), file=sink, flush=True)


def http_server(server: Server, port: int = 8765) -> ThreadingHTTPServer:
    """A server on 127.0.0.1; a notification is answered with 202 and null."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            out = server.handle_text(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace"))
            body = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(202 if out is None else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
