"""JSON-RPC 2.0 over streams with ``Content-Length`` frames: tools for agents, and a language server for scripts."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .plans import api, registry
from .plans.compiler import changes, compile_script
from .sources import files, sinks
from .sources.tables import kept

METHOD_NOT_FOUND, INVALID_PARAMS, PARSE_ERROR = -32601, -32602, -32700

#: Files between two notes of progress.
TICK = 64


def read_frames(stream: BinaryIO) -> Iterator[bytes]:
    """Bodies of the frames, until the stream ends or a header has no length."""
    while True:
        length = None
        while line := stream.readline():
            if not line.strip():
                break
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
        if length is None:
            return
        body = stream.read(length)
        if len(body) < length:
            return
        yield body


def write_frame(stream: BinaryIO, message: dict) -> None:
    body = json.dumps(message).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


_SCRIPT = {"script": {"type": "string", "description": "Source of the script"}}
_PATHS = {"paths": {"type": "array", "items": {"type": "string"}, "minItems": 1, "description": "Files and folders, in order"}}


def _tool(name: str, description: str, properties: dict) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}}


TOOLS = [
    _tool("quillmill.schema", "Languages, modules and actions.", {}),
    _tool("quillmill.lint_script", "Whether a script is good: {ok, name, rule_count}, or {ok, error, exit_code}.", _SCRIPT),
    _tool("quillmill.preview", "What a script would change, with diffs; nothing is written.", _SCRIPT | _PATHS),
    _tool("quillmill.apply", "Runs a script, writes the changes and returns their diffs.", _SCRIPT | _PATHS),
]


def run_script(spark: SparkSession, script: str, paths: list[str], write: bool, tick: Callable[[int, int | None], None] | None = None) -> list[dict]:
    """An object for each processed file, in order, with a diff if it changed; ``tick`` hears of every ``TICK`` files, and of the total at the end."""
    plan = compile_script(script)
    ch = changes(files.tree(spark, paths, relevant=plan.relevant(F.col("path"))), plan)
    if write:
        ch = kept(ch)
    out: list[dict] = []
    for r in api.reports(ch):
        out.append(r)
        if tick and len(out) % TICK == 0:
            tick(len(out), None)
    if write:
        sinks.write_files(ch)
    if tick:
        tick(len(out), len(out))
    return out


class ToolServer:
    """Answers the calls of agents."""

    def __init__(self, session: Callable[[], SparkSession], send: Callable[[dict], None]):
        self.session, self.send = session, send

    def call(self, method: str, params: dict):
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quillmill", "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": TOOLS}
        if method == "tools/call":
            return self._tool(params.get("name"), params.get("arguments") or {}, (params.get("_meta") or {}).get("progressToken"))
        raise Refused(METHOD_NOT_FOUND, f"unknown method {method}")

    def _tool(self, name: str | None, given: dict, token) -> dict:
        known = {t["name"]: t for t in TOOLS}
        if name not in known:
            raise Refused(INVALID_PARAMS, f"unknown tool {name}")
        given = given | ({"paths": [given["path"]]} if isinstance(given.get("path"), str) and "paths" not in given else {})
        fits = {"string": lambda x: isinstance(x, str), "array": lambda x: isinstance(x, list) and x and all(isinstance(y, str) for y in x)}
        if missing := [k for k, p in known[name]["inputSchema"]["properties"].items() if not fits[p["type"]](given.get(k))]:
            raise Refused(INVALID_PARAMS, f"missing or of another type: {', '.join(missing)}")

        def tick(done: int, total: int | None) -> None:
            self.send({"jsonrpc": "2.0", "method": "notifications/progress", "params": {"progressToken": token, "progress": done} | ({"total": total} if total is not None else {})})

        try:
            if name == "quillmill.schema":
                got = registry.schema()
            elif name == "quillmill.lint_script":
                got = api.checked(given["script"])
            else:
                got = {"files": run_script(self.session(), given["script"], given["paths"], name == "quillmill.apply", tick if token is not None else None)}
        except EngineError as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True, "code": e.exit_code}
        return {"content": [{"type": "text", "text": json.dumps(got)}], "isError": False}


class LanguageServer:
    """Diagnostics and completion for scripts."""

    def __init__(self, send: Callable[[dict], None]):
        self.send, self.texts = send, {}

    def call(self, method: str, params: dict):
        if method == "initialize":
            return {"capabilities": {"textDocumentSync": 1, "completionProvider": {"triggerCharacters": [":", " ", "{"]}}}
        if method == "shutdown":
            return None
        doc = params.get("textDocument") or {}
        if method in ("textDocument/didOpen", "textDocument/didChange"):
            text = doc["text"] if "text" in doc else params["contentChanges"][-1]["text"]
            self.texts[doc["uri"]] = text
            at = {"line": 0, "character": 0}
            found = [{"range": {"start": at, "end": at}, "severity": 1, "code": x["code"], "source": "quillmill", "message": x["message"]} for x in api.lint_script(text)]
            self.send({"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": doc["uri"], "diagnostics": found}})
            return None
        if method == "textDocument/completion":
            text, at = self.texts.get(doc.get("uri"), ""), params["position"]
            before = "\n".join([*text.split("\n")[: at["line"]], api.line_prefix(text, at["line"], at["character"])])
            return api.complete(before)
        raise Refused(METHOD_NOT_FOUND, f"unknown method {method}")


def serve(server, source: BinaryIO, send: Callable[[dict], None]) -> None:
    """Answers every request of ``source``; notes (requests without an id) get no answer, ``exit`` ends."""
    for body in read_frames(source):
        try:
            message = json.loads(body)
        except ValueError:
            send({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}})
            continue
        if message.get("method") == "exit":
            return
        answer: dict = {"jsonrpc": "2.0", "id": message.get("id")}
        try:
            answer["result"] = server.call(message.get("method", ""), message.get("params") or {})
        except Refused as e:
            answer["error"] = {"code": e.code, "message": str(e)}
        except (KeyError, TypeError, IndexError) as e:
            answer["error"] = {"code": INVALID_PARAMS, "message": f"malformed parameters: {e!r}"}
        if "id" in message:
            send(answer)


def main(kind: str) -> int:
    """``tools`` or ``language`` over standard input and output."""
    send = lambda m: write_frame(sys.stdout.buffer, m)
    session = lambda: SparkSession.builder.appName("quillmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    serve(ToolServer(session, send) if kind == "tools" else LanguageServer(send), sys.stdin.buffer, send)
    return 0
