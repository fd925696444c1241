"""Frames, tools and the language server."""

import io
import json

from quillmill import server
from quillmill.plans.catalog import script

RENAME = script("s", 'match go::symbol "old" { replace "new" }')


def talk(make, *messages):
    source, out = io.BytesIO(), []
    for m in messages:
        server.write_frame(source, m)
    source.seek(0)
    server.serve(make(out.append), source, out.append)
    return out


def ask(i, method, **params):
    return {"jsonrpc": "2.0", "id": i, "method": method, "params": params}


def test_frames():
    assert list(server.read_frames(io.BytesIO(b"content-length: 2\r\nX: y\r\n\r\n{}Content-Length: 9\r\n\r\n{}"))) == [b"{}"]
    assert list(server.read_frames(io.BytesIO(b"X: y\r\n\r\n{}"))) == []


def test_tools(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"f{i:02}.go").write_text("var old = 1\n" if i < 3 else "x")
    make = lambda send: server.ToolServer(lambda: spark, send)
    call = lambda i, name, **a: ask(i, "tools/call", name=name, arguments=a, _meta={"progressToken": "t"})
    got = talk(make, ask(1, "initialize"), ask(2, "tools/list"), ask(3, "nonsense"), {"jsonrpc": "2.0", "method": "note"}, call(4, "quillmill.preview", script=RENAME, paths=[str(tmp_path / "f69.go"), str(tmp_path)]), call(5, "quillmill.preview", script="bad", paths=["x"]), call(6, "quillmill.apply", script=RENAME))
    by = {m["id"]: m for m in got if "id" in m}
    assert len(by[2]["result"]["tools"]) == 4 and by[3]["error"]["code"] == server.METHOD_NOT_FOUND
    ticks = [m["params"] for m in got if m.get("method") == "notifications/progress"]
    assert [(t["progress"], t.get("total")) for t in ticks] == [(64, None), (71, 71)]
    files = json.loads(by[4]["result"]["content"][0]["text"])["files"]
    assert files[0]["path"].endswith("f69.go")  # root by root, as given
    assert [f["changed"] for f in files[1:]] == [True] * 3 + [False] * 67 and "+var new = 1" in files[1]["diff"] and "diff" not in files[5]
    assert by[5]["result"]["isError"] and by[5]["result"]["code"] == 2
    assert by[6]["error"]["code"] == server.INVALID_PARAMS
    got = talk(make, call(7, "quillmill.apply", script=RENAME, paths=[str(tmp_path)]), call(8, "quillmill.apply", script=RENAME, paths=[]), call(9, "quillmill.lint_script", script=RENAME), call(10, "quillmill.lint_script", script="bad"))
    by = {m["id"]: m for m in got if "id" in m}
    read = lambda i: json.loads(by[i]["result"]["content"][0]["text"])
    assert "+var new = 1" in read(7)["files"][0]["diff"] and by[8]["error"]["code"] == server.INVALID_PARAMS
    assert read(9) == {"ok": True, "name": "s", "rule_count": 1}
    assert read(10)["ok"] is False and read(10)["exit_code"] == 2 and read(10)["error"]
    assert (tmp_path / "f00.go").read_text() == "var new = 1\n"


def test_language_server():
    text = 'refactor "x" { match rust::'
    got = talk(server.LanguageServer, ask(1, "initialize"), {"jsonrpc": "2.0", "method": "textDocument/didOpen", "params": {"textDocument": {"uri": "u", "text": text}}}, ask(2, "textDocument/completion", textDocument={"uri": "u"}, position={"line": 0, "character": len(text)}), ask(3, "textDocument/completion"), ask(4, "shutdown"), {"jsonrpc": "2.0", "method": "exit"})
    said = [m for m in got if m.get("method") == "textDocument/publishDiagnostics"]
    assert said[0]["params"]["diagnostics"][0]["code"] == 2
    by = {m["id"]: m for m in got if "id" in m}
    assert [x["label"] for x in by[2]["result"]] == ["use", "symbol", "crate", "call"]
    assert by[3]["error"]["code"] == server.INVALID_PARAMS and by[4]["result"] is None
