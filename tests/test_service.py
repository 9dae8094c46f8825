"""The tools over JSON-RPC lines and HTTP, degradation, background jobs, the hook and the commands."""

import io
import json
import os
import subprocess
import threading
import time
import urllib.error
import urllib.request

import pytest

from quarry import __main__ as commands
from quarry.chunkers.registry import language_column
from quarry.plans import fixtures
from quarry.service import degrade, hook, jobs
from quarry.service.http import server
from quarry.service.rpc import Service
from quarry.sources.store import Store
from quarry.sources.tree import source_files


def loaded(spark):
    return lambda path: fixtures.files(spark).withColumn("language", language_column("file_path"))


@pytest.fixture(scope="module")
def shop(spark):
    return Service(spark, [("shop", "/srv/shop")], loaded(spark), log=io.StringIO())


def test_serve(shop):
    out = io.StringIO()
    calls = [
        ("search_code", {"query": "openCart", "top_k": 3}),
        ("get_symbol", {"name": "RATE_FOR", "project": "Shop"}),
        ("find_references", {"name": "STANDARD"}),
        ("read_span", {"file": "README.md", "start": -1, "end": 2}),
        ("get_symbol", {"name": "nothing"}),
        ("search_code", {"query": "  "}),
        ("list_projects", {}),
    ]
    lines = ["{broken", '{"jsonrpc": "2.0", "method": "notifications/initialized"}', '{"id": 1, "method": "nope"}', '{"id": 2, "method": "tools/list"}', "", '{"id": 3, "method": "ping"}', '{"id": 4, "method": "tools/call", "params": {"name": "none"}}', '{"id": 5, "method": "initialize"}']
    lines += [json.dumps({"id": 10 + k, "method": "tools/call", "params": {"name": n, "arguments": a}}) for k, (n, a) in enumerate(calls)]
    shop.serve(lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["error"]["code"] for r in (got[0], got[1], got[4])] == [-32700, -32601, -32602] and len(got[2]["result"]["tools"]) == 6
    assert got[5]["result"]["serverInfo"]["name"] == "quarry"
    texts = [r["result"]["content"][0]["text"] for r in got[6:]]
    first = json.loads(texts[0])
    assert first["results"][0]["file"] == "web/cart.js" and "degraded" not in first and not {"chunk_id", "hash"} & set(first["results"][0])
    assert json.loads(texts[1])["symbols"][0]["file_path"] == "tax/rates.py"
    references = json.loads(texts[2])
    assert [r["line"] for r in references["references"]] == [3, 9] and references["truncated"] is False
    assert json.loads(texts[3])["content"] == "intro\n# One"
    assert got[10]["result"]["isError"] and got[11]["result"]["isError"] and json.loads(texts[6])["projects"] == [{"name": "shop", "path": "/srv/shop"}]
    assert len(shop.log.getvalue().splitlines()) == len(calls)


def test_degraded_searches(shop):
    hybrid = [r["file"] for r in shop.search("open the cart", "hybrid", 3)["results"]]
    shop.reranker.busy.acquire()
    try:
        got = shop.search_code("open the cart", 3)
    finally:
        shop.reranker.busy.release()
    assert got["degraded"] == degrade.BUSY and [r["file"] for r in got["results"]] == hybrid and got["need_more"] is True
    kept, shop.reranker.seconds = shop.reranker.seconds, 0.01
    try:
        got = shop.search_code("open the cart", 3)
    finally:
        shop.reranker.seconds = kept
    assert got["degraded"] == degrade.LATE and [r["file"] for r in got["results"]] == hybrid
    deadline = time.time() + 60
    while shop.reranker.busy.locked() and time.time() < deadline:
        time.sleep(0.1)
    assert "degraded" not in shop.search_code("open the cart", 3)


def test_reranker_and_budget(monkeypatch):
    again = degrade.Reranker(seconds=5)
    assert again.run(lambda: 1, lambda: 2) == (1, "")
    with pytest.raises(ZeroDivisionError):
        again.run(lambda: 1 // 0, lambda: 2)
    hold = threading.Event()
    slow = degrade.Reranker(seconds=0.05)
    assert slow.run(lambda: hold.wait(5), lambda: "plain") == ("plain", degrade.LATE)
    assert slow.run(lambda: 1, lambda: "plain") == ("plain", degrade.BUSY)
    hold.set()
    for text, seconds in (("", 25), ("7", 7), ("-1", 25), ("x", 25), ("0", 25)):
        monkeypatch.setenv(degrade.BUDGET_NAME, text)
        assert degrade.budget() == seconds


def test_jobs():
    some, hold = jobs.Jobs(lines=4), threading.Event()
    thread = some.start("a", lambda: hold.wait(5) and 7)
    with pytest.raises(jobs.Busy, match="a is running"):
        some.start("b", lambda: 1)
    hold.set()
    thread.join()
    assert some.state == {"running": False, "name": "a", "error": "", "result": 7}
    some.start("c", lambda: 1 // 0).join()
    assert "division" in some.state["error"] and not some.state["running"]
    for k in range(9):
        some.say(str(k))
    assert [x.split()[-1] for x in some.log] == ["5", "6", "7", "8"]


def ask(base, path, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(base + path, body), timeout=120) as answer:
            return answer.status, json.load(answer)
    except urllib.error.HTTPError as error:
        return error.code, json.load(error)


def test_http(spark, tmp_path):
    for name in ("tax/rates.py", "web/cart.js"):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(fixtures.FILES[name])
    service = Service(spark, [("src", str(tmp_path / "src"))], lambda path: source_files(spark, path), store=Store(spark, str(tmp_path / "store")))
    with server(service) as web:
        threading.Thread(target=web.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{web.server_address[1]}"
        status, found = ask(base, "/api/search?q=openCart&mode=fts&top=2")
        assert status == 200 and found["results"][0]["file"] == "web/cart.js" and len(found["results"]) <= 2
        assert ask(base, "/api/search?q=%20")[0] == 400 and ask(base, "/api/search?q=x&mode=none")[0] == 400 and ask(base, "/none")[0] == 404 and ask(base, "/api/search?q=x&project=none")[0] == 400
        status, stats = ask(base, "/api/stats")
        assert status == 200 and stats["files"] == 2 and sum(stats["language"].values()) == stats["chunks"]
        status, answer = ask(base, "/mcp", b'{"id": 1, "method": "ping"}')
        assert status == 200 and answer["result"] == {} and ask(base, "/mcp", b'{"method": "notifications/x"}')[0] == 202
        assert ask(base, "/mcp", b" " * ((4 << 20) + 1))[0] == 400
        (tmp_path / "src" / "tax" / "rates.py").write_text("def new_rate():\n    return 1\n")
        assert ask(base, "/api/index", b"")[0] == 202
        deadline = time.time() + 60
        while ask(base, "/api/status")[1]["running"] and time.time() < deadline:
            time.sleep(0.2)
        state = ask(base, "/api/status")[1]
        assert (state["result"]["reindexed"], state["result"]["kept"], state["error"]) == (1, 1, "") and any("1 files to chunk" in x for x in state["log"])
        assert ask(base, "/api/search?q=new_rate&mode=fts")[1]["results"][0]["symbol"] == "new_rate"
        service.jobs.gate.acquire()
        assert ask(base, "/api/index", b"")[0] == 409
        service.jobs.gate.release()
        web.shutdown()


def test_hook(tmp_path):
    path = hook.install(str(tmp_path), "/srv/my store")
    assert os.access(path, os.X_OK) and hook.install(str(tmp_path), "/srv/my store") == path
    assert "'/srv/my store'" in open(path).read() and "|| true" in open(path).read()
    # It ends well outside a repository, and with a program that fails.
    assert subprocess.run(["sh", path], cwd=tmp_path, env={"PATH": os.environ["PATH"]}).returncode == 0
    open(path, "w").write("#!/bin/sh\nother\n")
    with pytest.raises(FileExistsError):
        hook.install(str(tmp_path), "/srv/my store")


def test_commands(spark, tmp_path, capsys):
    for name in ("tax/rates.py", "web/cart.js", "shop/basket.go"):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(fixtures.FILES[name])
    asked = [{"id": f"x{k}", "question": q, "question_lang": "en", "type": "semantic", "language": "go", "expected_files": [f], "expected_symbols": []} for k, (q, f) in enumerate([("rate of a country", "tax/rates.py"), ("openCart", "web/cart.js")])]
    (tmp_path / "golden.json").write_text(json.dumps({"questions": asked}))
    src, store = str(tmp_path / "src"), str(tmp_path / "store")

    def run(*argv):
        assert commands.main(list(argv)) == 0
        return capsys.readouterr().out

    assert json.loads(run("index", src, "--store", store))["reindexed"] == 3
    assert json.loads(run("index", src, "--store", store))["kept"] == 3
    assert json.loads(run("search", src, "rate_for", "--mode", "fts", "--top", "1"))["results"][0]["file"] == "tax/rates.py"
    assert "| A | fts | 1.00 |" in run("eval", src, str(tmp_path / "golden.json"), "--store", store, "--report", str(tmp_path / "r.md")) and (tmp_path / "r.md").exists()
    costs = json.loads(run("bench", src, str(tmp_path / "golden.json"), "--store", store))
    assert costs["n"] == 2 and {t["query_id"] for t in costs["tasks"]} == {"x0", "x1"} and costs["mean_ratio"] > 0
    assert run("hook", src).strip().endswith("post-commit")
