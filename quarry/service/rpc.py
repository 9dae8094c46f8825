"""Search tools over JSON-RPC 2.0, one JSON object per line.

The service is a thin driver-side layer: each tool is one DataFrame query over a
project's index, and only its bounded answer (top hits, the first references, one span)
comes to the driver. Errors of a tool are answers with ``isError``; a broken line or an
unknown method is a JSON-RPC error, and no request ends the loop.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.chunkers.registry import chunk_files
from quarry.operators import decide, index, scoring, tools
from quarry.service.degrade import Reranker
from quarry.service.jobs import Jobs
from quarry.session import cut
from quarry.sources.config import Project, find_project
from quarry.sources.store import Store, summary

PROTOCOL, VERSION = "2024-11-05", "0.1"
PARSE_ERROR, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602
#: Arguments of each tool: name to (type, required).
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "list_projects": {},
    "search_code": {"query": ("string", True), "top_k": ("integer", False), "project": ("string", False)},
    "get_symbol": {"name": ("string", True), "project": ("string", False)},
    "find_references": {"name": ("string", True), "project": ("string", False)},
    "read_span": {"file": ("string", True), "start": ("integer", True), "end": ("integer", True), "project": ("string", False)},
    "reindex": {"project": ("string", False)},
}


class Service:
    """Projects are (name, path); ``load`` gives the files (file_path, language, hash,
    content) of a path. With a ``store``, indexes are kept there and brought up to date by
    what has changed; else they are built anew. ``scorer`` may be another than the
    heuristic one (see ``scoring.rerank``)."""

    def __init__(self, spark: SparkSession, projects: list[tuple[str, str]], load: Callable[[str], DataFrame], default: str = "",
        log: TextIO | None = None, store: Store | None = None, scorer=scoring.heuristic_scores):
        self.spark, self.load, self.default, self.log, self.store, self.scorer = spark, load, default, log, store, scorer
        self.projects = [Project(*p) for p in projects]
        self.built: dict[str, tuple[DataFrame, index.Index]] = {}
        self.reranker, self.jobs = Reranker(spark), Jobs()

    def project(self, asked: str) -> str:
        """The path of a project, as ``find_project`` finds it."""
        found = find_project(self.projects, asked, self.default)
        if found is None:
            raise ValueError(f"unknown project {asked!r}")
        return found.path

    def build(self, path: str) -> dict:
        """Builds or brings up to date the tables of a path, and says what that took."""
        files = cut(self.load(path))
        if self.store is None:
            self.built[path] = files, index.build(cut(chunk_files(files)), cut)
            return {"files": files.count(), "chunks": self.built[path][1].chunks.count()}
        done = self.store.update(path, files, abort=self.jobs.stop.is_set, log=self.jobs.say)
        self.built[path] = files, index.build(self.store.read(path)[0], cut)
        return vars(done)

    def tables(self, asked: str) -> tuple[DataFrame, index.Index]:
        path = self.project(asked)
        if path not in self.built:
            self.build(path)
        return self.built[path]

    def list_projects(self) -> dict:
        return {"projects": [{"name": p.name, "path": p.path} for p in self.projects], "default": self.default}

    def hits(self, query: str, mode: str, k: int, project: str, filtered: bool) -> tuple[list[dict], dict, int]:
        """Rows of a search as they are shown, their gate, and how many there were before the cut-off."""
        built = self.tables(project)[1]
        asked = self.spark.createDataFrame([(1, query)], "query_id int, query string")
        hits = cut(scoring.search(built, asked, mode, k, self.scorer))
        kept = cut(decide.filter_relevant(hits)) if filtered else hits
        wanted = ("file_path", "start_line", "end_line", "symbol_name", "kind", "language", "signature", "doc", "content")
        found = kept.join(built.chunks.select("chunk_id", *wanted), "chunk_id").orderBy("rank").select(*wanted, "score").collect()  # k rows at most
        names = {"file_path": "file", "symbol_name": "symbol"}
        results = [{names.get(c, c): v for c, v in r.asDict().items() if v or c not in ("signature", "doc")} for r in found]
        gate = decide.noul(kept).first()
        return results, {"noul": gate["noul"] if gate else 0.0, "need_more": gate["need_more"] if gate else True}, hits.count()

    def search_code(self, query: str, top_k: int = 5, project: str = "") -> dict:
        scoring.asked_for(query)
        k = top_k if 0 < top_k <= scoring.MOST else scoring.DEFAULT_K
        self.tables(project)
        # Fused scores are on another scale, so the plain answer isn't cut off.
        (results, gate, n_raw), why = self.reranker.run(lambda: self.hits(query, "hybrid+rerank", k, project, True),
            lambda: self.hits(query, "hybrid", k, project, False))
        answer = {"query": query, "results": results} | gate
        more = n_raw == k or len(results) < n_raw
        return answer | ({"more_available": True} if more else {}) | ({"degraded": why} if why else {})

    def search(self, query: str, mode: str = "hybrid+rerank", top: int = 0, project: str = "") -> dict:
        """A search in any mode, without cut-off."""
        scoring.asked_for(query)
        results, gate, _ = self.hits(query, mode, top if 0 < top <= scoring.MOST else scoring.DEFAULT_K, project, False)
        return {"query": query, "mode": mode, "results": results} | gate

    def stats(self, project: str = "") -> dict:
        return summary(self.tables(project)[1].chunks)

    def get_symbol(self, name: str, project: str = "") -> dict:
        found = [r.asDict() for r in tools.find_symbol(self.tables(project)[1].chunks, name).orderBy("file_path", "start_line").collect()]
        if not found:
            raise ValueError(f"no symbol {name!r}")
        return {"name": name, "symbols": found}

    def find_references(self, name: str, project: str = "") -> dict:
        found = tools.find_references(self.tables(project)[0], name).orderBy("file_path", "line").collect()
        return {"name": name, "references": [{k: r[k] for k in ("file_path", "line", "text")} for r in found], "truncated": bool(found) and found[0]["truncated"]}

    def read_span(self, file: str, start: int, end: int, project: str = "") -> dict:
        row = tools.read_span(self.tables(project)[0].where(F.col("file_path") == file), F.lit(start), F.lit(end)).first()
        if row is None or row["span"] is None:
            raise ValueError(f"no lines {start}-{end} in {file!r}")
        return {"file": file, "start": start, "end": end, "content": row["span"]}

    def reindex(self, project: str = "") -> dict:
        """Brings a project's tables up to date in the background; an error if that is being done."""
        path = self.project(project)
        self.jobs.start(f"index {path}", lambda: self.build(path))
        return {"started": True, "project": path}

    def call(self, name: str, arguments: dict) -> dict:
        began = time.monotonic()
        try:
            text, failed = json.dumps(getattr(self, name)(**arguments), ensure_ascii=False), False
        except Exception as error:  # noqa: BLE001  a tool's failure is its answer
            text, failed = str(error).splitlines()[0] if str(error) else type(error).__name__, True
        if self.log:
            entry = {"ts": datetime.now(UTC).isoformat(), "tool": name, "args": json.dumps(arguments, ensure_ascii=False),
                "latency_ms": int(1000 * (time.monotonic() - began)), "response_bytes": len(text.encode())}
            print(json.dumps(entry, ensure_ascii=False), file=self.log, flush=True)
        return {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {})

    def answer(self, line: str) -> dict | None:
        """The response to a request; none to a notification."""
        try:
            request = json.loads(line)
            method, params = request["method"], request.get("params") or {}
            if not isinstance(params, dict) or not isinstance(params.get("arguments") or {}, dict):
                raise ValueError("parameters are named")
        except (ValueError, KeyError, TypeError, AttributeError):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not a request"}}
        if "id" not in request:
            return None
        error, result = None, {}
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": VERSION}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {a: {"type": t} for a, (t, _) in args.items()},
                "required": [a for a, (_, needed) in args.items() if needed]}} for n, args in TOOLS.items()]}
        elif method == "tools/call":
            name, arguments = params.get("name"), params.get("arguments") or {}
            if name not in TOOLS or not set(arguments) <= set(TOOLS[name]):
                error = {"code": BAD_PARAMS, "message": f"unknown tool or argument: {name}"}
            else:
                result = self.call(name, arguments)
        elif method != "ping":
            error = {"code": NO_METHOD, "message": f"unknown method {method}"}
        return {"jsonrpc": "2.0", "id": request["id"]} | ({"error": error} if error else {"result": result})

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        for line in lines:
            if line.strip() and (response := self.answer(line)) is not None:
                print(json.dumps(response, ensure_ascii=False), file=out, flush=True)
