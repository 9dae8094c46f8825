"""The tools over HTTP, beside a few plain addresses for searching, statistics and indexing."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from quarry.operators.scoring import MODES
from quarry.service.jobs import Busy
from quarry.service.rpc import Service

MOST_BYTES = 4 << 20


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, value: object) -> None:
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def body(self) -> str:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                # Read past it, so that the sender gets to the answer.
                left = min(size, 8 * MOST_BYTES)
                while left > 0 and (read := len(self.rfile.read(min(left, 1 << 16)))):
                    left -= read
                raise ValueError(f"more than {MOST_BYTES} bytes")
            return self.rfile.read(size).decode(errors="replace")

        def handled(self, routes: dict) -> None:
            address = urlsplit(self.path)
            given = {k: v[-1] for k, v in parse_qs(address.query, keep_blank_values=True).items()}
            route = routes.get(address.path)
            try:
                if route is None:
                    self.answer(404, {"error": f"nothing at {address.path}"})
                else:
                    route(given)
            except Busy as error:
                self.answer(409, {"error": str(error)})
            except (ValueError, TypeError) as error:
                self.answer(400, {"error": str(error)})
            except Exception as error:  # noqa: BLE001  no request ends the server
                self.answer(500, {"error": str(error).splitlines()[0] if str(error) else type(error).__name__})

        def do_GET(self) -> None:  # noqa: N802
            ok = lambda value: self.answer(200, value)
            self.handled(
                {
                    "/api/search": lambda q: ok(service.search(q.get("q", ""), q.get("mode") or MODES[3], int(q.get("top") or 0), q.get("project", ""))),
                    "/api/stats": lambda q: ok(service.stats(q.get("project", ""))),
                    "/api/projects": lambda q: ok(service.list_projects()),
                    "/api/status": lambda q: ok(service.jobs.state | {"log": list(service.jobs.log)}),
                }
            )

        def do_POST(self) -> None:  # noqa: N802
            def rpc(_: dict) -> None:
                response = service.answer(self.body())
                self.answer(200, response) if response is not None else self.answer(202, {})

            def index(given: dict) -> None:
                service.reindex(given.get("project", ""))
                self.answer(202, service.jobs.state)

            self.handled({"/mcp": rpc, "/api/index": index})

        def log_message(self, *_: object) -> None:
            """Calls have a log of their own."""

    return Handler


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is not running yet; port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), handler(service))
