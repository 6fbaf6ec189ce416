"""Small HTTP services: vectors of texts from any embedder, and items of a collection.

They speak what ``HttpEmbedder`` and ``HttpFetch`` ask for, all by POST with JSON bodies:

* ``/dimemb`` gives ``{"dimemb": n}``, ``/embed`` takes ``{"text": t}`` and gives ``{"embedding": [...]}``;
* ``/descriptor`` names an item's fields, ``/dataitem`` takes ``{"idx": i, "char_length": n}`` and gives the item
  with its text cut, ``/dataitemfull`` takes ``{"idx": i}`` and gives all of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np

from ..functions.embedding import Embedder

#: The fields of an item as its service names them.
ITEM_FIELDS = ["id", "url", "title", "articleStart"]

Route = Callable[[dict], dict]


def embedding_routes(embedder: Embedder) -> dict[str, Route]:
    return {
        "/dimemb": lambda body: {"dimemb": embedder.dim},
        "/embed": lambda body: {"embedding": np.asarray(embedder.embed([str(body["text"])]), float)[0].tolist()},
    }


def item_routes(items: Sequence[dict]) -> dict[str, Route]:
    """``items`` have id, url, title and text."""

    def start(body: dict) -> dict:
        item = dict(items[int(body["idx"])])
        text = item.pop("text")
        return {"dataelement": item | {"articleStart": text[: max(0, min(len(text), int(body["char_length"])) - 3)] + "..."}}

    return {
        "/descriptor": lambda body: {"descriptor": ITEM_FIELDS},
        "/dataitem": start,
        "/dataitemfull": lambda body: {"dataelement": dict(items[int(body["idx"])])},
    }


def serve(routes: dict[str, Route], host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of ``routes``, bound but not yet running: call ``serve_forever``. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            route = routes.get(self.path)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                code, answer = (200, route(body)) if route else (404, {"error": "no such path"})
            except (KeyError, IndexError, ValueError, TypeError) as e:
                code, answer = 400, {"error": f"{type(e).__name__}: {e}"}
            data = json.dumps(answer).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
