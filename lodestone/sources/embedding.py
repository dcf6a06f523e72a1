"""Clients of embedding services, for operators.search.embed_nodes(remote=...).

A model's name tells the service: `ollama:<model>`, `openai:<model>`; any other name, and a service
without a model, means the local vectors.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

TIMEOUTS = {"ollama": 20, "openai": 25}


def _post(url: str, body: dict, timeout: int, headers: dict[str, str] | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def client(model: str) -> Callable[[list[str]], list[list[float]]] | None:
    """A function from texts to vectors, or None for local vectors. It raises if the service fails."""
    service, _, name = model.strip().partition(":")
    name = name.strip()
    if service not in TIMEOUTS or not name:
        return None
    if service == "ollama":
        base = os.environ.get("OLLAMA_BASE_URL", "http://127.0.0.1:11434").rstrip("/")
        return lambda texts: [_post(f"{base}/api/embeddings", {"model": name, "prompt": t}, TIMEOUTS["ollama"])["embedding"] for t in texts]
    base, key = os.environ.get("OPENAI_BASE_URL", "https://api.openai.com/v1").rstrip("/"), os.environ.get("OPENAI_API_KEY", "")

    def call(texts: list[str]) -> list[list[float]]:
        if not key:
            raise RuntimeError("OPENAI_API_KEY is not set")
        found = _post(f"{base}/embeddings", {"model": name, "input": texts}, TIMEOUTS["openai"], {"Authorization": f"Bearer {key}"})["data"]
        return [x["embedding"] for x in sorted(found, key=lambda x: x.get("index", 0))]

    return call
