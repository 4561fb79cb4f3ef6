"""Embedders for selection: a local encoder, and an endpoint that takes batches.

Both are small objects that travel to the workers and open their model or connection there.
"""

from __future__ import annotations

import json
import urllib.request

_models: dict[tuple, object] = {}


class LocalEncoder:
    """Normalised vectors of a sentence encoder, which each worker process loads once.

    ``trust_remote_code`` lets a model's repository run its own code; it is off unless asked for.
    """

    def __init__(self, model: str = "BAAI/bge-small-en-v1.5", trust_remote_code: bool = False, load=None) -> None:
        self.key, self.load = (model, trust_remote_code), load

    def __call__(self, texts: list[str]) -> list:
        if self.key not in _models:
            if self.load is None:
                from sentence_transformers import SentenceTransformer

                _models[self.key] = SentenceTransformer(self.key[0], trust_remote_code=self.key[1])
            else:
                _models[self.key] = self.load(*self.key)
        return list(_models[self.key].encode(list(texts), normalize_embeddings=True, show_progress_bar=False))


class Endpoint:
    """Vectors of an embeddings endpoint with the common JSON interface, asked for ``batch_size`` texts at a time."""

    def __init__(self, base_url: str = "http://localhost:8000/v1", model: str = "BAAI/bge-small-en-v1.5", api_key: str = "EMPTY", batch_size: int = 64, timeout: float = 60) -> None:
        self.url, self.model, self.api_key, self.batch_size, self.timeout = f"{base_url.rstrip('/')}/embeddings", model, api_key, batch_size, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        texts, out = list(texts), []
        for i in range(0, len(texts), self.batch_size):
            body = json.dumps({"model": self.model, "input": texts[i : i + self.batch_size]}).encode()
            asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
            with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
                rows = json.load(reply)["data"]
            out += [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
        return out


def from_conf(spark, prefix: str = "ctxsieve.embedder."):
    """The endpoint that the session's settings ``ctxsieve.embedder.url``, ``model``, ``key`` and ``batch`` name, or None."""
    get = lambda k: spark.conf.get(prefix + k, None)
    if not get("url"):
        return None
    given = {"model": get("model"), "api_key": get("key"), "batch_size": int(get("batch")) if get("batch") else None}
    return Endpoint(get("url"), **{k: v for k, v in given.items() if v is not None})
