"""Embedders and completers: two small protocols, offline implementations, and their use in Spark.

The offline ones are deterministic heuristics, not models: they make every pipeline runnable and
testable without a model server, and name themselves so in their results.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewright.schema import RESPONSE


class Embedder(Protocol):
    """Vectors of ``width`` for texts, in order."""

    name: str
    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    """A reply to messages (dicts of role and content): content, prompt_tokens, completion_tokens."""

    name: str

    def complete(self, messages: list[dict]) -> dict: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Hashed words and word pairs, signed, of unit length; a blank text gives zeros."""

    width: int = 768
    name: str = "offline-hash"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", (t or "").lower())
            for feature, n in Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]).items():
                h = xxhash.xxh64_intdigest(feature)
                out[i, h % self.width] += n if h >> 63 else -n
            norm = np.linalg.norm(out[i])
            if norm:
                out[i] /= norm
        return out.tolist()


@dataclass(frozen=True)
class HeuristicCompleter:
    """First sentences of the prompt's longest part, or a score reply from counts of hedges and numbers."""

    name: str = "offline-heuristic"

    def complete(self, messages: list[dict]) -> dict:
        prompt = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "") or ""
        body = max(prompt.split("\n\n"), key=len) if prompt else ""
        picked = re.split(r"(?<=[.!?])\s+", body.strip())[:3]
        if "SCORE: [X/10]" in prompt:
            low = prompt.lower()
            scores = [
                2 if re.search(r"control|random|blind|replicat", low) else 6,
                2 if re.search(r"p\s*[<=]|confidence|interval|variance", low) else 6,
                6 if re.search(r"\b(?:prove|always|never|first ever|breakthrough)\b", low) else 3,
                2 if re.search(r"limitation|caveat|available", low) else 6,
            ]
            names = ("Methodology", "Statistics", "Claims", "Transparency")
            flags = [f"- {n} cues are weak in the text" for n, s in zip(names, scores) if s > 5] or ["None identified"]
            rows = "\n".join(f"- {n}: [{s}/10] - by cue words" for n, s in zip(names, scores))
            content = f"BULLSHIT SCORE: [{sum(scores) / 4:g}/10]\n\nBREAKDOWN:\n{rows}\n\nRED FLAGS:\n" + "\n".join(flags) + "\n\nSUMMARY:\n" + " ".join(picked)
        else:
            content = " ".join(picked)
        return {"content": content, "prompt_tokens": len(prompt.split()), "completion_tokens": len(content.split())}

    def stream(self, messages: list[dict]) -> Generator[str, None, dict | None]:
        """The reply in pieces and its counts, on the driver."""
        reply = self.complete(messages)
        yield from re.findall(r"\S+\s*", reply["content"])
        return {k: reply[k] for k in ("prompt_tokens", "completion_tokens")}


@dataclass(frozen=True)
class HttpModel:
    """A model server with /api/embed and /api/chat; one endpoint for both. Retried tasks may ask again."""

    host: str
    name: str
    width: int = 768
    temperature: float = 0.3
    context_length: int = 32_768
    timeout: float = 300.0

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.host.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._post("/api/embed", {"model": self.name, "input": texts})["embeddings"]

    def complete(self, messages: list[dict]) -> dict:
        options = {"temperature": self.temperature, "num_ctx": self.context_length}
        r = self._post("/api/chat", {"model": self.name, "messages": messages, "stream": False, "options": options})
        return {"content": r["message"]["content"], "prompt_tokens": r.get("prompt_eval_count", 0), "completion_tokens": r.get("eval_count", 0)}

    def stream(self, messages: list[dict]) -> Generator[str, None, dict | None]:
        """The reply in pieces, as the server sends them, and the counts that come with the last; on the driver only."""
        body = {"model": self.name, "messages": messages, "stream": True, "options": {"temperature": self.temperature, "num_ctx": self.context_length}}
        request = urllib.request.Request(self.host.rstrip("/") + "/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            for line in reply:
                piece = json.loads(line)
                if text := piece.get("message", {}).get("content"):
                    yield text
                if piece.get("done"):
                    return {"prompt_tokens": piece.get("prompt_eval_count", 0), "completion_tokens": piece.get("eval_count", 0)}

    def info(self) -> dict | None:
        """What the server knows of the model; None on any error."""
        try:
            return self._post("/api/show", {"model": self.name})
        except (OSError, ValueError):
            return None

    def is_available(self) -> bool:
        """Whether the server has the model, tags ignored; False on any error."""
        try:
            with urllib.request.urlopen(self.host.rstrip("/") + "/api/tags", timeout=5) as reply:
                return self.name.split(":")[0] in {m["name"].split(":")[0] for m in json.load(reply).get("models", [])}
        except (OSError, ValueError, KeyError):
            return False


class Streamed:
    """A reply in pieces, to be iterated once; its content and counts are there when it has ended."""

    def __init__(self, completer: Completer, messages: list[dict]):
        self.model, self.content, self.prompt_tokens, self.completion_tokens = completer.name, "", 0, 0
        self._pieces = completer.stream(messages) if hasattr(completer, "stream") else self._whole(completer, messages)

    @staticmethod
    def _whole(completer: Completer, messages: list[dict]) -> Generator[str, None, dict]:
        reply = completer.complete(messages)
        yield reply["content"]
        return reply

    def _run(self) -> Generator[str, None, None]:
        pieces = iter(self._pieces)
        while True:
            try:
                piece = next(pieces)
            except StopIteration as end:
                counts = end.value or {}
                self.prompt_tokens, self.completion_tokens = counts.get("prompt_tokens") or 0, counts.get("completion_tokens") or 0
                return
            self.content += piece
            yield piece

    def __iter__(self) -> Iterator[str]:
        return self._run()

    @property
    def total_tokens(self) -> int:
        return self.prompt_tokens + self.completion_tokens


def embed(text: Column, embedder: Embedder, batch: int = 32) -> Column:
    """The embedder's vectors as ARRAY<FLOAT>, asked in batches; a null text has a null vector."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            known = texts.dropna()
            vectors: list = []
            for lo in range(0, len(known), batch):
                vectors += embedder.embed(known.iloc[lo : lo + batch].tolist())
            yield pd.Series(vectors, index=known.index, dtype=object).reindex(texts.index).where(lambda s: s.notna(), None)

    return run(text)


def complete(messages: Column, completer: Completer) -> Column:
    """The completer's replies as a struct; a null or empty message list has a null reply."""

    @F.pandas_udf(RESPONSE)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in parts:
            rows = []
            for m in lists:
                if m is None or not len(m):
                    rows.append((None, None, None, None, None))
                    continue
                r = completer.complete([{"role": x["role"], "content": x["content"]} for x in m])
                p, c = r.get("prompt_tokens") or 0, r.get("completion_tokens") or 0
                rows.append((r["content"], completer.name, p, c, p + c))
            yield pd.DataFrame(rows, columns=RESPONSE.names)

    return run(messages)
