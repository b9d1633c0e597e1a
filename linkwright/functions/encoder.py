"""Encoders: texts to vectors, in Arrow batches."""

from __future__ import annotations

import json
import math
import os
import select
import struct
import subprocess
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def hashed_ngrams(text: str | None, dim: int = 64, sizes: tuple[int, ...] = (2, 3)) -> list[float]:
    """A unit vector of hashed character n-grams: deterministic, no model needed; the empty text gives zeros."""
    clean = f" {' '.join((text or '').lower().split())} "
    out = [0.0] * dim
    if clean.strip():
        for n in sizes:
            for k in range(len(clean) - n + 1):
                h = zlib.crc32(clean[k : k + n].encode())
                out[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


class EncoderRefusal(ValueError):
    """A whole batch that the encoder process answered with an error: final, not tried again."""


class Remote:
    """A client of an encoder process, by lines of JSON and binary trailers.

    Fixed values of the protocol, version 1: within 30 s of its start the process sends
    {"type": "handshake", "protocol_version": 1, "vector_dim": d, "model_id": m}. A request is
    {"type": "encode", "texts": [...]}; its answer {"type": "encode_response", "results": [{"ok": true} or {"error": m}, ...],
    "vector_count": n, "vector_dim": d}, then, if n is not 0, a little-endian u32 length and as many bytes of
    little-endian f32, the vectors of the texts that succeeded, in order; or {"error": m} for the whole batch.

    Texts with an error get null. A process that ends, breaks the protocol or is silent for `timeout` seconds is started
    again, `retries` times a call.
    """

    def __init__(self, command: list[str], retries: int = 2, timeout: float = 60.0, greeting: float = 30.0):
        self.command, self.retries, self.timeout, self.greeting = command, retries, timeout, greeting
        self.process, self.dim, self.model, self.held = None, None, None, b""

    def _start(self) -> subprocess.Popen:
        if self.process is None or self.process.poll() is not None:
            self.process, self.held = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE), b""
            hello = json.loads(self._line(time.monotonic() + self.greeting))
            dim, model = hello.get("vector_dim"), hello.get("model_id")
            if hello.get("type") != "handshake" or hello.get("protocol_version") != 1 or not isinstance(dim, int) or dim < 1 or not model:
                raise ValueError(f"no handshake of protocol 1: {hello}")
            if self.dim not in (None, dim):
                raise ValueError(f"the encoder had {self.dim} dimensions and now has {dim}")
            self.dim, self.model = dim, model
        return self.process

    def _more(self, until: float) -> None:
        """Read what is there; an error if nothing comes in time or the process has ended."""
        ready, _, _ = select.select([self.process.stdout], [], [], max(0.0, until - time.monotonic()))
        if not ready:
            raise TimeoutError(f"the encoder did not answer within {self.timeout} s")
        part = os.read(self.process.stdout.fileno(), 1 << 20)
        if not part:
            raise BrokenPipeError("the encoder has ended")
        self.held += part

    def _line(self, until: float) -> bytes:
        while b"\n" not in self.held:
            self._more(until)
        line, self.held = self.held.split(b"\n", 1)
        return line

    def _bytes(self, n: int, until: float) -> bytes:
        while len(self.held) < n:
            self._more(until)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def _answer(self, texts: list[str]) -> list[list[float] | None]:
        p = self._start()
        p.stdin.write(json.dumps({"type": "encode", "texts": texts}).encode() + b"\n")
        p.stdin.flush()
        until = time.monotonic() + self.timeout
        head = json.loads(self._line(until))
        if "results" not in head and "error" in head:
            raise EncoderRefusal(str(head["error"]))
        good = [bool(r.get("ok")) for r in head["results"]]
        n = head.get("vector_count", 0)
        if head.get("type") != "encode_response" or len(good) != len(texts) or n != sum(good) or (n and head.get("vector_dim") != self.dim):
            raise ValueError("the answer does not fit the request")
        flat: tuple = ()
        if n:
            size = struct.unpack("<I", self._bytes(4, until))[0]
            if size != 4 * n * self.dim:
                raise ValueError(f"a trailer of {size} bytes for {n} vectors")
            flat = struct.unpack(f"<{n * self.dim}f", self._bytes(size, until))
        rows = iter([list(flat[k : k + self.dim]) for k in range(0, len(flat), self.dim)])
        return [next(rows) if ok else None for ok in good]

    def encode(self, texts: list[str]) -> list[list[float] | None]:
        for attempt in range(self.retries + 1):
            try:
                return self._answer(texts)
            except EncoderRefusal:
                raise
            except (OSError, ValueError, KeyError, struct.error):  # a time-out and a broken pipe are OSErrors
                if self.process is not None:
                    self.process.kill()
                    self.process.wait()
                    self.process = None
                if attempt == self.retries:
                    raise
        return []

    def close(self) -> None:
        if self.process is not None:
            self.process.stdin.close()
            self.process.wait()
            self.process.stdout.close()
            self.process = None


def onnx_encoder(path: str, tokenizer_path: str, dim: int | None = None) -> Callable[[list[str]], list[list[float]]]:
    """A sentence encoder from a local ONNX model and tokenizer: mean of the last layer over the tokens, unit length."""
    import numpy as np
    import onnxruntime
    from tokenizers import Tokenizer

    session, tokenizer = onnxruntime.InferenceSession(path), Tokenizer.from_file(tokenizer_path)
    tokenizer.enable_padding()
    wanted = {i.name for i in session.get_inputs()}

    def encode(texts: list[str]) -> list[list[float]]:
        batch = tokenizer.encode_batch(texts)
        ids, mask = (np.array([getattr(e, n) for e in batch], dtype=np.int64) for n in ("ids", "attention_mask"))
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        out = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
        mean = (out * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1)[:, None], 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1)[:, None], 1e-12))[:, :dim].tolist()

    return encode


def encoded(text: Column, make: Callable[[], Callable[[list[str]], list]] | None = None, dim: int = 64, batch: int = 256) -> Column:
    """The vectors of a text column. `make` builds an encoder once per task; by default character n-grams are hashed."""

    @pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make() if make else lambda texts: [hashed_ngrams(t, dim) for t in texts]
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in encode(texts[k : k + batch])], dtype=object)

    return run(text)
