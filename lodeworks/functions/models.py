"""Model interfaces with deterministic defaults that need no network."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HtmlExtractor(Protocol):
    def extract(self, html: str) -> tuple[str, list[str]]: ...


class PdfExtractor(Protocol):
    def extract(self, data: bytes) -> list[str]:
        """The text of each page; an empty list where nothing can be read."""
        ...


class HashEmbedder:
    """Hashed bag of tokens with signs, scaled to length 1."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_udf(model: Embedder):
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.encode(texts.tolist()).astype(np.float32)))

    return embed


def encode_batch(model: Embedder, size: int = 32):
    """Iterator function for mapInPandas: adds `dense` and `sparse` to rows with `text`, `size` texts at a time; the model loads once a task."""

    def encode(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size].copy()
                texts = [t or "" for t in part["text"].tolist()]
                part["dense"] = list(model.encode(texts).astype(np.float32))
                part["sparse"] = [dict(Counter(_TOKEN.findall(t.lower()))) for t in texts]
                yield part

    return encode


_TOKEN = re.compile(r"[^\W_]+")


def packed(lengths: list[int], budget: int) -> list[list[int]]:
    """Places of texts in batches for a model that pads to its longest text: by length, the longest first, so that longest * count stays
    within the budget; a text beyond the budget is a batch of its own."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out: list[list[int]] = []
    for i in order:
        if out and (len(out[-1]) + 1) * max(1, lengths[out[-1][0]]) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def encode_packed(model: Embedder, budget: int = 16_384):
    """Iterator function for mapInPandas: adds `dense` and `sparse` to rows with `text`, in batches by length up to a budget of tokens.

    Rows keep their order; null and blank texts get null vectors and never reach the model.
    """

    def encode(batches):
        for pdf in batches:
            found = [Counter(_TOKEN.findall((t or "").lower())) for t in pdf["text"].tolist()]
            some = [i for i, c in enumerate(found) if c]
            dense: list = [None] * len(pdf)
            for batch in packed([found[i].total() for i in some], budget):
                at = [some[i] for i in batch]
                for i, v in zip(at, model.encode([pdf["text"].iloc[i] for i in at]).astype(np.float32)):
                    dense[i] = v
            yield pdf.assign(dense=dense, sparse=[dict(c) if c else None for c in found])

    return encode


class OverlapReranker:
    """The stand-in cross-encoder: the share of the question's words that the text holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            asked = set(_TOKEN.findall((q or "").lower()))
            out.append(len(asked & set(_TOKEN.findall((t or "").lower()))) / max(1, len(asked)))
        return out


def rerank_udf(model: Reranker):
    """A column function of (question, text): a score; null where the model fails, so that retrieval order stays."""

    @F.pandas_udf("double")
    def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(model.score(list(zip(questions, texts))), dtype="float64")
        except Exception:  # noqa: BLE001 - any failure of a model falls back to the order of retrieval
            return pd.Series([None] * len(texts), dtype="float64")

    return score


class ExtractiveModel:
    """The stand-in text model: of a prompt `CONTEXT:...QUESTION:...`, the context's sentence that shares most words with the question."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            context, _, question = (p or "").rpartition("QUESTION:")
            asked = set(_TOKEN.findall(question.lower()))
            parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context.replace("CONTEXT:", "")) if s.strip()]
            out.append(max(parts, key=lambda s: len(asked & set(_TOKEN.findall(s.lower()))), default=""))
        return out


def complete_udf(model: TextModel):
    """A column function of a prompt: the model's answer, batch by batch."""

    @F.pandas_udf("string")
    def complete(prompts: pd.Series) -> pd.Series:
        return pd.Series(model.complete([p or "" for p in prompts.tolist()]), dtype=object)

    return complete


class StreamTextExtractor:
    """Texts of simple PDFs without a library: literal and hexadecimal strings that are shown in plain or deflated streams, a page a stream."""

    _STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
    _SHOW = re.compile(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|\bET\b)", re.S)
    _STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>", re.S)
    _ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
    _NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def _unescaped(self, m) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if x.isdigit() else b"" if x.endswith(b"\n") else self._NAMED.get(x, x)

    def _shown(self, m) -> str:
        if m.group(2) is not None:
            digits = re.sub(rb"\s", b"", m.group(2))
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            raw = self._ESCAPE.sub(self._unescaped, m.group(1))
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")

    def extract(self, data: bytes) -> list[str]:
        out = []
        for m in self._STREAM.finditer(data):
            body = m.group(1)
            try:
                body = zlib.decompress(body)
            except zlib.error:
                pass
            parts = []
            for show in self._SHOW.finditer(body):
                if show.group(3):
                    parts.append("\n")
                parts += map(self._shown, self._STRING.finditer(show.group(1) or show.group(2) or b""))
            out.append("".join(parts))
        return out


class LibraryExtractor:
    """The pypdf library, where it is installed."""

    def extract(self, data: bytes) -> list[str]:
        from io import BytesIO

        from pypdf import PdfReader

        return [page.extract_text() for page in PdfReader(BytesIO(data)).pages]


def pdf_pages_udf(extractors: list[PdfExtractor]):
    """A column function of bytes: array<string> of the pages' texts, by the first extractor that finds any; one that fails finds none."""

    def read(data) -> list[str] | None:
        for e in extractors:
            try:
                found = [p or "" for p in e.extract(bytes(data))]
            except Exception:  # noqa: BLE001 - a broken file must not fail its batch
                continue
            if any(p.strip() for p in found):
                return found
        return None

    @F.pandas_udf("array<string>")
    def extract(files: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else read(x) for x in files], dtype=object)

    return extract


def sparse_weights(text):
    """Lexical weights: counts of tokens as map<string, int>, in the JVM, from one sort of the words."""
    words = F.array_sort(F.array_remove(F.split(F.lower(text), r"[^\p{L}0-9]+"), ""))
    heads = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"), (F.coalesce(F.get(w, i - 1), F.lit("")) != x).alias("new"))), lambda s: s["new"])
    counted = lambda w: F.transform(F.array(heads(w)), lambda h: F.transform(h, lambda s, i: F.struct(s["w"], F.coalesce(F.get(h, i + 1)["at"], F.size(w)) - s["at"])))
    return F.map_from_entries(F.flatten(F.flatten(F.transform(F.array(words), counted))))


def sparse_parts(weights):
    """A sparse vector as struct<indices, values>."""
    return F.struct(F.map_keys(weights).alias("indices"), F.transform(F.map_values(weights), lambda v: v.cast("float")).alias("values"))
