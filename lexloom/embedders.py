"""Embedders: a specification that a store keeps, and texts to vectors in the tasks.

A provider is a request builder and a reader of its answer; the HTTP transport is passed in, so that nothing here
needs a network. Without one, ``hashing`` maps texts to vectors by the hashes of their words.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (url, headers, body) -> decoded JSON answer.
Transport = Callable[[str, dict, dict], dict]


@dataclass(frozen=True)
class Embedder:
    """What is needed to embed again with the same model: provider, model and settings; no code, no keys."""

    provider: str = "hashing"
    model: str = ""
    settings: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Embedder:
        return Embedder(**json.loads(text))


#: provider: default model, texts a request, path of the request. Fixed values of the public interfaces.
PROVIDERS = {
    "ollama": ("embeddinggemma:300m", 10, "/api/embed"),
    "openai": ("text-embedding-3-small", 20, "/embeddings"),
    "lm_studio": ("", 20, "/embeddings"),
    "azure_openai": ("", 20, "/openai/deployments/{model}/embeddings?api-version={api_version}"),
    "databricks": ("databricks-bge-large-en", 512, "/serving-endpoints/{model}/invocations"),
    "google_gemini": ("gemini-embedding-001", 20, "/v1beta/models/{model}:batchEmbedContents"),
    "google_vertex": ("text-embedding-005", 20, "/v1/projects/{project_id}/locations/{location}/publishers/google/models/{model}:predict"),
    "snowflake": ("snowflake-arctic-embed-m-v1.5", 512, "/api/v2/cortex/inference:embed"),
    "bedrock": ("cohere.embed-v4:0", 20, "/model/{model}/invoke"),
}


def request(spec: Embedder, texts: list[str]) -> tuple[str, dict]:
    """(URL, body) of one request."""
    model, _, path = PROVIDERS[spec.provider]
    model, s = spec.model or model, spec.settings
    url = s.get("base_url", "").rstrip("/") + path.format(**{"api_version": "", "project_id": "", "location": "", **s, "model": model})
    if spec.provider == "google_gemini":
        more = {"outputDimensionality": int(s["dims"])} if "dims" in s else {}
        more |= {"taskType": s["task_type"]} if "task_type" in s else {}
        return url, {"requests": [{"model": f"models/{model}", "content": {"parts": [{"text": t}]}, **more} for t in texts]}
    if spec.provider == "google_vertex":
        return url, {"instances": [{"content": t, **({"task_type": s["task_type"]} if "task_type" in s else {})} for t in texts]}
    if spec.provider == "bedrock":
        return url, {"texts": texts, "input_type": s.get("input_type", "search_document")} if "cohere" in model else {"inputText": texts[0]}
    if spec.provider == "snowflake":
        return url, {"model": model, "text": texts}
    body = {"input": texts} if spec.provider in ("databricks", "azure_openai") else {"model": model, "input": texts}
    if "dims" in s:
        body["dimensions"] = int(s["dims"])
    if "user" in s and spec.provider in ("openai", "azure_openai"):
        body["user"] = s["user"]
    return url, body


def texts_a_request(spec: Embedder) -> int:
    """Texts of one request; some models take one only."""
    model = spec.model or PROVIDERS[spec.provider][0]
    if spec.provider == "bedrock" and "titan" in model or spec.provider == "google_vertex" and model.startswith("gemini"):
        return 1
    return int(spec.settings.get("batch_size", PROVIDERS[spec.provider][1]))


def vectors(spec: Embedder, answer: dict) -> list[list[float]]:
    """The vectors of an answer, in the order of the texts."""
    if spec.provider == "google_gemini":
        return [e["values"] for e in answer["embeddings"]]
    if spec.provider == "google_vertex":
        return [p["embeddings"]["values"] for p in answer["predictions"]]
    if spec.provider == "bedrock":
        found = answer.get("embeddings", answer.get("embedding"))
        return found["float"] if isinstance(found, dict) else found if isinstance(found[0], list) else [found]
    if "embeddings" in answer:
        return answer["embeddings"]
    rows = sorted(answer["data"], key=lambda d: d.get("index", 0))
    return [r["embedding"][0] if isinstance(r["embedding"][0], list) else r["embedding"] for r in rows]


def hashed(text: str, dims: int) -> list[float]:
    """A unit vector from the words of a text, the same on every machine."""
    out = [0.0] * dims
    for w in re.findall(r"\w+", text.lower()) or [""]:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % dims] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(math.fsum(x * x for x in out)) or 1.0
    return [x / n for x in out]


def embed_texts(spec: Embedder, texts: list[str], transport: Transport | None = None, tries: int = 3) -> list[list[float]]:
    """Vectors of texts, in requests of the provider's size; a failed request (OSError, as HTTP errors and time-outs are) is tried
    again up to `tries` times, unless the setting `max_seconds` have passed since its first try (10 by default)."""
    if spec.provider == "hashing":
        return [hashed(t, int(spec.settings.get("dims", 64))) for t in texts]
    if spec.provider not in PROVIDERS:
        raise ValueError(f"unknown provider {spec.provider!r}")
    if transport is None:
        raise ValueError(f"{spec.provider} needs a transport")
    size, limit = texts_a_request(spec), float(spec.settings.get("max_seconds", 10))
    out: list[list[float]] = []
    for lo in range(0, len(texts), size):
        url, body = request(spec, texts[lo : lo + size])
        began = time.monotonic()
        for n in range(tries):
            try:
                out += vectors(spec, transport(url, dict(spec.settings.get("headers", {})), body))
                break
            except OSError:
                if n + 1 == tries or time.monotonic() - began + 2**n > limit:
                    raise
                time.sleep(min(10, 2**n))
    if len(out) != len(texts):
        raise ValueError("the provider gave another number of vectors than texts")
    return out


def with_embeddings(df: DataFrame, spec: Embedder, text_col: str = "text", transport: Transport | None = None) -> DataFrame:
    """df with the column embedding, an array of float; null texts have null vectors. Calls are made in the tasks."""
    kept = [f for f in df.schema.fields if f.name != "embedding"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "embedding array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            there = [i for i, t in enumerate(texts) if t is not None]
            found: list = [None] * len(texts)
            for i, v in zip(there, embed_texts(spec, [texts[i] for i in there], transport)):
                found[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(found, pa.list_(pa.float32()))], [*(f.name for f in kept), "embedding"])

    return df.select(*[f.name for f in kept], F.col(text_col).alias("_text")).mapInArrow(run, schema)
