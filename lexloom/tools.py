"""Retrieval as a tool for language models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from .store import Store


class RetrievalTool:
    """Calls return excerpts as JSON rows and never the same chunk twice."""

    def __init__(self, store: Store, top_k: int = 3, name: str | None = None):
        self.store, self.top_k, self.seen = store, top_k, set()
        self.name = name or f"search_{store.name}"

    def description(self) -> dict:
        text = f"Search {self.store.title or self.store.name} for excerpts that fit the queries. Words are stemmed; excerpts of earlier calls are left out."
        return {"name": self.name, "description": text, "input_schema": {"type": "object", "properties": {"texts": {"type": "array", "items": {"type": "string"}}}, "required": ["texts"]}}

    def __call__(self, texts: str | Sequence[str]) -> list[str]:
        seen = self.store.spark.createDataFrame([(i,) for i in sorted(self.seen)], "chunk_id long") if self.seen else None
        found = self.store.retrieve(texts, self.top_k, exclude=seen)
        rows = found.drop("cosine_distance", "bm25").select("chunk_id", F.to_json(F.struct(*[c for c in found.columns if c not in ("cosine_distance", "bm25")]), {"ignoreNullFields": "false"}).alias("json")).collect()
        self.seen |= {i for r in rows for i in r["chunk_id"]}
        return [r["json"] for r in rows]
