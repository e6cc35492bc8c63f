"""Documents into chunks, segments and frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..kernels import markdown
from ..kernels.boundaries import packed, pieces, split
from ..kernels.chunking import chunk
from ..kernels.events import tag_texts

DEFAULT_BOUNDARIES = ("paragraph", "sentence", "line_break", "word", "character")


def _exploded(df: DataFrame, text_col: str, fields: str, kernel) -> DataFrame:
    """df with a row for each tuple that kernel(text) gives, in the columns `fields`."""
    names = [f.split()[0] for f in fields.split(", ")]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), fields])
    kinds = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows, at = [], []
                for i, t in enumerate(part.column("_text").to_pylist()):
                    found = kernel(t)
                    rows += found
                    at += [i] * len(found)
                old = [part.column(f.name).take(pa.array(at, pa.int64())) for f in kept]
                new = [pa.array([r[j] for r in rows], kinds[f.split()[1]]) for j, f in enumerate(fields.split(", "))]
                yield pa.RecordBatch.from_arrays([*old, *new], [*(f.name for f in kept), *names])

    return df.select(*[f.name for f in kept], F.col(text_col).alias("_text")).mapInArrow(run, schema)


def markdown_chunk(docs: DataFrame, size: int | None = 1600, overlap: float = 0.5, max_snap: float | None = None, segment_levels: Sequence[int] = (), text_col: str = "text") -> DataFrame:
    """docs without their text, a row for each chunk: start, end (code points from 1, inclusive), context, text.

    Chunks cover a document; their ends lie at headings, paragraphs, sentences, lines or words near evenly spaced
    targets. No chunk crosses a heading of segment_levels. context has the headings in scope, by level. Null and
    empty texts have no chunks.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    levels = tuple(segment_levels)
    return _exploded(docs, text_col, "start int, end int, context string, text string", lambda t: chunk(t or "", size, overlap, max_snap, levels))


def markdown_segment(docs: DataFrame, tags: Sequence[str] = ("h1", "h2", "h3", "h4"), trim: bool = False, omit_empty: bool = False, text_col: str = "text") -> DataFrame:
    """docs without their text, a row for each piece between the starts and ends of the tags: pos, tag, text."""
    names = list(tags)
    return _exploded(docs, text_col, "pos int, tag string, text string", lambda t: [(i, g, x) for i, (g, x) in enumerate(markdown.segments(t or "", names, trim, omit_empty))])


def split_text(docs: DataFrame, size: int = 1600, boundaries: Sequence[str] = DEFAULT_BOUNDARIES, trim: bool = True, text_col: str = "text") -> DataFrame:
    """docs without their text, a row for each piece: pos, text; split at ever finer boundaries until pieces fit."""
    kinds = list(boundaries)
    return _exploded(docs, text_col, "pos int, text string", lambda t: list(enumerate(split(t, size, kinds, trim))))


def segment_text(docs: DataFrame, boundaries: Sequence[str] = ("sentence",), trim: bool = False, text_col: str = "text") -> DataFrame:
    """docs without their text, a row for each piece between boundaries: pos, text."""
    kinds = list(boundaries)
    return _exploded(docs, text_col, "pos int, text string", lambda t: list(enumerate(pieces(t, kinds, trim))))


def pack_segments(docs: DataFrame, segments_col: str, size: int = 1600, glue: str = "") -> DataFrame:
    """docs without their array of segments, a row for each pack of neighbours that fit in size: pos, text."""
    rows = docs.drop("text").withColumnRenamed(segments_col, "text") if segments_col != "text" else docs
    return _exploded(rows, "text", "pos int, text string", lambda parts: list(enumerate(packed(parts or [], size, glue))))


def frame(segments: DataFrame, keys: Sequence[str], nodes: Sequence[str] = ("h1", "h2", "h3"), names: str = "tag", leaves: str = "text", pos: str = "pos") -> DataFrame:
    """A flattened tree as rows: keys, pos, a column for each node level, names, leaves.

    A piece belongs to the last node of each level before it; a node of a level ends those of finer levels. Node
    rows with something below them are dropped, as are empty leaves; a childless node keeps one row with null leaf.
    """
    if len({*nodes, names, leaves}) < len(nodes) + 2:
        raise ValueError("target names must be unique")
    w = Window.partitionBy(*keys).orderBy(pos)
    level = F.coalesce(*[F.when(F.col(names) == n, F.lit(i)) for i, n in enumerate(nodes)], F.lit(len(nodes)))
    rows = segments.withColumn("_level", level)
    for i, n in enumerate(nodes):
        seen = F.last(F.when(F.col("_level") <= i, F.struct(F.when(F.col("_level") == i, F.col(leaves)).alias("t"))), ignorenulls=True).over(w)
        rows = rows.withColumn(f"_n{i}", seen["t"])
    rows = rows.withColumns({"_next": F.lead("_level").over(w), "_leaf": F.col("_level") == len(nodes)})
    childless = F.coalesce(F.col("_next") <= F.col("_level"), F.lit(True))
    kept = rows.where((F.col("_leaf") & (F.coalesce(F.col(leaves), F.lit("")) != "")) | (~F.col("_leaf") & childless))
    return kept.select(*keys, pos, *[F.col(f"_n{i}").alias(n) for i, n in enumerate(nodes)], F.when(F.col("_leaf"), F.col(names)).alias(names), F.when(F.col("_leaf"), F.col(leaves)).alias(leaves))


def html_segments(pages: DataFrame, tags: Sequence[str] = ("h1", "h2", "h3", "p"), html_col: str = "html") -> DataFrame:
    """pages without their html, a row for each piece: pos, tag, text. Pieces are the elements of the tags and what is between
    them, which has an empty tag; see kernels.events. Null html has no rows; elements may be nested to any depth."""
    listed = list(tags)
    rows = pages.drop(*[c for c in ("pos", "tag", "text") if c != html_col]).withColumnRenamed(html_col, "text")
    return _exploded(rows, "text", "pos int, tag string, text string", lambda h: [(i, t, x) for i, (t, x) in enumerate(tag_texts(h, listed))])


def html_frame(pages: DataFrame, keys: Sequence[str], frame_by: Sequence[str] = ("h1", "h2", "h3"), split_by: Sequence[str] | None = None, html_col: str = "html") -> DataFrame:
    """The pieces of html_segments() as rows under the elements of frame_by, as frame() has them. Without further tags in split_by
    there is no column for these."""
    split_by = list(frame_by if split_by is None else split_by)
    pieces_of = html_segments(pages.select(*keys, html_col), [*dict.fromkeys([*split_by, *frame_by])], html_col)
    out = frame(pieces_of, keys, frame_by)
    return out.drop("tag") if set(split_by) == set(frame_by) else out


def chunk_targets(docs: DataFrame, length: Column, size: int, step: int) -> DataFrame:
    """Columns of docs and the evenly spaced (start, end) targets of a document of that length, without segments."""
    last = length - size + 1
    starts = F.when(last < 1, F.array(F.lit(1).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1)).cast("long"), F.lit(step).cast("long")), F.array(F.greatest(last, F.lit(1)).cast("long")))))
    return docs.withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size - 1, F.greatest(length, F.lit(1)).cast("long")))
