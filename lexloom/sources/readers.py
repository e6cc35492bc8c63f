"""Files of several formats as Markdown documents."""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_markdown
from ..kernels.html import to_markdown
from .fetch import Fetcher

#: Converters of other formats (PDF, Office, ...): file ending -> function of the file's bytes.
Plugins = dict[str, Callable[[bytes], str]]


def _table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    cell = lambda x: str(x).replace("|", r"\|").replace("\n", " ")
    width = max(map(len, rows))
    lines = ["| " + " | ".join(map(cell, [*r, *[""] * (width - len(r))])) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def convert(name: str, data: bytes, extract: Sequence[str], zap: Sequence[str], plugins: Plugins) -> list[tuple[str, str]]:
    """(name, Markdown) of a file; of a zip, each of its files. Unknown endings count as text."""
    end = os.path.splitext(name)[1].lower().lstrip(".")
    if end in plugins:
        return [(name, plugins[end](data))]
    if end == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [x for i in z.infolist() if not i.is_dir() for x in convert(f"{name}!/{i.filename}", z.read(i), extract, zap, plugins)]
    text = data.decode("utf-8-sig", errors="replace")
    if end in ("html", "htm", "xhtml"):
        text = to_markdown(text, tuple(extract), tuple(zap))
    elif end == "csv":
        text = _table(list(csv.reader(io.StringIO(text))))
    elif end == "json":
        text = f"```json\n{json.dumps(json.loads(text), indent=2, ensure_ascii=False)}\n```"
    elif end == "xml":
        text = f"```xml\n{text.strip()}\n```"
    return [(name, text)]


def read_as_markdown(spark: SparkSession, path: str | Sequence[str], extract: Sequence[str] = ("main",), zap: Sequence[str] = ("nav",), plugins: Plugins | None = None) -> DataFrame:
    """(origin, text, problem): the files that path (with wildcards) names, as normalised Markdown.

    A file that can't be converted has its problem and a null text; others go on.
    """
    own = plugins or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows = [(n, t, None) for n, t in convert(name, data, extract, zap, own)]
                except Exception as e:  # kept as a column
                    rows = [(name, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["origin", "text", "problem"])

    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "origin string, text string, problem string").withColumn("text", normalize_markdown(F.col("text")))


def pages_as_markdown(pages: DataFrame, extract: Sequence[str] = ("main",), zap: Sequence[str] = ("nav",), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(origin, text, problem) of a table of pages. A page that can't be converted has its problem and a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, problems = [], []
            for h in b.column("html").to_pylist():
                try:
                    texts.append(to_markdown(h, tuple(extract), tuple(zap)))
                    problems.append(None)
                except Exception as e:  # kept as a column
                    texts.append(None)
                    problems.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("origin"), pa.array(texts, pa.string()), pa.array(problems, pa.string())], ["origin", "text", "problem"])

    rows = pages.select(F.col(url_col).alias("origin"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "origin string, text string, problem string").withColumn("text", normalize_markdown(F.col("text")))


#: Media types -> file ending that convert() goes by; others go by their second part. Fixed values.
_ENDINGS = {"text/html": "html", "application/xhtml+xml": "html", "text/csv": "csv", "application/json": "json", "application/xml": "xml", "text/xml": "xml", "application/zip": "zip", "text/plain": "txt", "text/markdown": "md"}


def urls_as_markdown(fetcher: Fetcher, urls: DataFrame, extract: Sequence[str] = ("main",), zap: Sequence[str] = ("nav",), plugins: Plugins | None = None) -> DataFrame:
    """(origin, text, problem) of urls(url): what they lead to, as normalised Markdown by media type. origin is the url that was given. A url without
    a page and one that can't be converted have their problem and a null text; a zip has a row for each of its files."""
    own = plugins or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, media, html, content, problem in zip(*(b.column(c).to_pylist() for c in ("url", "media_type", "html", "content", "problem"))):
                try:
                    end = _ENDINGS.get(media or "", (media or "").partition("/")[2])
                    data = content if html is None else html.encode()
                    if problem is None and html is None and end != "zip" and end not in own:
                        raise ValueError(f"no converter for {media}")
                    rows = [(url, None, problem)] if problem else [(url + n.removeprefix(f"page.{end}"), t, None) for n, t in convert(f"page.{end}", data, extract, zap, own)]
                except Exception as e:  # kept as a column
                    rows = [(url, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["origin", "text", "problem"])

    got = fetcher.fetch(urls).select("url", "media_type", "html", "content", "problem")
    return got.mapInArrow(run, "origin string, text string, problem string").withColumn("text", normalize_markdown(F.col("text")))


def transcript_text(df: DataFrame, snippets_col: str = "snippets", formatter: Callable[[Column], Column] = lambda s: s["text"], glue: str = " ") -> DataFrame:
    """df with the text of transcripts array<struct<text, start, duration>>, by start; empty ones give empty texts. The formatter
    turns a snippet, a struct Column of these three, into its text."""
    fields = df.schema[snippets_col].dataType.elementType.names
    first = ["start", *(f for f in ("text", "duration") if f in fields)]
    ordered = F.array_sort(F.transform(snippets_col, lambda s: F.struct(*[s[f].alias(f) for f in first])))
    return df.withColumn("text", F.array_join(F.transform(ordered, formatter), glue))
