"""One query per operator, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import shared
from ..functions import text as tx
from ..embedders import Embedder, with_embeddings
from ..operators import ann, bm25, changes, chunk, crawl, knn, nearby, retrieve, segments
from ..sources.readers import pages_as_markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# vectors ------------------------------------------------------------------------------------------------------------

_ZERO = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_DISTANCE = {"cosine_distance": "list_cosine_distance", "euclidean_distance": "list_distance", "negative_inner_product": "list_negative_inner_product"}


def _of_zero(items: DataFrame) -> list[float]:
    return items.where("vec_id = 0").select("embedding").first()[0]


def _nearest_sql(method: str, k: int, where: str = "true") -> str:
    return f"SELECT vec_id, label, round({_DISTANCE[method]}(CAST(embedding AS DOUBLE[]), {_ZERO}), 6) AS metric_value FROM embeddings WHERE {where} ORDER BY {_DISTANCE[method]}(CAST(embedding AS DOUBLE[]), {_ZERO}), vec_id LIMIT {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("metric_value", 6).alias("metric_value"))


@query(_nearest_sql("cosine_distance", 5))
def vss_cosine(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return _rounded(knn.nearest(items, _of_zero(items), 5))


@query(_nearest_sql("euclidean_distance", 10))
def vss_euclidean(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return _rounded(knn.nearest(items, _of_zero(items), 10, "euclidean_distance"))


@query(_nearest_sql("negative_inner_product", 10))
def vss_neg_inner_product(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return _rounded(knn.nearest(items, _of_zero(items), 10, "negative_inner_product"))


@query(_nearest_sql("cosine_distance", 10, "label = 3"))
def vss_filtered(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return _rounded(knn.nearest(items, _of_zero(items), 10, where="label = 3"))


@query(_nearest_sql("cosine_distance", 1_000_000_000))
def vss_topk_gt_n(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return _rounded(knn.nearest(items, _of_zero(items), 1_000_000_000))


@query(f"""WITH seen AS (SELECT vec_id FROM embeddings ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), {_ZERO}), vec_id LIMIT 10)
{_nearest_sql("cosine_distance", 10, "vec_id NOT IN (SELECT vec_id FROM seen)")}""")
def vss_exclude_seen(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    zero = _of_zero(items)
    return _rounded(knn.nearest(items, zero, 10, exclude=knn.nearest(items, zero, 10)))


@query("""WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS m
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 9), vec_id) AS rank FROM d)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(m, 6) + 0.0 AS metric_value FROM r WHERE rank <= 10""")
def vss_batch(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    asked = items.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = knn.nearest_many(items, asked, 10, digits=9)
    return found.select("query_id", "vec_id", "rank", (F.round("metric_value", 6) + 0.0).alias("metric_value"))


def _probed(spark, sf_dir, share: float):
    """The vectors by cells in the shared folder, searched in a share of the cells."""
    items = table(spark, sf_dir, "embeddings")
    index = ann.build(items, shared.new_folder(spark, "vectors"))
    asked = items.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.nearest_many(asked, 10, round(share * len(index.centroids)), digits=9)
    return found.select("query_id", "vec_id", "rank", (F.round("metric_value", 6) + 0.0).alias("metric_value"))


@query("""WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS m
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 9), vec_id) AS rank FROM d)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(m, 6) + 0.0 AS metric_value FROM r WHERE rank <= 10""")
def vss_index(spark, sf_dir):
    """With all cells, the index gives what the exact search gives."""
    return _probed(spark, sf_dir, 1.0)


@query()
def vss_index_probed(spark, sf_dir):
    """Seven tenths of the cells: the table's vectors have no clusters; recall is measured in the tests."""
    return _probed(spark, sf_dir, 0.7)


# full text ----------------------------------------------------------------------------------------------------------


def _bm25_sql(queries: str, k: float = 1.2, b: float = 0.75, more: str = "", top: int = 10, where: str = "true") -> str:
    return f"""
WITH t AS (
  SELECT doc_id, unnest([x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') if x <> '']) AS term FROM documents
), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT d.doc_id, coalesce(n, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id) c ON d.doc_id = c.doc_id),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(len) AS average FROM l),
q AS (SELECT DISTINCT query_id, unnest([x for x in regexp_split_to_array(lower(text), '[^a-z]+') if x <> '']) AS term FROM ({queries})),
m AS (
  SELECT query_id, doc_id, count(*) AS have, sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k} + 1) / (tf + {k} * (1 - {b} + {b} * len / average))) AS m
  FROM p JOIN q USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY query_id, doc_id
), r AS (
  SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 9) DESC, doc_id) AS rank FROM m JOIN documents USING (doc_id)
  WHERE {where} {more}
)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(m, 5) AS score FROM r WHERE rank <= {top}"""


_ITEMS = "SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 50 = 0"


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def _all_asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _top(found: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("metric_value", 9)), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", F.round("metric_value", 5).alias("score"))


def _scored(spark, sf_dir, asked=None, **options) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = bm25.build(docs, "doc_id", ["text"])
    return bm25.score(index, _asked(spark, sf_dir) if asked is None else asked, **options).withColumnRenamed("id", "doc_id")


@query(_bm25_sql(_ITEMS))
def bm25_basic(spark, sf_dir):
    return _top(_scored(spark, sf_dir))


@query(_bm25_sql("SELECT item_id AS query_id, text FROM benchmark"))
def bm25_blocks(spark, sf_dir):
    """All items, from an index in two segments of blocks, of which only those are scored that can reach the top. Each document
    is in one segment, whatever its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    later = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    index = segments.write_segment(docs.where(~later), shared.new_folder(spark, "segment"), "doc_id", ["text"])
    index = index.add(shared.new_folder(spark, "segment"), docs.where(later), docs.where("false"), "doc_id", ["text"])
    return _top(index.top(_all_asked(spark, sf_dir), 10, digits=9).withColumnRenamed("id", "doc_id"))


@query(_bm25_sql(_ITEMS, 2.0, 0.3))
def bm25_params(spark, sf_dir):
    return _top(_scored(spark, sf_dir, k=2.0, b=0.3))


@query(_bm25_sql("SELECT 0 AS query_id, 'the and of' AS text", more="AND have = 3"))
def bm25_conjunctive(spark, sf_dir):
    asked = spark.createDataFrame([(0, "the and of")], "query_id int, text string")
    return _top(_scored(spark, sf_dir, asked, conjunctive=True))


@query(_bm25_sql(_ITEMS, where="lang = 'en'"))
def bm25_filtered(spark, sf_dir):
    found = _scored(spark, sf_dir).join(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return _top(found)


@query()
def bm25_porter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = bm25.build(docs, "doc_id", ["text"], stemmed=True, stop_words=True)
    return _top(bm25.top(index, _all_asked(spark, sf_dir), 10, digits=9).withColumnRenamed("id", "doc_id"))


@query("""
WITH t AS (SELECT doc_id, unnest([x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') if x <> '']) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY term""")
def bm25_dictionary(spark, sf_dir):
    found = segments.blocks(table(spark, sf_dir, "documents"), "doc_id", ["text"], False, False).where("term is not null")
    times = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.groupBy("term").agg(F.sum(F.size("ids")).cast("long").alias("df"), F.sum(times).cast("long").alias("total"))


@query(f"""
WITH v AS (SELECT vec_id AS doc_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), {_ZERO}) AS m FROM embeddings ORDER BY m, vec_id LIMIT 10),
b AS ({_bm25_sql(_ITEMS.replace("% 50 = 0", "= 0"))})
SELECT doc_id, round(v.m, 6) AS cosine_distance, b.score AS bm25 FROM v FULL OUTER JOIN b USING (doc_id)""")
def hybrid_wide(spark, sf_dir):
    items, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    near = knn.nearest(items, _of_zero(items), 10).select(F.col("vec_id").alias("doc_id"), "metric_name", "metric_value")
    asked = table(spark, sf_dir, "benchmark").where("item_id = 0").select(F.col("item_id").alias("query_id"), "text")
    scored = bm25.score(bm25.build(docs, "doc_id", ["text"]), asked)
    said = bm25.best(scored, 10, digits=9).select(F.col("id").alias("doc_id"), F.lit("bm25").alias("metric_name"), "metric_value")
    return retrieve.hybrid(near, said, ["doc_id"]).select("doc_id", F.round("cosine_distance", 6).alias("cosine_distance"), F.round("bm25", 5).alias("bm25"))


@query(f"""WITH r AS ({_bm25_sql(_ITEMS)})
SELECT doc_id, query_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_id) AS n FROM r) WHERE n = 1""")
def retrieve_multi_distinct(spark, sf_dir):
    return retrieve.first_of_each(_top(_scored(spark, sf_dir)), ["doc_id"], ["query_id"]).select("doc_id", "query_id", "score")


@query("""SELECT doc_id, max(CASE WHEN name = 'len' THEN v END) AS len, max(CASE WHEN name = 'lines' THEN v END) AS lines FROM (
  SELECT doc_id, 'len' AS name, length(text) AS v FROM documents UNION ALL
  SELECT doc_id, 'lines', length(text) - length(replace(text, chr(10), '')) + 1 FROM documents) GROUP BY doc_id""")
def pivot_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.length("text").cast("long")
    long = docs.select("doc_id", F.lit("len").alias("name"), n.alias("v")).union(docs.select("doc_id", F.lit("lines"), n - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1))
    return long.groupBy("doc_id").pivot("name", ["len", "lines"]).agg(F.first("v"))


# ranges of documents ------------------------------------------------------------------------------------------------

_RANGES = "(SELECT doc_id, source AS origin, i + 1 AS chunk_id, 1 + 60 * i AS start, least(1 + 60 * i + (doc_id * 7 + i * 37) % 100, greatest(length(text), 1)) AS \"end\", lang || i AS context FROM documents, unnest(range(CAST(length(text) // 60 + 1 AS BIGINT))) AS u(i))"
_ISLANDS = f"""WITH r AS {_RANGES}, o AS (
  SELECT *, CAST(start > coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end", chunk_id), -1) AS INT) AS opens FROM r
), g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, "end", chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT origin, doc_id, island, min(start) AS start, arg_max("end", start) AS "end", arg_min(context, start) AS context,
      string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY start) AS chunk_ids FROM g GROUP BY origin, doc_id, island)"""


def _ranges(docs: DataFrame) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("text") / 60)))
    rows = docs.select("doc_id", F.col("source").alias("origin"), "lang", F.length("text").alias("n"), i.alias("i"))
    end = F.least(1 + 60 * F.col("i") + (F.col("doc_id") * 7 + F.col("i") * 37) % 100, F.greatest("n", F.lit(1)))
    return rows.select("doc_id", "origin", (F.col("i") + 1).alias("chunk_id"), (1 + 60 * F.col("i")).alias("start"), end.alias("end"), F.concat("lang", F.col("i").cast("string")).alias("context"))


def _merged(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return retrieve.deoverlap(_ranges(docs), docs)


@query(_ISLANDS + ' SELECT origin, doc_id, chunk_ids, start, "end", context FROM m')
def deoverlap_islands(spark, sf_dir):
    return _merged(spark, sf_dir).select("origin", "doc_id", F.array_join(F.transform("chunk_id", lambda c: c.cast("string")), ",").alias("chunk_ids"), "start", "end", "context")


@query(_ISLANDS + ' SELECT m.doc_id, start, md5(text[start:"end"]) AS digest FROM m JOIN documents USING (doc_id)')
def deoverlap_text(spark, sf_dir):
    return _merged(spark, sf_dir).select("doc_id", "start", F.md5("text").alias("digest"))


@query(f'SELECT r.doc_id, chunk_id, origin, context, length(text[start:"end"]) AS n, md5(text[start:"end"]) AS digest FROM {_RANGES} r JOIN documents USING (doc_id)')
def chunk_view_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = tx.slice_text(F.col("text"), F.col("start"), F.col("end"))
    return _ranges(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "chunk_id", "origin", "context", F.length(text).cast("long").alias("n"), F.md5(text).alias("digest"))


@query("""WITH s AS (SELECT doc_id, greatest(length(text), 1) AS n FROM documents), t AS (
  SELECT doc_id, n, CASE WHEN n - 399 < 1 THEN [1] ELSE list_distinct(list_concat(range(1, n - 398, 200), [n - 399])) END AS starts FROM s)
SELECT doc_id, CAST(u AS BIGINT) AS start, CAST(least(u + 399, n) AS BIGINT) AS "end" FROM t, unnest(starts) AS x(u)""")
def chunk_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.length("text"), F.lit(1)).cast("long").alias("n"))
    return chunk.chunk_targets(docs, F.col("n"), 400, 200).select("doc_id", "start", "end")


@query(f"""WITH r AS {_RANGES}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start // 200 ORDER BY "end" DESC, chunk_id) AS n FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "end" // 200 ORDER BY start, chunk_id) AS k FROM a WHERE n = 1)
SELECT doc_id, chunk_id, start, "end" FROM b WHERE k = 1""")
def slice_max_min_dedupe(spark, sf_dir):
    rows = _ranges(table(spark, sf_dir, "documents"))
    widest = retrieve.first_of_each(rows, ["doc_id", F.floor(F.col("start") / 200)], [F.desc("end"), "chunk_id"])
    return retrieve.first_of_each(widest, ["doc_id", F.floor(F.col("end") / 200)], ["start", "chunk_id"]).select("doc_id", "chunk_id", "start", "end")


@query(f"""WITH r AS {_RANGES}, w AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM r)
SELECT w.doc_id FROM w JOIN documents USING (doc_id) GROUP BY w.doc_id HAVING bool_or(start > reach + 1) OR max("end") < max(length(text))""")
def coverage_gaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = _ranges(docs).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    return nearby.coverage_gaps(rows, ["doc_id"], F.col("n"))


# order ---------------------------------------------------------------------------------------------------------------


@query("""SELECT l.event_id, r.event_id AS last_event_id, r.event_type AS last_event_type
FROM (SELECT *, event_id AS id FROM events) l LEFT JOIN LATERAL (
  SELECT event_id, event_type FROM events x WHERE x.user_id = l.user_id AND x.ts < l.ts AND x.value > 50 ORDER BY ts DESC, event_id DESC LIMIT 1) r ON true""")
def asof_heading(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    marks = events.where("value > 50")
    found = nearby.last_before(events, marks, ["user_id"], "ts", ["event_id", "event_type"], bucket=F.to_date("ts"))
    return found.select("event_id", "last_event_id", "last_event_type")


@query("""WITH c AS (SELECT DISTINCT user_id, CAST(floor(value * 10) AS BIGINT) AS candidate FROM events WHERE event_type = 'click'),
p AS (SELECT event_id, user_id, CAST(floor(value * 10) AS BIGINT) AS point FROM events)
SELECT event_id, point, (SELECT candidate FROM c WHERE c.user_id = p.user_id AND abs(candidate - point) <= 25 ORDER BY abs(candidate - point), candidate DESC LIMIT 1) AS nearest FROM p""")
def snap_nearest(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("point", F.floor(F.col("value") * 10).cast("long"))
    some = events.where("event_type = 'click'").select("user_id", F.col("point").alias("candidate"))
    return nearby.nearest_within(events.select("event_id", "user_id", "point"), some, 25, keys=["user_id"]).select("event_id", "point", "nearest")


# changes -------------------------------------------------------------------------------------------------------------

# a load of all documents, French ones changed, against a store that lacks the Spanish ones and German origins
_NEW = "(SELECT doc_id, source AS origin, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM documents)"
_OLD = "(SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE source END AS origin, text FROM documents WHERE lang <> 'es')"


def _new(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "source AS origin", "CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text")


def _old(docs: DataFrame) -> DataFrame:
    return docs.where("lang <> 'es'").selectExpr("doc_id", "CASE WHEN lang = 'de' THEN NULL ELSE source END AS origin", "text")


@query(f"SELECT doc_id, origin, md5(text) AS digest FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.doc_id = n.doc_id AND o.origin IS NOT DISTINCT FROM n.origin AND o.text = n.text)")
def update_anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return changes.unknown(_new(docs), _old(docs), ["doc_id", "origin", "text"]).select("doc_id", "origin", F.md5("text").alias("digest"))


@query(f"SELECT origin, md5(text) AS digest FROM {_NEW} EXCEPT SELECT origin, md5(text) FROM {_OLD}")
def update_except(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _new(docs).select("origin", F.md5("text").alias("digest")).subtract(_old(docs).select("origin", F.md5("text")))


@query(f"SELECT doc_id, origin, md5(text) AS digest FROM {_NEW} UNION ALL SELECT doc_id, origin, md5(text) FROM {_OLD} WHERE doc_id NOT IN (SELECT doc_id FROM {_NEW})")
def upsert_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return changes.replaced(_old(docs), _new(docs), "doc_id").select("doc_id", "origin", F.md5("text").alias("digest"))


@query("SELECT doc_id, 1000 + row_number() OVER (ORDER BY source, doc_id) AS new_id FROM documents")
def insert_assign_ids(spark, sf_dir):
    return changes.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], "new_id", 1000).select("doc_id", "new_id")


_PATHS = "SELECT url AS origin FROM pages"
_KNOWN = "(SELECT DISTINCT url AS origin FROM pages WHERE url LIKE 'http:%')"


@query(f"SELECT origin, k.o IS NULL AS is_new_origin FROM (SELECT DISTINCT url AS origin FROM pages) p LEFT JOIN (SELECT origin AS o FROM {_KNOWN}) k ON p.origin = k.o")
def paths_new_flag(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return changes.interleaved(pages.select(F.col("url").alias("origin")), pages.where("url LIKE 'http:%'").select(F.col("url").alias("origin"))).select("origin", "is_new_origin")


@query(f"""WITH p AS (SELECT origin, k.o IS NULL AS is_new_origin FROM (SELECT DISTINCT url AS origin FROM pages) p LEFT JOIN (SELECT origin AS o FROM {_KNOWN}) k ON p.origin = k.o)
SELECT origin, is_new_origin, round(percent_rank() OVER (PARTITION BY is_new_origin ORDER BY origin), 9) AS position FROM p""")
def ingest_interleave(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = changes.interleaved(pages.select(F.col("url").alias("origin")), pages.where("url LIKE 'http:%'").select(F.col("url").alias("origin")))
    return found.select("origin", "is_new_origin", F.round("position", 9).alias("position"))


# text ----------------------------------------------------------------------------------------------------------------

_MD = "'# ' || source || '  ' || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || replace(text, chr(10), '  ' || chr(10) || chr(10))"


def markdown_view(docs: DataFrame) -> DataFrame:
    """Documents as Markdown with headings, blank lines and trailing blanks."""
    nl = F.lit("\n")
    text = F.concat(F.lit("# "), F.col("source"), F.lit("  \n\n## "), F.col("lang"), F.lit("\n\n"), F.replace("text", nl, F.lit("  \n\n")))
    return docs.select("doc_id", "source", "lang", text.alias("text"))


@query(f"SELECT doc_id, md5(regexp_replace({_MD}, '[ \\t]+(\\n|$)', '\\1', 'g')) AS digest FROM documents")
def normalize_markdown(spark, sf_dir):
    return markdown_view(table(spark, sf_dir, "documents")).select("doc_id", F.md5(tx.normalize_markdown(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def doc_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, length(parts[i]) AS n, md5(parts[i]) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)")
def line_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return rows.select("doc_id", (F.col("line") + 1).alias("line"), F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS paragraph, md5(parts[i]) AS digest FROM (SELECT doc_id, string_split({_MD}, chr(10) || chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)")
def paragraph_split(spark, sf_dir):
    rows = markdown_view(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("paragraph", "t"))
    return rows.select("doc_id", (F.col("paragraph") + 1).alias("paragraph"), F.md5("t").alias("digest"))


@query("""WITH t AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS lv FROM conversations), w AS (
  SELECT *, lead(lv) OVER (PARTITION BY conv_id ORDER BY turn) AS nx,
    max(CASE WHEN lv <= 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS t0,
    max(CASE WHEN lv <= 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS t1 FROM t)
SELECT w.conv_id, w.turn, md5(a.text) AS system, CASE WHEN b.lv = 1 THEN md5(b.text) END AS "user", CASE WHEN w.lv = 2 THEN w.role END AS tag, CASE WHEN w.lv = 2 THEN md5(w.text) END AS leaf
FROM w LEFT JOIN t a ON a.conv_id = w.conv_id AND a.turn = w.t0 LEFT JOIN t b ON b.conv_id = w.conv_id AND b.turn = w.t1
WHERE (w.lv = 2 AND w.text <> '') OR (w.lv < 2 AND (nx IS NULL OR nx <= w.lv))""")
def flatten_tree(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnsRenamed({"role": "tag", "turn": "pos"})
    rows = chunk.frame(turns, ["conv_id"], ["system", "user"])
    return rows.select("conv_id", F.col("pos").alias("turn"), F.md5("system").alias("system"), F.md5("user").alias("user"), "tag", F.md5("text").alias("leaf"))


_SEEN = r"regexp_replace(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '(?i)<script\b[\s\S]*?</script\s*>', '', 'g'), '(?i)<style\b[\s\S]*?</style\s*>', '', 'g')"
_HREF = r"""CASE WHEN regexp_matches(seen, '(?i)<urlset[\s>]') THEN regexp_extract_all(seen, '(?i)<loc>\s*([\s\S]*?)\s*</loc>', 1)
 WHEN regexp_matches(seen, '(?i)<sitemapindex[\s>]') THEN []
 ELSE [trim(h, '"''') for h in regexp_extract_all(seen, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)] END"""
_DECODED = """replace(replace(replace(replace(replace(replace(trim(x), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&#38;', '&'), '&amp;', '&')"""
def _links_sql(source: str) -> str:
    return rf"""SELECT page_id, url, unnest(list_distinct([regexp_replace(h, '/$', '') for h in [regexp_replace({_DECODED}, '#.*$', '') for x in {_HREF}] if h NOT IN ('', '/', './', './index.html')])) AS l
 FROM (SELECT page_id, url, {_SEEN} AS seen FROM {source})"""


_LINKS = _links_sql("pages")


def _dots(path: str) -> str:
    """Dot segments out of a path, for up to six steps up, in SQL."""
    out = f"regexp_replace(regexp_replace({path}, '/(\\./)+', '/', 'g'), '/\\.$', '/')"
    for _ in range(6):
        out = f"regexp_replace({out}, '/[^/]+/\\.\\.(/|$)', '/')"
    return f"regexp_replace({out}, '^(/\\.\\.)+(/|$)', '/')"


_PATH = r"regexp_extract(regexp_extract(url, '^[^?#]*'), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*(.*)$', 1)"
_ROOT = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1)"
_QUERY = r"regexp_extract(l, '\?.*$')"
_ABSOLUTE = rf"""CASE WHEN regexp_matches(l, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') THEN l WHEN starts_with(l, '//') THEN regexp_extract(url, '^[^:]*:') || l
 WHEN starts_with(l, '/') THEN {_ROOT} || {_dots("regexp_extract(l, '^[^?]*')")} || {_QUERY}
 WHEN starts_with(l, '?') THEN {_ROOT} || {_PATH} || l
 ELSE {_ROOT} || {_dots("(CASE WHEN contains(" + _PATH + ", '/') THEN regexp_replace(" + _PATH + ", '[^/]*$', '') ELSE '/' END || regexp_extract(l, '^[^?]*'))")} || {_QUERY} END"""


@query(f"SELECT page_id, string_agg(l, ' ' ORDER BY l) AS links, count(*) AS n FROM ({_LINKS}) GROUP BY page_id")
def links_extract(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", tx.links(F.col("html")).alias("l")).where(F.size("l") > 0)
    return found.select("page_id", F.array_join("l", " ").alias("links"), F.size("l").cast("long").alias("n"))


_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(rf"""WITH s AS (SELECT page_id, url, html FROM pages WHERE page_id % 50 = 0),
hosts AS (SELECT {_HOST} AS host, min(html) AS html FROM pages GROUP BY 1),
a AS (SELECT DISTINCT {_ABSOLUTE} AS url FROM ({_links_sql("s")})),
p AS (SELECT 0 AS page_id, url, html FROM (SELECT url, {_HOST} AS host FROM a WHERE length(url) % 3 > 0) JOIN hosts USING (host)),
b AS (SELECT DISTINCT {_ABSOLUTE} AS url FROM ({_links_sql("p")}))
SELECT url FROM (SELECT url FROM a UNION SELECT url FROM b) WHERE url NOT IN (SELECT url FROM a) OR url IN (SELECT url FROM p)""")
def links_crawl_depth1(spark, sf_dir):
    """Links of some pages and of what these lead to. A host answers two of three addresses, with one of its pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    start = pages.where("page_id % 50 = 0").select("url")
    served = pages.groupBy(host.alias("host")).agg(F.min("html").alias("html"))

    def fetch(urls):
        own = pages.where("page_id % 50 = 0").join(urls, "url", "left_semi").select("url", "html")
        others = urls.join(start, "url", "left_anti").where("length(url) % 3 > 0").withColumn("host", host).join(served, "host")
        return own.union(others.select("url", "html"))

    return crawl.find_links(start, fetch, depth=1)[0]


@query(f"SELECT url, link FROM (SELECT DISTINCT url, {_ABSOLUTE} AS link FROM ({_LINKS}))")
def links_absolute(spark, sf_dir):
    return crawl.page_links(table(spark, sf_dir, "pages"))


@query("SELECT doc_id, length(text) AS n_char, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_char"), tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, text[1:200] AS preview FROM documents ORDER BY doc_id LIMIT 100")
def chunks_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(100).select("doc_id", F.substring("text", 1, 200).alias("preview"))


@query("SELECT doc_id, md5('' || chr(10) || text) AS digest FROM documents")
def embed_input(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.embed_input(F.lit(None).cast("string"), F.col("text"))).alias("digest"))


@query()
def markdown_chunk(spark, sf_dir):
    return chunk.markdown_chunk(markdown_view(table(spark, sf_dir, "documents")), segment_levels=(1, 2))


@query()
def markdown_segment(spark, sf_dir):
    return chunk.markdown_segment(markdown_view(table(spark, sf_dir, "documents")))


@query()
def markdown_frame(spark, sf_dir):
    pieces = chunk.markdown_segment(markdown_view(table(spark, sf_dir, "documents")), trim=True, omit_empty=True)
    return chunk.frame(pieces, ["doc_id"], ["h1", "h2", "h3"])


@query()
def split_recursive(spark, sf_dir):
    return chunk.split_text(table(spark, sf_dir, "documents").select("doc_id", "text"), 800)


@query()
def segment_sentences(spark, sf_dir):
    return chunk.segment_text(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY doc_id""")
def pack_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return chunk.pack_segments(lines, "lines", 400).groupBy("doc_id").agg(F.sum(F.length("text").cast("long")).alias("n_chars"))


@query()
def html_to_markdown(spark, sf_dir):
    return pages_as_markdown(table(spark, sf_dir, "pages"), extract=("article",)).drop("problem")


@query()
def embed_hashing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_embeddings(docs, Embedder(settings={"dims": 32})).select("doc_id", "embedding")


@query()
def tool_json(spark, sf_dir):
    return _top(_scored(spark, sf_dir)).select(F.to_json(F.struct("query_id", "doc_id", "rank", "score"), {"ignoreNullFields": "false"}).alias("json"))


_TAGS = ("h1", "h2", "h3", "p")


@query(" UNION ALL ".join(
    rf"""SELECT * FROM (SELECT page_id, '{t}' AS tag, CAST(len(regexp_extract_all(seen, '(?i)<{t}[\s/>]')) AS BIGINT) AS n FROM (SELECT page_id, {_SEEN} AS seen FROM pages)) WHERE n > 0"""
    for t in _TAGS))
def html_segments(spark, sf_dir):
    """Elements of each page by tag; their texts are tested against a tree."""
    found = chunk.html_segments(table(spark, sf_dir, "pages").select("page_id", "html"), _TAGS).where("tag <> ''")
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query()
def html_frame(spark, sf_dir):
    return chunk.html_frame(table(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"], ("h1", "h2"), ("h1", "h2", "p"))
