"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join. DataFrame functions only.

A list entry is (host, path, verdict). It fits a URL whose host is the entry's host or a subdomain of it and
whose path starts with the entry's path; the longest fitting entry decides. So a URL asks for the keys
``host suffix + path prefix`` at the label counts and path lengths that occur in the list. Keys that the Bloom
filter rules out are dropped inside the row; the rest go to a hash join with the list, which removes the
filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small

#: Bits per listed key; a block has four 64-bit words and each key sets one bit in each of them.
BITS_PER_KEY, WORDS = 16, 4
#: Up to so many blocks (32 bytes each) the filter is one value, from a scalar subquery; larger ones are joined by block.
MAX_BLOCKS = 1 << 18

#: The rules of the production list. Fixed values.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    after = F.substring_index(_after_scheme(url), "/", 1)
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _word(key: Column, i: int) -> Column:
    """The bit of word i: six bits of a second hash."""
    six = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), six)


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """One row per block that has bits: block, w0..w3. Rules have the column rule."""
    words = [F.bit_or(_word(F.col("rule"), i)).alias(f"w{i}") for i in range(WORDS)]
    return rules.groupBy(_block(F.col("rule"), blocks).alias("block")).agg(*words)


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule (host + path of the longest fitting entry, else null) and verdict to the rows of urls.

    A null URL or one without ``://`` has an empty host and path and fits only an entry with an empty host.
    A URL that no entry fits is not listed: verdict allow. Entries with the same host and path: block wins; of
    fitting entries with equally long host + path, the one with the longer host. An empty list allows all.
    Repeated rows are judged alike and kept; input columns named host, path, rule or verdict, in any case, are
    replaced, any others kept. Very long URLs are judged whole.
    """
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path").agg(F.max(F.coalesce("verdict", F.lit("block"))).alias("verdict"))
        .select(F.concat("host", "path").alias("rule"), F.concat_ws("\u0000", "host", "path").alias("key"), F.length("host").alias("host_len"), "verdict")
    )
    parts = F.split("key", "\u0000")
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.when(parts[0] != "", F.size(F.split(parts[0], "\\."))).otherwise(0)).alias("labels"),
        F.collect_set(F.length(parts[1])).alias("lengths"),
    ).first()  # three bounded values: a count, numbers of labels, lengths of paths
    with_parts = urls.select(*kept, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shape["n"]:
        return with_parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    blocks = max(1, -(-shape["n"] * BITS_PER_KEY // (64 * WORDS)))
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])

    def keys(host: str = "host", path: str = "path") -> Column:
        tails = [F.when(F.size(F.split(host, "\\.")) >= n, F.substring_index(host, ".", -n)) if n else F.when(F.col(host) == "", F.lit("")) for n in labels]
        heads = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
        return F.array_compact(F.array(*[F.when(t.isNotNull() & h.isNotNull(), F.concat(t, F.lit("\u0000"), h)) for t in tails for h in heads]))

    named = rules.select(F.col("key").alias("rule"))
    asked = with_parts.select("host", "path").distinct().withColumn("keys", keys())
    filt = bloom(named, blocks)
    if blocks <= MAX_BLOCKS:  # all blocks as one value of at most MAX_BLOCKS * 40 bytes
        one = filt.agg(F.map_from_entries(F.collect_list(F.struct("block", F.array(*[f"w{i}" for i in range(WORDS)])))).alias("bloom"))
        words = one.scalar()
        hit = lambda k: _passes(k, F.try_element_at(words, _block(k, blocks)))
        possible = asked.select("host", "path", F.explode("keys").alias("key")).where(hit(F.col("key")))
    else:
        each = asked.select("host", "path", F.explode("keys").alias("key")).withColumn("block", _block(F.col("key"), blocks))
        words = filt.select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))
        possible = each.join(words, "block").where(_passes(F.col("key"), F.col("words"))).select("host", "path", "key")
    best = F.max(F.struct(F.length("rule").alias("len"), "host_len", "rule", "verdict")).alias("best")
    fits = possible.join(small(rules, shape["n"]), "key").groupBy("host", "path").agg(best)
    h, p, r, v = fresh(with_parts, "__h", "__p", "__r", "__v")
    fits = fits.select(F.col("host").alias(h), F.col("path").alias(p), F.col("best.rule").alias(r), F.col("best.verdict").alias(v))
    out = with_parts.join(fits, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return out.select(*kept, "host", "path", F.col(r).alias("rule"), F.coalesce(v, F.lit("allow")).alias("verdict"))


def _passes(key: Column, words: Column) -> Column:
    found = [F.get(words, F.lit(i)).bitwiseAND(_word(key, i)) != 0 for i in range(WORDS)]
    out = words.isNotNull()
    for x in found:
        out = out & x
    return out
