"""Pages from the web: addresses dealt by host, with rates, attempts and redirects; what was answered is kept in a table."""

from __future__ import annotations

import http.client
import threading
import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from email.message import Message
from typing import NamedTuple
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed

#: Fields of an answer. A redirect to another host has `moved` and no content.
ANSWER = "address string, moved string, status int, media_type string, html string, content binary, problem string, attempts int, at double"
_REDIRECT, _LATER = (301, 302, 303, 307, 308), (408, 425, 429, 500, 502, 503, 504)
_SAFE = "%/:=&?~#+!$,;'@()*[]"
_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class Response(NamedTuple):
    status: int
    headers: dict[str, str]  # names in small letters
    body: bytes


#: Makes one request (address, seconds) without following redirects; raises OSError, ValueError or HTTPException if there is no answer.
Transport = Callable[[str, float], Response]


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def http_get(address: str, timeout: float) -> Response:
    """One GET of the standard library."""
    opener = urllib.request.build_opener(_Stay)
    try:
        with opener.open(urllib.request.Request(address, headers={"User-Agent": "lexloom"}), timeout=timeout) as r:
            return Response(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read())
    except urllib.error.HTTPError as e:
        with e:
            return Response(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read())


@dataclass(frozen=True)
class Policy:
    """How a host is asked: at most `rate` requests a second, by `lanes` tasks that have an equal part of the rate each.

    A status that may pass (429, 503, ...) or an error is tried `attempts` times in all, after backoff, 2 backoff, ... or the
    Retry-After of the answer, but never longer than `longest` seconds; the host's other addresses in the lane wait as well.
    threads is the number of requests that a task may have open.
    """

    rate: float = 1.0
    lanes: int = 1
    attempts: int = 4
    backoff: float = 1.0
    longest: float = 60.0
    redirects: int = 10
    timeout: float = 30.0
    threads: int = 16

    def __post_init__(self):
        if self.rate <= 0 or min(self.lanes, self.attempts, self.threads) < 1 or self.redirects < 0:
            raise ValueError("rate, lanes, attempts and threads must be positive and redirects not negative")


class _Turns:
    """Times at which a task may ask its hosts."""

    def __init__(self, gap: float):
        self.gap, self.lock, self.next = gap, threading.Lock(), defaultdict(float)

    def take(self, host: str) -> float:
        """Waits for the host's next turn and gives its time."""
        with self.lock:
            at = max(time.time(), self.next[host])
            self.next[host] = at + self.gap
        time.sleep(max(0.0, at - time.time()))
        return at

    def hold(self, host: str, seconds: float) -> None:
        with self.lock:
            self.next[host] = max(self.next[host], time.time() + seconds)


def _host(address: str) -> str:
    return urlsplit(address).netloc.lower()


def _wait(policy: Policy, tries: int, headers: dict[str, str]) -> float:
    asked = headers.get("retry-after", "")
    return min(policy.longest, float(asked) if asked.isdigit() else policy.backoff * 2 ** (tries - 1))


def _answer(address: str, transport: Transport, policy: Policy, turns: _Turns) -> tuple:
    """The fields of ANSWER for an address: requests until it answers for good, within its host."""
    host, now, tries, hops, at, encoded = "", address, 0, 0, time.time(), False

    def row(status=None, problem=None, moved=None, media=None, html=None, content=None):
        return address, moved or (now if now != address else None), status, media, html, content, problem, tries + hops, at

    while True:
        status, headers = None, {}
        try:
            host = _host(now)
            at = turns.take(host)
            status, headers, body = transport(now, policy.timeout)
            problem = None if 200 <= status < 300 else f"status {status}"
        except (OSError, ValueError, http.client.HTTPException) as e:
            problem = f"{type(e).__name__}: {e}"
        if problem is None:
            head = Message()
            head["content-type"] = headers.get("content-type", "text/html")
            media, charset = head.get_content_type(), head.get_content_charset("utf-8")
            tries += 1
            if media.startswith("text/") or media.endswith(("html", "xml", "json")):
                try:
                    return row(status, media=media, html=body.decode(charset, errors="replace"))
                except LookupError:
                    return row(status, media=media, html=body.decode("utf-8", errors="replace"))
            return row(status, media=media, content=body)
        if status in _REDIRECT and headers.get("location"):
            hops += 1
            if hops > policy.redirects:
                return row(status, "too many redirects")
            try:
                to = urljoin(now, headers["location"]).split("#")[0]
                elsewhere = _host(to) != host
            except ValueError as e:
                return row(status, f"ValueError: {e}")
            if elsewhere:
                return row(status, moved=to)
            now = to
            continue
        tries += 1
        if (status is None or status not in _LATER) and not encoded and quote(now, safe=_SAFE) != now:
            now, encoded = quote(now, safe=_SAFE), True
        elif (status is None or status in _LATER) and tries < policy.attempts:
            turns.hold(host, _wait(policy, tries, headers))
        else:
            return row(status, problem)


def answers(addresses: DataFrame, transport: Transport = http_get, policy: Policy = Policy(), parts: int | None = None) -> DataFrame:
    """A row (ANSWER) for each distinct address. Addresses are dealt by (host, lane), so that one task asks a lane and knows when
    it did; inside a task hosts come mixed. A task that is lost asks its own addresses again, and no others.

    `moved` is where a redirect led: within the host it was followed and the rest of the row is what is there; to another
    host it has to be asked in that host's own turn, and there is neither content nor problem. Null and malformed addresses: a null one has
    no row, another one has its problem. A batch of `maxRecordsPerBatch` addresses is asked at a time and its bodies are held.
    """
    spark = addresses.sparkSession
    gap = policy.lanes / policy.rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _Turns(gap)
        names = [f.split()[0] for f in ANSWER.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
        with ThreadPoolExecutor(policy.threads) as pool:
            for b in batches:
                for lo in range(0, b.num_rows, 4 * policy.threads):
                    asked = b.slice(lo, 4 * policy.threads).column("address").to_pylist()
                    rows = list(pool.map(lambda a: _answer(a, transport, policy, turns), asked))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[f.split()[1]]) for i, f in enumerate(ANSWER.split(", "))], names)

    host = F.lower(F.regexp_extract("address", "^[^:/?#]+://([^/?#]*)", 1))
    lane = F.pmod(F.xxhash64("address"), F.lit(policy.lanes))
    dealt = addresses.select("address").where("address is not null").distinct()
    dealt = dealt.repartition(parts or max(spark.sparkContext.defaultParallelism, 1), host, lane).sortWithinPartitions(F.xxhash64("address"))
    return dealt.mapInArrow(run, ANSWER)


class Fetcher:
    """Fetches pages once. Answers are appended to a table in `folder`, by bucket of the address; a fetch asks only addresses
    that are not there, so that a crawl that was stopped goes on where it ended.

    slices: a level is fetched by so many jobs one after the other, each written when it is done. Only one job may
    ask at a time: rates hold for the tasks of one job.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str, transport: Transport = http_get, policy: Policy = Policy(), parts: int | None = None, slices: int = 1):
        self.spark, self.folder, self.transport, self.policy, self.parts, self.slices = spark, folder.rstrip("/"), transport, policy, parts, slices

    def answered(self) -> DataFrame:
        """All answers so far: ANSWER and bucket."""
        schema = f"{ANSWER}, bucket int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/answers")
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith(_MISSING):
                raise
            return self.spark.createDataFrame([], schema)

    def _ask(self, addresses: DataFrame) -> None:
        """Appends the answers of the addresses that have none yet."""
        keyed = addresses.where("address is not null").distinct().withColumn("bucket", F.pmod(F.xxhash64("address"), F.lit(self.BUCKETS)).cast("int"))
        for i in range(self.slices):
            new = keyed.where(F.pmod("bucket", F.lit(self.slices)) == i).join(self.answered().select("bucket", "address"), ["bucket", "address"], "left_anti")
            got = answers(new, self.transport, self.policy, self.parts)
            got = got.withColumn("bucket", F.pmod(F.xxhash64("address"), F.lit(self.BUCKETS)).cast("int"))
            got.write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/answers")

    def fetch(self, urls: DataFrame) -> DataFrame:
        """(url, resolved, status, media_type, html, content, problem, attempts): a row for each distinct url of urls(url).

        Redirects to other hosts are asked in passes, each under the rate of its host, up to policy.redirects of them; what still
        leads elsewhere then is a problem. resolved is the last address. A redirect to an address that was fetched before
        asks nothing. attempts are the requests made for the last address.
        """
        trail = checkpointed(urls.where("url is not null").select("url", F.col("url").alias("address")).distinct())
        done: DataFrame | None = None
        for hop in range(self.policy.redirects + 1):
            self._ask(trail.select("address"))
            leads = self.answered().where("moved is not null and html is null and content is null and problem is null").select("address", "moved")
            led = checkpointed(trail.join(leads, "address", "left"))
            here = led.where("moved is null").select("url", "address")
            done = here if done is None else done.union(here)
            trail = led.where("moved is not null").select("url", F.col("moved").alias("address"))
            if trail.isEmpty():
                break
        rows = done.join(self.answered().drop("bucket", "at"), "address")
        rows = rows.select("url", F.coalesce("moved", "address").alias("resolved"), "status", "media_type", "html", "content", "problem", "attempts")
        lost = trail.select("url", F.col("address").alias("resolved"), F.lit(None).cast("int").alias("status"), F.lit("too many redirects").alias("problem"))
        return rows.unionByName(lost, allowMissingColumns=True)

    def pages(self, urls: DataFrame) -> DataFrame:
        """(url, html, resolved) of the urls that have a text; for crawl.find_links(fetch=...)."""
        return self.fetch(urls).where("problem is null and html is not null").select("url", "html", "resolved")

    def answering(self, urls: DataFrame) -> DataFrame:
        """(url) of the urls that answer; for crawl.find_links(validate=...)."""
        return self.fetch(urls).where("problem is null").select("url")
