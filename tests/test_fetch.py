import http.server
import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.operators.crawl import find_links
from lexloom.sources.fetch import Fetcher, Policy, Response, _answer, _Turns, answers
from lexloom.sources.readers import urls_as_markdown

FAST = Policy(rate=1e6, backoff=0.01, longest=0.05)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


@pytest.fixture(scope="module")
def site():
    """A server on this machine: pages, redirects, an address that answers at the third attempt, one that never does."""
    seen = defaultdict(list)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path].append(time.time())
            n = len(seen[self.path])
            status, kind, body, more = 404, "text/html", b"no", {}
            if self.path == "/":
                status, body = 200, b"<main><h1>Home</h1><a href='/a'>a</a><a href='/old'>o</a><a href='/gone'>g</a><a href='/busy'>b</a></main>"
            elif self.path.startswith("/a"):
                status, kind, body = 200, "text/html; charset=latin-1", "<main><p>café</p></main>".encode("latin-1")
            elif self.path == "/old":
                status, more = 302, {"Location": "a#part"}
            elif self.path == "/round":
                status, more = 301, {"Location": "/round"}
            elif self.path == "/busy":
                status, more = (503, {"Retry-After": "0"}) if n < 3 else (200, {})
            elif self.path == "/never":
                status = 500
            elif self.path == "/bin":
                status, kind, body = 200, "image/png", b"\x89\x00"
            elif self.path == "/csv":
                status, kind, body = 200, "text/csv", b"x,y\n1,2\n"
            elif self.path == "/with%20space":
                status, body = 200, b"<p>spaced</p>"
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), **more}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_a_real_server(spark, site, tmp_path):
    base, seen = site
    fetcher = Fetcher(spark, str(tmp_path), policy=FAST, slices=3)
    names = ["/", "/a", "/old", "/round", "/busy", "/never", "/bin", "/with space", "/none"]
    urls = spark.createDataFrame([(base + n,) for n in [*names, "/a"]] + [(None,), ("no address",), ("http://[bad/",)], "url string")
    got = rows_of(fetcher.fetch(urls), "url")
    assert set(got) == {*(base + n for n in names), "no address", "http://[bad/"}
    at = lambda n: got[base + n]
    assert at("/a").html == "<main><p>café</p></main>" and at("/a").media_type == "text/html" and at("/a").attempts == 1
    assert at("/old").resolved == base + "/a" and at("/old").html == at("/a").html and at("/old").problem is None
    assert at("/round").problem == "too many redirects" and at("/round").html is None
    assert at("/busy").status == 200 and at("/busy").attempts == 3
    assert at("/never").problem == "status 500" and len(seen["/never"]) == FAST.attempts
    assert bytes(at("/bin").content) == b"\x89\x00" and at("/bin").html is None
    assert at("/with space").html == "<p>spaced</p>" and at("/with space").resolved == base + "/with%20space"
    assert at("/none").problem == "status 404" and len(seen["/none"]) == 1
    assert got["no address"].problem and got["http://[bad/"].problem

    asked = {k: len(v) for k, v in seen.items()}
    again = rows_of(Fetcher(spark, str(tmp_path), policy=FAST).fetch(urls), "url")
    assert again == got and {k: len(v) for k, v in seen.items()} == asked, "nothing is asked twice"


def test_crawls_and_markdown(spark, site, tmp_path):
    base, _ = site
    fetcher = Fetcher(spark, str(tmp_path / "c"), policy=FAST)
    start = spark.createDataFrame([(base + "/",)], "url string")
    found, problems = find_links(start, fetcher.pages, depth=1, children_only=True, validate=fetcher.answering)
    assert {r.url for r in found.collect()} == {base + "/a", base + "/busy"}
    assert {r.link for r in problems.collect()} == {base + "/gone"}
    urls = spark.createDataFrame([(base + n,) for n in ("/", "/a", "/csv", "/none", "/bin")], "url string")
    texts = rows_of(urls_as_markdown(fetcher, urls, plugins={"png": lambda b: f"{len(b)} bytes"}), "origin")
    assert texts[base + "/"].text.startswith("# Home") and texts[base + "/a"].text == "café"
    assert texts[base + "/csv"].text == "| x | y |\n| --- | --- |\n| 1 | 2 |"
    assert texts[base + "/bin"].text == "2 bytes"
    assert texts[base + "/none"].text is None and texts[base + "/none"].problem == "status 404"


def test_rates_hold_for_each_host(spark):
    def transport(address, _):
        return Response(200, {}, address.encode())

    rows = [(f"http://{'hot' if i % 3 else 'h' + str(i)}.org/{i}",) for i in range(24)]
    for lanes in (1, 2):
        policy = Policy(rate=20, lanes=lanes)
        got = answers(spark.createDataFrame(rows, "address string"), transport, policy, parts=4).collect()
        assert sorted(r.address for r in got) == sorted(r[0] for r in rows)
        times = sorted(r.at for r in got if "//hot" in r.address)
        by_lane = len(times) / lanes / 20
        assert times[-1] - times[0] >= (by_lane - 0.1) * 0.7
        if lanes == 1:
            assert min(b - a for a, b in zip(times, times[1:])) >= 0.0499


def test_backoff_doubles_and_slows_the_host():
    at = []

    def transport(address, _):
        at.append(time.time())
        if len(at) < 4:
            raise ConnectionError("reset")
        return Response(200, {"content-type": "text/plain; charset=nonsense"}, b"ok")

    turns = _Turns(0)
    row = _answer("http://a.org/x", transport, Policy(rate=1e6, attempts=4, backoff=0.05), turns)
    assert row[4] == "ok" and row[7] == 4
    assert [round(b - a, 2) >= w for a, b, w in zip(at, at[1:], (0.05, 0.1, 0.2))] == [True] * 3
    at.clear()
    row = _answer("http://a.org/x", transport, Policy(rate=1e6, attempts=2, backoff=0.01), turns)
    assert row[6] == "ConnectionError: reset" and row[7] == 2


def test_redirects_between_hosts_wait_for_their_host(spark, tmp_path):
    def transport(address, _):
        host, n = address.removeprefix("http://").split("/")
        if host == "loop":
            return Response(301, {"location": f"http://pool/{n}"}, b"")
        if host == "pool":
            return Response(301, {"location": f"http://loop/{n}"}, b"")
        if host == "old":
            return Response(301, {"location": f"http://new/{int(n) % 2}"}, b"")
        return Response(200, {}, address.encode())

    urls = spark.createDataFrame([(f"http://old/{i}",) for i in range(9)] + [("http://new/1",), ("http://loop/1",)], "url string")
    fetcher = Fetcher(spark, str(tmp_path), transport, Policy(rate=1e6, redirects=3))
    got = rows_of(fetcher.fetch(urls), "url")
    assert len(got) == 11 and got["http://loop/1"].problem == "too many redirects"
    assert all(got[f"http://old/{i}"].html == f"http://new/{i % 2}" == got[f"http://old/{i}"].resolved for i in range(9))
    asked = [r.address for r in fetcher.answered().collect()]
    assert len(asked) == len(set(asked)) and sum(a.startswith("http://new") for a in asked) == 2


def test_a_lost_task_and_a_stopped_crawl(spark, tmp_path):
    log, flag = tmp_path / "log", tmp_path / "down"
    log.mkdir()
    flag.touch()

    def transport(address, _):
        if address.endswith("/7") and flag.exists():
            raise RuntimeError("the task dies")
        with open(log / address.rsplit("/", 1)[1], "a") as f:
            f.write("x")
        return Response(200, {}, b"<p>x</p>")

    urls = spark.createDataFrame([(f"http://h{i}.org/{i}",) for i in range(12)], "url string")
    fetcher = Fetcher(spark, str(tmp_path / "t"), transport, FAST, slices=4)
    with pytest.raises(Exception, match="the task dies"):
        fetcher.fetch(urls)
    before = {r.address for r in fetcher.answered().collect()}
    assert len(before) < 12 and "http://h7.org/7" not in before
    flag.unlink()
    assert fetcher.fetch(urls).count() == 12
    assert all((log / a.rsplit("/", 1)[1]).read_text() == "x" for a in before), "written slices are not asked again"


def test_odd_policies_and_empty_tables(spark, tmp_path):
    for bad in ({"rate": 0}, {"lanes": 0}, {"attempts": 0}, {"redirects": -1}):
        with pytest.raises(ValueError):
            Policy(**bad)
    none = spark.createDataFrame([], "url string")
    fetcher = Fetcher(spark, str(tmp_path / "e"), policy=FAST)
    assert fetcher.fetch(none).count() == 0 and fetcher.answered().count() == 0
    assert fetcher.fetch(none.select(F.lit(None).cast("string").alias("url"))).count() == 0
