import threading
import urllib.parse
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from panelflow.sources import http, store

DAYS = [datetime(2024, 1, d) for d in range(1, 11)]


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            asked.append(query)
            since = datetime.fromisoformat(query["from"]) if "from" in query else DAYS[0]
            rows = [f"{d:%Y-%m-%d},{len(query['key']) * 100 + d.day}" for d in DAYS if d >= since] if query["key"] != "none" else []
            self.send_response(200)
            self.end_headers()
            self.wfile.write("\n".join(["Date,Close", *rows, "2024-02-01,"]).encode())

        def log_message(self, *_):
            pass

    it = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=it.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{it.server_port}/?key={{key}}&from={{from}}&to={{to}}", asked
    it.shutdown()


def reading(spark, url, keys, **options):
    http.register(spark)
    return spark.read.format("http_levels").options(url=url, keys=keys, **options).load()


def test_a_partition_for_each_key(spark, server):
    url, asked = server
    asked.clear()
    df = reading(spark, url, "a,bb,c&d")
    assert df.rdd.getNumPartitions() == 3 and dict(df.dtypes)["ts"] == "timestamp_ntz"
    rows = df.collect()
    assert len(rows) == 30 and {r["source_key"] for r in rows} == {"a", "bb", "c&d"} and max(r["level"] for r in rows) == 310
    assert sorted(q["key"] for q in asked) == ["a", "bb", "c&d"]


def test_filters_save_requests_and_rows(spark, server):
    url, asked = server
    df = reading(spark, url, "a,bb,ccc")
    asked.clear()
    rows = df.where("source_key in ('bb', 'zz') and ts >= timestamp_ntz'2024-01-08'").collect()
    assert len(rows) == 3 and [(q["key"], q["from"]) for q in asked] == [("bb", "2024-01-08T00:00:00")]
    asked.clear()
    assert df.where("source_key = 'a' and ts < timestamp_ntz'2024-01-03'").count() == 2 and [(q["key"], q.get("to")) for q in asked] == [("a", "2024-01-03T00:00:00")]


def test_missing_keys(spark, server):
    url, _ = server
    with pytest.raises(Exception, match="no observation"):
        reading(spark, url, "a,none").collect()
    assert {r["source_key"] for r in reading(spark, url, "a,none", missing="skip").collect()} == {"a"}


def test_a_class_is_fetched_at_once_and_kept(spark, server, tmp_path):
    url, asked = server
    catalog = spark.createDataFrame([("A", "eq", "web", "a"), ("B", "eq", "web", "bb"), ("C", "fx", "web", "ccc"), ("D", "fx", "other", "d")], "series string, cls string, source string, source_key string")
    source = store.AtOnce(lambda s, keys: reading(s, url, ",".join(keys)))
    asked.clear()
    rows = store.fetch(spark, catalog, str(tmp_path), {"web": source}).collect()
    assert len(rows) == 30 and {(r["cls"], r["series"]) for r in rows} == {("eq", "A"), ("eq", "B"), ("fx", "C")} and len(asked) == 3
    assert store.fetch(spark, catalog, str(tmp_path), {"web": source}).count() == 30 and len(asked) == 3
