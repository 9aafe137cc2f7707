from __future__ import annotations

import json
import zipfile
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from spindrift.operators import link
from spindrift.plans import catalogue
from spindrift.sources import exports
from spindrift.streaming import pairing

from .test_operators import _events, _paired

PAGE = """<html><head><title>Room 1</title></head><body>
<div class="message service" id="message-1"><div class="body">joined</div></div>
<div class="message default" id="message5"><div class="date" title="01.02.2024 10:00:00 UTC+08:00">10:00</div><div class="from_name">Ann</div><a class="photo_wrap" href="photos/a.jpg"><img src="photos/a_thumb.jpg"></a></div>
<div class="message default joined" id="message6"><div class="reply_to">In reply to <a href="#go_to_message5">this</a></div><div class="text">hello <b>there</b></div></div>
</body></html>"""


def test_html_messages(spark):
    files = spark.createDataFrame([("x/messages.html", PAGE), ("x/messages2.html", ""), ("x/other.html", None)], "path string, html string")
    got = exports.html_messages(files).orderBy("page", "pos").collect()
    assert [(r.msg_id, r.sender, r.media, r.reply_id, r.service, r.joined) for r in got] == [("-1", None, None, None, True, False), ("5", "Ann", "photos/a.jpg", None, False, False), ("6", None, None, "5", False, True)]
    assert got[2].text == "hello there" and got[0].chat == "Room 1"
    rows = exports.html_messages(files).withColumn("named", F.col("sender"))
    carried = link.carry_forward(rows, "page", "pos", "named", "service", "history").orderBy("pos").collect()
    assert [r.carried for r in carried] == ["history", "Ann", "Ann"]


def test_page_titles(spark, tmp_path: Path):
    """A title cut within a reference keeps it, as in the SQL; references that are whole are decoded once."""
    titles = ["a&amp;&amp", " b &amp;lt; &lt;&quot;&#x27;&gt; ", "c&ampd &nbsp;&#39;", "plain"]
    rows = [(k, f"<html><title>{t}</title><p>x</p><a href='y'>z</a>") for k, t in enumerate(titles)] + [(4, "<p>no title"), (5, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.plain_title for r in exports.page_fields(pages, "page_id", "html").collect()}
    assert got == {0: "a&&amp", 1: "b &lt; <\"'>", 2: "c&ampd &nbsp;&#39;", 3: "plain", 4: "", 5: ""}
    pages.repartition(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(catalogue.oracle_sql()["html_extract"]).fetchall()}
    assert {r.page_id: r.title for r in catalogue.queries()["html_extract"](spark, str(tmp_path)).collect()} == want | {5: ""}


def test_json_manifest_zip_images(spark, tmp_path: Path):
    messages = [{"id": 1, "from": "A", "text": "x", "photo": "p/1.jpg"}, {"id": 2, "from": "B", "text": ["see ", {"type": "link", "text": "y"}], "file": "doc.pdf", "reply_to_message_id": 1}]
    (tmp_path / "result.json").write_text(json.dumps({"name": "R", "messages": messages}))
    got = exports.json_messages(spark, str(tmp_path / "result.json")).orderBy("pos").collect()
    assert [(r.msg_id, r.text, r.media, r.reply_id) for r in got] == [("1", "x", "p/1.jpg", None), ("2", "see y", None, "1")]
    (tmp_path / "m.json").write_text(json.dumps({"format": "v1", "items": [{"image": "a.jpg", "sender": "s", "text": "t", "chat": "c"}]}))
    assert exports.manifest(spark, str(tmp_path / "m.json"), "v1").first().image == "a.jpg"
    assert exports.manifest(spark, str(tmp_path / "m.json"), "v2").first().error == "unknown format: v1"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.jpg", b"1")
        z.writestr("in/messages.html", PAGE)
        z.writestr("in/a.jpg", b"2")
    got = exports.zip_members(spark, str(tmp_path / "b.zip")).collect()
    assert [(r.kind, r.name) for r in got] == [("html", "in/messages.html")]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.PNG").write_bytes(b"abc")
    (tmp_path / "img/a.txt").write_bytes(b"abc")
    assert [r.length for r in exports.image_files(spark, str(tmp_path / "img")).collect()] == [3]


def test_stream_equals_batch(spark, tmp_path: Path):
    events = _events(7, 120)
    df = spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = pairing.paired(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    got = {(r.user_id, r.open_id, r.close_id) for r in spark.table("pairs").filter("NOT expired").collect()}
    assert got == _paired(events)
