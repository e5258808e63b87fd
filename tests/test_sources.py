import io
import zipfile

from pyspark.sql import functions as F

from marlstone.operators.search import TextIndex
from marlstone.sources import keyed, pages, readers
from marlstone.streaming import events


def test_lines_records_and_file_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head\nSTART\none\ntwo\nEND\ntail")
    got = readers.lines(spark, f"file://{tmp_path}/a.txt", start="START", end="END").collect()
    assert [r["value"] for r in got] == ["START", "one", "two", "END"]
    assert [r["value"] for r in readers.lines(spark, f"file://{tmp_path}/a.txt", reverse=True, most=2).collect()] == ["tail", "END"]
    assert readers.records(spark, f"file://{tmp_path}/a.txt", "\n").count() == 6
    rows = spark.createDataFrame([(1, f"{tmp_path}/a.txt"), (2, "/none")], "id long, p string")
    text = {r["id"]: r["content"] for r in readers.with_file_text(rows, "p", f"file://{tmp_path}").collect()}
    assert text[1].startswith("head") and text[2] is None


def test_csv_round_trip_and_stats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", x', 2.5), (2, None, 0.5)], "n int, s string, f double")
    readers.write_csv(df, f"file://{tmp_path}/out")
    back = readers.csv(spark, f"file://{tmp_path}/out", escape="\\")
    assert back.columns == ["n", "s", "f"] and back.count() == 2
    stats = {r["column"]: r for r in readers.table_stats(df).collect()}
    assert (stats["f"]["sum"], stats["n"]["average"], stats["n"]["count"]) == (3.0, 1.5, 2.0)
    readers.discard(df)


def test_mail_and_mime(spark, tmp_path):
    one = "From a@b Mon\nFrom: a@b\nTo: c@d\nSubject: Hi\n\nbody one\n"
    (tmp_path / "m.mbox").write_text(one + one.replace("one", "two"))
    got = readers.mailbox(spark, f"file://{tmp_path}/m.mbox").orderBy("message_no").collect()
    assert [(r["sender"], r["subject"], r["body"]) for r in got] == [("a@b", "Hi", "body one"), ("a@b", "Hi", "body two")]
    raw = b"Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain\n\nhello\n--x\nContent-Type: image/png\nContent-Disposition: attachment; filename=p.png\n\nzz\n--x--\n"
    parts = spark.createDataFrame([(bytearray(raw),)], "c binary").select(readers.mime_parts(F.col("c"))).first()[0]
    assert [(p["kind"], p["name"]) for p in parts] == [("text/plain", None), ("image/png", "p.png")]


def test_documents_convert(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>First</w:t></w:p><w:p><w:t>Second</w:t></w:p></w:d>')
    rows = [(bytearray(data.getvalue()),), (bytearray(b"<html><p>x &amp; y<script>no</script>"),), (bytearray(b"%PDF-1.4"),), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "c binary").select(readers.convert(F.col("c"))).collect()]
    assert got == [("docx", "First\nSecond"), ("html", "x & y"), ("pdf", None), ("txt", "")]


def test_page_links(spark):
    html = '<a class=x href="/a">A</a><img src="i.png"><iframe src=\'f\'></iframe>'
    got = spark.range(1).select(pages.links(F.lit(html))).first()[0]
    assert [tuple(x) for x in got] == [("link", "/a"), ("image", "i.png"), ("iframe", "f")]


def test_key_values(spark):
    row = lambda *x: spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in x], "key binary, value binary")
    kv = keyed.KeyValues(row((b"a", b"1"), (b"b", b"2")))
    kept = kv.put(row((b"b", b"9"), (b"c", b"3")), overwrite=False)
    assert (kept.get(b"b"), kept.count(), kv.put(row((b"b", b"9"))).get(b"b"), kv.get(b"z")) == (b"2", 3, b"9", None)
    assert [bytes(r["key"]) for r in kept.cursor(after=b"a").collect()] == [b"b", b"c"]
    assert [bytes(r["key"]) for r in kept.cursor(before=b"c", most=1).collect()] == [b"b"]
    assert kept.delete(row((b"a", b"")).select("key")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.follow_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string", most_files=1)
    seen = events.tumbling(stream, "ts", "1 day", ["event_type"], late="60 days")
    q = seen.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    batch = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))


def test_bus_and_incremental_index(spark, tmp_path):
    spark.createDataFrame([("hit", "x"), ("miss", "y")], "event string, payload string").write.parquet(str(tmp_path / "ev"))
    bus, seen = events.Bus(), []
    bus.on("hit", "one", lambda rows: seen.extend(r["payload"] for r in rows.collect()))
    bus.on("hit", "gone", lambda rows: seen.append("never"))
    bus.off("hit", "gone")
    bus.attach(events.follow_files(spark, str(tmp_path / "ev"), "event string, payload string"), str(tmp_path / "c1")).awaitTermination(60)
    assert seen == ["x"]
    docs = spark.createDataFrame([(1, "a power"), (2, "b power")], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path / "ix"), "doc_id")
    index.create(docs, "text")
    spark.createDataFrame([(3, "c power")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    events.index_stream(events.follow_files(spark, str(tmp_path / "docs"), "doc_id long, text string"), index, str(tmp_path / "c2"), optimize_over=0).awaitTermination(60)
    assert index.search("power").count() == 3 and index.new_rows() == 0
