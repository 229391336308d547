"""Files, leads, sinks and streams."""

from __future__ import annotations

import io
import time
import zipfile

from pyspark.sql import functions as F

from ravine.sources import files, leads, tables
from ravine.streaming import events as ev

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    doc = f"<w:document {W}><w:body>{p('Title', 'Heading1')}{p('Text')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl></w:body></w:document>"
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": doc}))
    book = f'<workbook {S}><sheets><sheet name="One"/><sheet name="Two"/></sheets></workbook>'
    one = f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(archive({"xl/workbook.xml": book, "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": one, "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>"}))
    (tmp_path / "c.txt").write_bytes("plain \xe9".encode("latin-1"))
    (tmp_path / "d.csv").write_text("h,i\n1\n")
    (tmp_path / "e.png").write_bytes(b"\x89PNG")
    (tmp_path / "f.bin").write_bytes(b"?")
    (tmp_path / "g.docx").write_bytes(b"no archive")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "\n## Title\n\nText\n| a | b |\n| --- | --- |\n| 1 |  |" and len(got["a.docx"].tables) == 1
    assert got["b.xlsx"].text == "## Sheet: One\n| head | 5 |\n| --- | --- |\n| x |  |"
    assert got["c.txt"].text == "plain �" and got["d.csv"].text == "| h | i |\n| --- | --- |\n| 1 |  |"
    assert got["e.png"].scanned is True and got["e.png"].text == ""
    assert "unsupported" in got["f.bin"].error and got["f.bin"].text is None and got["g.docx"].error
    assert len(got) == 7
    full = files.full_text(files.read_files(spark, str(tmp_path)).withColumn("k", F.lit(1)), "hash")
    assert full.count() == 4 and full.where("size(pages) <> 1 or pages[0].start <> 0").count() == 0


def test_full_text_keeps_places(spark):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, ""), ("d", 3, "three")], "hash string, page int, text string")
    r = files.full_text(pages).first()
    assert r.text == "one\n\nthree" and [r.text[p.start : p.end] for p in r.pages] == ["one", "three"]


def test_leads(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Phone,name,city\n123,Ann,Rome\n,Bob,\n+456,Cid,\n")
    got = sorted(tuple(r) for r in leads.read_leads(spark, str(tmp_path / "l.csv")).collect())
    assert got == [("+123", "Ann", None, '{"city":"Rome"}'), ("+456", "Cid", None, "{}")]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = tables.upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(tuple(r) for r in new.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.deleted(new, F.col("k") == 1).count() == 2
    tables.append(new, str(tmp_path / "t"), ["k"])
    tables.append(new, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    tables.write_lines(new.select("v"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3


def stream(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stream_is_idempotent_and_routed(spark, tmp_path):
    rows = [("k1", "a", 1), ("k1", "a", 1), ("k2", "b", 2), ("k3", "a", 3)]
    s = stream(spark, tmp_path, rows, "key string, event_type string, v int")
    out = lambda name: lambda b: b.write.mode("append").parquet(str(tmp_path / name))
    ev.drained(ev.once(s, ["key"]), ev.routed({"a": out("a"), "b": out("b")}, out("all")), str(tmp_path / "ck"))
    read = lambda n: spark.read.parquet(str(tmp_path / n)).count()
    assert (read("all"), read("a"), read("b")) == (3, 2, 1)


def test_stream_waits_for_final_states(spark, tmp_path):
    rows = [("k1", "pending"), ("k1", "done"), ("k2", "pending")]
    s = stream(spark, tmp_path, rows, "key string, event_type string")
    seen = []
    sink = lambda b, n: seen.extend(tuple(r) for r in b.collect())
    waiting = ev.await_final(s, "key", ["pending"], 1_000)
    q = waiting.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").foreachBatch(sink).start()
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert sorted(seen) == [("k1", "done", False), ("k2", "pending", True)]


def test_server_events(spark):
    assert spark.range(1).select(ev.server_events(F.lit("call"), F.lit("{}"))).first()[0] == "event: call\ndata: {}\n\n"
