import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from shaleview.sources import files, sinks

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def xlsx() -> bytes:
    out = io.BytesIO()
    row = lambda n, *v: f'<row r="{n}">' + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{x}</t></is></c>' for i, x in enumerate(v)) + "</row>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {M}><sheets><sheet name="A" sheetId="1" r:id="i1"/><sheet name="H" sheetId="2" state="hidden" r:id="i1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="i1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {M}><sheetData>{row(1, 'Code', 'Name')}{row(2, 'AB-12345', 'Ann')}{row(3, 'CD-99999', '')}</sheetData></worksheet>")
    return out.getvalue()


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Hello')}<w:tbl><w:tr>{cell('H')}{cell('')}</w:tr><w:tr>{cell('v')}{cell('u')}</w:tr></w:tbl>{p('')}</w:body></w:document>")
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xlsx").write_bytes(xlsx())
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.html").write_text("<html><head><title>no</title></head><body><script>x()</script><p>Hi\n there</p></body></html>")
    m = EmailMessage()
    m.set_content("plain body")
    m.add_alternative("<b>html body</b><style>q</style>", subtype="html")
    m.add_attachment(b"secret", maintype="text", subtype="plain", filename="x.txt")
    (tmp_path / "sub" / "d.eml").write_bytes(m.as_bytes())
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    b = files.blocks(spark, str(tmp_path)).collect()
    text = lambda ext: [r.text for r in b if r.file_type == ext and r.block_type != "error"]
    assert text("html") == ["Hi", "there"] and text("eml") == ["plain body", "html body"]
    assert text("xlsx") == ["[REVIEW] Code", "Name", "AB-12345", "Ann", "CD-99999", ""]
    assert text("docx") == ["Hello", "H", "", "v", "u"]
    assert [r.error is not None for r in b if r.block_type == "error"] == [True]


def test_csv_and_registry(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n 1 ,NA\n,x\n")
    rows = {(r.block_type, r.col_header, r.text) for r in files.csv_blocks(spark, str(p)).collect()}
    assert rows == {("table_header", "a", "a"), ("table_header", "b", "b"), ("table_cell", "a", "1"), ("table_cell", "b", "NA"), ("table_cell", "b", "x")}
    with pytest.raises(ValueError):
        files.reader_for("x/noextension")
    with pytest.raises(ValueError):
        files.reader_for("x.zzz")


def test_discovery(spark, tmp_path):
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "same.html").write_text("same")
    (tmp_path / "two" / "skip.bin").write_text("x")
    got = files.discovered(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()
    assert len(got) == 1 and "/one/" in got[0].source_path


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("s1", "Ann", "a@b.c", None, 0.75, True, ["SSN"], None), ("s2", None, None, "5551234", 0.2, None, [], None)],
                              "subject_id string, canonical_name string, canonical_email string, canonical_phone string, merge_confidence double, notification_required boolean, pii_types_found array<string>, canonical_address struct<street:string,city:string,state:string,zip:string,country:string>")
    r = sinks.export_rows(s, ["canonical_email", "merge_confidence", "notification_required", "secret"], min_confidence=0.5).collect()
    assert [tuple(x) for x in r] == [("***@***.***", "0.7500", "True")]
    assert sinks.export_fields(["secret"])[0] == "canonical_name"
    assert {x.subject_id: x.status for x in sinks.letters(s, "p", "Dear $name").collect()} == {"s1": "SKIPPED", "s2": "SKIPPED"}

    def send(address, body):
        raise OSError

    assert {x.subject_id: (x.status, x.attempts) for x in sinks.deliver(s, send, "hi", sleep=lambda _: None).collect()} == {"s1": ("FAILED", 3), "s2": ("SKIPPED", 0)}
    e = spark.createDataFrame([("approval", "bo", "s1", "fine")], "event_type string, actor string, subject_id string, rationale string").withColumn("timestamp", F.current_timestamp())
    sinks.append_audit(e, str(tmp_path / "log"))
    assert sinks.audit_history(spark.read.parquet(str(tmp_path / "log")), "s1").count() == 1
    with pytest.raises(Exception):
        sinks.append_audit(e.withColumn("rationale", F.lit("")), str(tmp_path / "log"))


def avro_file(records, codec="null"):
    import json
    import zlib

    def number(n):
        n, out = (n << 1) ^ (n >> 63), b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    text = lambda s: number(len(s)) + s
    schema = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "score", "type": "double"}]}
    sync = b"0123456789abcdef"
    out = b"Obj\1" + number(2) + text(b"avro.schema") + text(json.dumps(schema).encode()) + text(b"avro.codec") + text(codec.encode()) + number(0) + sync
    import struct

    for part in records:
        body = b"".join(number(i) + (number(0) if n is None else number(1) + text(n.encode())) + (number(len(t)) + b"".join(text(x.encode()) for x in t) if t else b"") + number(0) + struct.pack("<d", x) for i, n, t, x in part)
        body = zlib.compress(body)[2:-4] if codec == "deflate" else body
        out += number(len(part)) + text(body) + sync
    return out


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(spark, tmp_path, codec):
    (tmp_path / "a.avro").write_bytes(avro_file([[(-70, " Ann ", ["x", "y"], 1.5), (3, None, [], 2.0)], [(10**12, "Bo", [], 0.0)]], codec))
    (tmp_path / "b.avro").write_bytes(b"Obj\1 broken")
    rows = files.blocks(spark, f"file://{tmp_path}", ["avro"]).collect()
    got = {(r.page_or_sheet, r.row_no, r.col_header): r.text for r in rows if r.block_type == "table_cell"}
    assert got[("0", 0, "id")] == "-70" and got[("0", 0, "name")] == "Ann" and got[("0", 0, "tags")] == '["x", "y"]' and got[("1", 2, "id")] == str(10**12) and ("0", 1, "name") not in got
    bad = [r for r in rows if r.block_type == "error"]
    assert len(bad) == 1 and bad[0].category == "corrupt_file" and not bad[0].retryable


def test_parquet_pages_are_row_groups(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import parquet

    parquet.write_table(pa.table({"a": ["x", None, " y ", ""], "b": [1, 2, 3, None]}), tmp_path / "t.parquet", row_group_size=2)
    got = {(r.page_or_sheet, r.col_header, r.text) for r in files.parquet_blocks(spark, f"file://{tmp_path}/t.parquet").collect()}
    assert got == {("0", "a", "x"), ("0", "b", "1"), ("0", "b", "2"), ("1", "a", "y"), ("1", "b", "3")}


def test_categories_and_fallback(spark, tmp_path):
    assert [files.category(e) for e in (TimeoutError(), OSError(), ValueError("x"), TypeError(), RuntimeError())] == ["ocr_timeout", "transient_io", "corrupt_file", "schema_violation", "unknown"]
    (tmp_path / "n.odd").write_bytes(b"hello")
    with pytest.raises(ValueError):
        files.reader_for("n.odd")
    files.register("*", lambda data, path: iter([files.block(data.decode(), 1)]))
    try:
        assert [r.text for r in files.blocks(spark, f"file://{tmp_path}").collect()] == ["hello"] and files.reader_for("n.odd")
    finally:
        files.FALLBACK.clear()
    d = spark.createDataFrame([("d1", f"file://{tmp_path}/n.odd"), ("d2", f"{tmp_path}/gone")], "document_id string, source_path string")
    assert {r.document_id: r.content for r in files.fetched(spark, d).collect()} == {"d1": bytearray(b"hello"), "d2": None}


def test_delivery_shares_its_rate_and_sends_once(spark):
    s = spark.createDataFrame([("s1", "a@b.c"), ("s2", "d@e.f"), ("s3", "g@h.i")], "subject_id string, canonical_email string")
    done = sinks.deliver(s, lambda a, b: None, "hi", sleep=lambda _: None, tasks=2, already=s.where("subject_id = 's2'"))
    assert {r.subject_id: r.status for r in done.collect()} == {"s1": "DELIVERED", "s3": "DELIVERED"} and done.rdd.getNumPartitions() == 2


def test_audit_views(spark):
    log = spark.createDataFrame([("human_review", "s1", 1), ("approval", "s1", 3), ("approval", "s2", 2)], "event_type string, subject_id string, timestamp int")
    assert [r.timestamp for r in sinks.audit_by_type(log, "approval").collect()] == [2, 3] and [r.timestamp for r in sinks.audit_recent(log, 2).collect()] == [3, 2] and sinks.audit_history(log, "s1").count() == 2
