"""Archives as a source: ranges of one archive, broken entries and archives, articles and paragraphs."""

import io
import zipfile

from pyspark.sql import functions as F

from lodestar.sources import archives as A, bronze as B

ARTICLE = '<xml><article idMateria="7" artType="Aviso de Chamamento" artCategory="Ministerio/Agencia" pubDate="10/06/2026" pdfPage="http://d/7"><body><Identifica>CHAMADA N 1</Identifica><Ementa/><Texto><![CDATA[<p>Apoio a <b>inovação</b></p>]]></Texto></body></article></xml>'


def put(path, *entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in entries:
            archive.writestr(name, content)


def test_one_archive_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as archive:
        for i in range(200):
            archive.writestr(f"d/{i}.txt", b"%d " % i * 500)
    rows = A.read_entries(spark, str(tmp_path), bytes_a_task=20_000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.entry, bytes(r.content)) for r in rows) == sorted((f"d/{i}.txt", b"%d " % i * 500) for i in range(200))
    assert len({r.task for r in rows}) > 5 and all(r.error is None and r.size == len(r.content) for r in rows)


def test_broken_ones_say_why(spark, tmp_path):
    put(tmp_path / "good.zip", ("a.xml", "one"), ("B.XML", ""), ("c.txt", "x"), ("folder/", ""))
    data = bytearray((tmp_path / "good.zip").read_bytes())
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as archive:
        at = archive.getinfo("a.xml").header_offset + 30 + len("a.xml")
    data[at] ^= 0xFF
    (tmp_path / "bad_entry.zip").write_bytes(data)
    (tmp_path / "cut.zip").write_bytes((tmp_path / "good.zip").read_bytes()[:40])
    (tmp_path / "empty.zip").write_bytes(b"")
    put(tmp_path / "none.zip")
    got = {(r.archive.rsplit("/", 1)[1], r.entry): (None if r.content is None else bytes(r.content), r.error) for r in A.read_entries(spark, str(tmp_path), ".xml").collect()}
    assert got[("good.zip", "a.xml")] == (b"one", None) and got[("good.zip", "B.XML")] == (b"", None)
    assert got[("bad_entry.zip", "a.xml")][0] is None and got[("bad_entry.zip", "a.xml")][1] and got[("bad_entry.zip", "B.XML")] == (b"", None)
    assert got[("cut.zip", None)][1].startswith("BadZipFile") and len(got) == 5
    large = A.read_entries(spark, str(tmp_path / "good.zip"), most=2).where("entry = 'a.xml'").first()
    assert large.content is None and "3 bytes" in large.error and large.size == 3


def test_gazette(spark, tmp_path):
    put(tmp_path / "DO3.zip", ("1.xml", ARTICLE), ("2.xml", "<xml><article"), ("3.xml", "<xml><other/></xml>"), ("4.xml", ""), ("6.xml", ARTICLE.encode("latin-1")), ("5.xml", ARTICLE.replace('artType="Aviso de Chamamento"', "").replace("inovação", "a &amp; b")))
    got = {r.entry: r for r in A.read_gazette(spark, str(tmp_path)).collect()}
    first = got["1.xml"]
    assert (first.native, first.type, first.org, first.day, first.url, first.title, first.summary, first.body, first.error) == ("7", "Aviso de Chamamento", "Ministerio", "10/06/2026", "http://d/7", "CHAMADA N 1", "", "Apoio a inovação", None)
    assert [got[f"{i}.xml"].error is not None for i in (2, 3, 4)] == [True] * 3 and got["5.xml"].type == "" and got["5.xml"].error is None
    assert got["6.xml"].error is None and got["6.xml"].body == "Apoio a inova\ufffd\ufffdo"  # bytes that are no UTF-8
    kept = B.gazette_candidates(A.read_gazette(spark, str(tmp_path)).where("error is null"), ["pregao"], [], "resultado", "(?i)chamada")
    assert {r.entry for r in kept.collect()} == {"1.xml", "5.xml", "6.xml"}


def test_word_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Um </w:t></w:r><w:r><w:t>edital</w:t><w:tab/><w:t>novo</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>célula</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    put(tmp_path / "a.docx", ("word/document.xml", body), ("word/styles.xml", "<x/>"))
    put(tmp_path / "b.docx", ("word/document.xml", "<w:document"))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    got = {r.archive[-6:]: (r.paragraphs, r.error) for r in A.read_word_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == (["Um edital novo", "célula"], None)
    assert got["b.docx"][0] is None and got["b.docx"][1].startswith("not XML") and got["c.docx"][0] is None and got["c.docx"][1]


def test_round_trip(spark, tmp_path):
    rows = spark.range(500).select(F.concat("id", F.lit(".xml")).alias("entry"), F.repeat(F.col("id").cast("string"), 200).cast("binary").alias("content"))
    rows = rows.unionByName(spark.createDataFrame([("e.xml", None)], "entry string, content binary"))
    made = A.write_archives(rows.repartition(3), str(tmp_path / "out"), bytes_each=4_000).collect()
    assert len(made) > 6 and sum(r.n for r in made) == 501
    back = A.read_entries(spark, [r.archive for r in made])
    assert sorted((r.entry, bytes(r.content)) for r in back.collect()) == sorted((r.entry, bytes(r.content or b"")) for r in rows.collect())
    table = spark.createDataFrame(made)
    assert A.read_entries(spark, table.select("archive", "length"), bytes_a_task=1_000).count() == 501
    assert A.write_archives(rows.limit(0), str(tmp_path / "no")).count() == 0
