"""File readers on files made here; streams against their batch twins."""

import zipfile

from attestra.sources import files
from attestra.streaming import events as E


def test_catalog_mail_and_office(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "m.eml").write_bytes(b"From: a@x.org\r\nTo: b@x.org\r\nSubject: Hi\r\n\r\nBody text\r\n")
    with zipfile.ZipFile(tmp_path / "sub" / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "sub" / "bad.docx").write_text("no zip")
    got = {r.name: (r.ext, r.size) for r in files.catalog(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "m.eml", "d.docx", "bad.docx"} and got["a.txt"] == ("txt", 1)
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(str(tmp_path))
    mail = files.mails(read("*.eml")).first()
    assert (mail.sender, mail.subject, mail.text.strip(), mail.status) == ("a@x.org", "Hi", "Body text", "ok")
    texts = {r.path.rsplit("/", 1)[-1]: (r.text, r.status) for r in files.office_texts(read("*.docx")).collect()}
    assert texts["d.docx"] == ("One two\nThree", "ok") and texts["bad.docx"][0].startswith("(error reading") and texts["bad.docx"][1] == "BadZipFile"


def test_decoding_falls_back_to_latin(spark):
    rows = spark.createDataFrame([(1, bytearray("﻿é".encode())), (2, bytearray(b"caf\xe9"))], "i int, content binary")
    assert [r.t for r in rows.select("i", files.decoded(rows["content"]).alias("t")).orderBy("i").collect()] == ["é", "café"]


def test_streams_equal_their_batch_twins(spark):
    at = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{at}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(at)
    got = E.drained(E.window_counts(stream), "counts", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.window_counts(batch).collect()))
    firsts = E.drained(E.first_of_key(stream, ["user_id", "event_type"], "400 days"), "firsts", "append")
    assert firsts.count() == E.first_of_key(batch, ["user_id", "event_type"]).count()


def test_snapshot_versions_replace_their_own_partition(spark, tmp_path):
    from attestra.sources import snapshots as S

    at = str(tmp_path / "snaps")
    rows = lambda *r: spark.createDataFrame(list(r), "board_id string, iteration int, label string, n int")
    S.write_version(rows(("a", 1, "x", 1), ("b", 1, "x", 2)), at)
    S.write_version(rows(("a", 1, "x", 7), ("a", 2, "x", 3)), at)
    got = {(r.board_id, r.iteration): r.n for r in spark.read.parquet(at).collect()}
    assert got == {("a", 1): 7, ("a", 2): 3, ("b", 1): 2}
    assert {r.board_id: r.n for r in S.latest(spark.read.parquet(at)).collect()} == {"a": 3, "b": 2}
