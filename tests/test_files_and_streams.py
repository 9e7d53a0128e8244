"""Sources, sinks, streaming, command line, metrics on odd input."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.operators import metrics, policy, sanitize, synth
from spanloom.operators.detect import detect
from spanloom.operators.kernel import resolved
from spanloom.sources import ocr, pdf, readers, scratch, writers
from spanloom.streaming import sanitizer


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"mail a@x.org \xff end")
    (tmp_path / "in/sub/b.csv").write_text("name,mail\nZ,b@y.org\n")
    (tmp_path / "in/sub/c.docx").write_bytes(writers.docx_bytes("first & <b>\nsecond c@z.org"))
    (tmp_path / "in/d.png").write_bytes(b"not an image")
    (tmp_path / "in/e.xyz").write_text("other")
    return tmp_path


def test_sources(spark, folder):
    got = {os.path.basename(r.path): r for r in readers.read_documents(spark, f"{folder}/in").collect()}
    assert set(got) == {"a.txt", "b.csv", "c.docx", "d.png"}
    assert got["a.txt"].text == "mail a@x.org � end" and got["c.docx"].text == "first & <b>\nsecond c@z.org" and got["d.png"].error.startswith("RuntimeError")
    assert {os.path.basename(r.path): r.text for r in readers.read_documents(spark, f"{folder}/in", "never").collect()}["d.png"] == ""
    assert readers.read_text(spark, f"{folder}/in").count() == 5 and readers.read_text(spark, f"{folder}/in", True).count() == 2
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(folder), "maybe")


def test_pages_are_read_from_images_only_where_they_must():
    pdf = lambda data: ["a page with quite enough text", " "]
    image = lambda data: f"seen {data.decode()}"
    pages = lambda data: [b"one", b"two"]
    get = lambda mode: readers.extract(b"", "pdf", mode, pdf, pages, image)
    assert get("auto") == ("a page with quite enough text\nseen two", [1]) and get("never")[1] == [] and get("always")[1] == [0, 1]
    with pytest.raises(ValueError):
        readers.extract(b"", "exe")


def test_looks_scanned(spark):
    row = spark.range(1).select(readers.looks_scanned(F.lit(" \n")).alias("a"), readers.looks_scanned(F.lit("x" * 20)).alias("b"), readers.looks_scanned(F.lit("x" * 20), 2).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, True)


def test_image_readers_are_chosen_once(monkeypatch):
    made = []

    def loader(name, missing=False):
        def load():
            if missing:
                raise ImportError(name)
            made.append(name)
            return lambda data: f"{name}:{data.decode()}"

        return load

    monkeypatch.setattr(ocr, "_loaders", {})
    monkeypatch.delenv(ocr.VARIABLE, raising=False)
    assert not ocr.available()
    ocr.register("big", loader("big"), heavy=True)
    ocr.register("gone", loader("gone", True))
    assert not ocr.available() and ocr.available("big")
    ocr.register("small", loader("small"))
    assert readers.extract(b"x", "png") == ("small:x", [0]) and ocr.reader()(b"y") == "small:y" and made == ["big", "small"]
    monkeypatch.setenv(ocr.VARIABLE, "big")
    assert ocr.reader()(b"z") == "big:z"
    ocr.reset()
    assert ocr.reader()(b"z") == "big:z" and made == ["big", "small", "big"]
    with pytest.raises(RuntimeError):
        ocr.reader("none")
    ocr.reset()


def test_markers_are_stripped(spark):
    texts = ["head\n*** START OF THE BOOK ***\n one\ntwo \n*** END OF THE BOOK ***\ntail", "plain", "a *** END OF", "*** START OF", None, "x\n*** START OF y\nrest"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(readers.without_markers(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["one\ntwo", "plain", "a", "", None, "rest"]


def test_slots_are_filled_in_one_pass():
    assert writers.filled("@@A@@-@@B@@", {"A": "@@B@@", "B": "b"}) == "@@B@@-b"
    with pytest.raises(KeyError):
        writers.filled("@@NOPE@@", {})


def test_gold_readers(spark, tmp_path):
    mention = {"start_offset": 0, "end_offset": 4, "entity_type": "PERSON", "identifier_type": "DIRECT"}
    (tmp_path / "t.json").write_text(json.dumps([{"doc_id": "d", "text": "Anna x", "annotations": {"b": {"entity_mentions": []}, "a": {"entity_mentions": [mention]}}}]))
    (tmp_path / "m.json").write_text(json.dumps({"id": "m", "source_text": "hi Anna", "privacy_mask": [{"start": 3, "end": 7, "label": "NAME"}]}))
    assert [(r.start, r.end, r.identifier_type) for r in readers.read_annotated(spark, f"{tmp_path}/t.json").collect()] == [(0, 4, "DIRECT")]
    assert readers.read_masked(spark, f"{tmp_path}/m.json").first()["value"] == "Anna"


def test_sinks_verify(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@x.org")], "doc_id long, text string")
    made = sanitize.sanitize(docs, policy.get_policy("maximum"))
    writers.write_documents(made, f"{tmp_path}/ok", vault=sanitize.vault_of(made))
    with pytest.raises(writers.VerificationError):
        writers.write_documents(docs.select("doc_id", F.col("text").alias("sanitized")), f"{tmp_path}/bad")
    report = json.loads(writers.json_report(made).first()["report"])
    assert report["clean"] and "a@x.org" not in json.dumps(report)
    row = made.first()
    page = writers.review_page("mail a@x.org </script>", [e.asDict() for e in row.edits], "clean", "none")
    assert "<mark" in page and page.count("</script>") == 1
    assert writers.wrapped("aa bb " + "c" * 7, 5) == ["aa bb", "ccccc", "cc"] and writers.wrapped("") == [""]
    with pytest.raises(ValueError):
        writers.file_bytes("x", "exe")


def test_pdf_has_a_page_for_each_lot_of_lines():
    text = "\n".join(f"line {k} (a) \\ é" for k in range(130))
    data = writers.pdf_bytes(text)
    assert data.startswith(b"%PDF-1.4") and data.count(b"/Type /Page ") == 3 and b"(line 129 \\(a\\) \\\\ \xe9) Tj" in data
    assert "\n".join(pdf.pdf_pages(data)) == text and readers.extract(data, "pdf") == (text, [])
    with pytest.raises(ValueError):
        writers.pdf_bytes("a 日")  # no character is lost without a word
    with pytest.raises(ValueError):
        pdf.pdf_pages(data.replace(b"/Encoding /WinAnsiEncoding", b"/Encoding /Identity-H"))
    assert int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0]) == data.index(b"xref\n0 ") and writers.file_bytes("", "pdf").count(b"/Type /Page ") == 1


def test_synthetic_documents_are_found_and_hidden(spark):
    docs = synth.labelled(spark, 30, 7)
    rows = docs.collect()
    assert len(rows) == 30 and all(r.text[g.start : g.end] == g.value for r in rows for g in r.gold)
    assert sorted(map(str, rows)) == sorted(map(str, synth.labelled(spark, 30, 7).repartition(5).collect()))
    gold = docs.selectExpr("doc_id", "inline(gold)")
    found = resolved(detect(docs.select("doc_id", "text"))).selectExpr("doc_id", "inline(resolved)")
    assert metrics.overlap_recall(gold, found).first()["recall"] == 1.0
    scores = metrics.typed_scores(gold, found).agg({"n_gold": "sum", "n_typed": "sum"}).first()
    assert scores["sum(n_typed)"] >= 0.97 * scores["sum(n_gold)"] and metrics.overlap_precision(gold, found).first()["precision"] >= 0.9
    assert metrics.leakage(gold, found).first()["leak_rate"] == 0.0


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"mail u{k}@x.org and 10.0.0.{k}") for k in range(6)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sanitizer.start(stream, policy.get_policy("maximum"), f"{tmp_path}/texts", f"{tmp_path}/vault", f"{tmp_path}/cp").awaitTermination()
    got = {(r.doc_id, r.sanitized) for r in spark.read.parquet(f"{tmp_path}/texts").collect()}
    assert got == {(r.doc_id, r.sanitized) for r in sanitize.sanitize(rows, policy.get_policy("maximum")).collect()}
    assert spark.read.parquet(f"{tmp_path}/vault").count() == 12 and sanitizer.detected(stream).isStreaming


def test_command_line(spark, folder, capsys):
    (folder / "in/d.png").unlink()
    assert cli.main(["batch", f"{folder}/in", f"{folder}/out", "--allow-plaintext"], spark) == 0
    texts = [r.text for r in spark.read.parquet(f"{folder}/out/texts").collect()]
    assert len(texts) == 3 and not any("@" in t for t in texts)
    assert cli.main(["inspect", f"{folder}/in", "--json"], spark) == 0 and '"EMAIL"' in capsys.readouterr().out
    assert cli.main(["risk", f"{folder}/in"], spark) == 0
    assert cli.main(["verify", f"{folder}/in"], spark) == 2
    assert cli.main(["batch", f"{folder}/in", f"{folder}/out2"], spark) == 64


def test_deflated_pages_of_another_writer_are_read():
    import zlib

    stream = zlib.compress(b"BT /F1 9 Tf 40 800 Td [(Mail ) -20 (a@x.org)] TJ 0 -12 Td <48692e> Tj (\\050x\\)) ' ET")
    data = b"%PDF-1.5\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type/Page /Contents [4 0 R]>> endobj\n"
    data += b"4 0 obj <</Filter /FlateDecode /Length %d>>\nstream\n%b\nendstream endobj\n" % (len(stream), stream)
    assert pdf.pdf_pages(data) == ["Mail a@x.org\nHi.\n(x)"]
    for bad in (b"", b"%PDF-1.4 nothing", data.replace(b"FlateDecode", b"LZWDecode"), data + b"/Encrypt"):
        with pytest.raises(ValueError):
            pdf.pdf_pages(bad)


def test_files_are_read_back_before_they_count(spark, tmp_path):
    rows = [(1, "mail [[EMAIL_001]]", "txt"), (2, "still a@x.org", "docx"), (3, "Anna x", "pdf"), (4, "日", "pdf"), (5, None, "md"), (6, "x", "exe")]
    vault = "array(named_struct('token', 't', 'entity_type', 'PERSON', 'value', 'Anna', 'action', 'tokenize')) as vault"
    docs = spark.createDataFrame(rows, "doc_id long, sanitized string, ext string").selectExpr("*", vault)
    got = {r.doc_id: r for r in writers.rendered(docs).collect()}
    assert bytes(got[1].content) == b"mail [[EMAIL_001]]" and got[1].leaks is None and got[5].content == b""
    assert got[2].leaks and got[3].leaks and got[4].error and got[6].error and not got[1].error
    writers.write_file(f"{tmp_path}/a.docx", "first\nsecond")
    assert readers.docx_text(open(f"{tmp_path}/a.docx", "rb").read()) == "first\nsecond"
    with pytest.raises(writers.VerificationError):
        writers.write_file(f"{tmp_path}/b.docx", "x a@x.org")
    assert not os.path.exists(f"{tmp_path}/b.docx")


def test_one_file_goes_out_and_comes_back(spark, tmp_path, capsys):
    text = "Contact: Anna Keller, anna@x.org. Keller called."
    (tmp_path / "a.txt").write_text(text)
    run = lambda *args: cli.main([str(a) for a in args], spark)
    assert run("sanitize", tmp_path / "a.txt", "--out", tmp_path / "b.docx", "--vault", tmp_path / "v.json") == 64
    assert run("sanitize", tmp_path / "a.txt", "--out", tmp_path / "b.docx", "--vault", tmp_path / "v.json", "--passphrase", "pw") == 0
    hidden = readers.docx_text((tmp_path / "b.docx").read_bytes())
    assert hidden == "Contact: [[PERSON_001]], [[EMAIL_001]]. [[PERSON_001]] called." and "Anna" not in (tmp_path / "v.json").read_text()
    assert run("restore", tmp_path / "b.docx", tmp_path / "v.json", "--passphrase", "pw", "--out", tmp_path / "c.txt") == 0
    assert (tmp_path / "c.txt").read_text() == text.replace("Keller called", "Anna Keller called")
    assert run("restore", tmp_path / "b.docx", tmp_path / "v.json", "--passphrase", "no") == 64
    (tmp_path / "d.txt").write_text("call 12 anna@x.org")
    capsys.readouterr()
    assert run("verify", tmp_path / "d.txt", "--vault", tmp_path / "v.json", "--passphrase", "pw") == 2 and "anna@x.org" in capsys.readouterr().out
    assert run("review", tmp_path / "a.txt", "--out", tmp_path / "r.html") == 0 and "<mark" in (tmp_path / "r.html").read_text()
    assert run("benchmark", "--documents", 12) == 0


def test_a_batch_writes_files_in_the_format_of_their_source(spark, folder):
    (folder / "in/d.png").unlink()
    assert cli.main(["batch", f"{folder}/in", f"{folder}/out", "--passphrase", "pw", "--files", "--shared-vault"], spark) == 0
    assert sorted(os.listdir(f"{folder}/out/files")) == ["a.txt", "sub__b.csv", "sub__c.docx"]
    assert readers.docx_text(open(f"{folder}/out/files/sub__c.docx", "rb").read()).startswith("first & <b>\nsecond [[EMAIL_00")


def test_scratch_tables_go(spark, tmp_path):
    made = scratch.materialize(spark.range(5))
    place = made.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    assert made.count() == 5 and os.path.isdir(place)
    scratch.drop(made)
    assert not os.path.isdir(place)
    spark.range(1).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError):
        scratch.drop(spark.read.parquet(f"{tmp_path}/own"))


def test_metrics_of_nothing(spark):
    gold = spark.createDataFrame([], "doc_id long, start int, end int, entity_type string, value string")
    assert metrics.overlap_precision(gold, gold).first()["n_predicted"] == 0
    assert metrics.leakage(gold, gold).first()["leak_rate"] == 0.0
