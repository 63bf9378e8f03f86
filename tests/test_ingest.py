import pytest
from pyspark.sql import functions as F

from files import OFFER, SPEC, xlsx
from loomdex.plans.embedding import DOCUMENT_PREFIX, EmbeddingError, embed_batch, embed_texts
from loomdex.plans.ingest import ingest
from loomdex.plans.models import Agent, Completion, ModelError, call_model, is_retryable
from loomdex.settings import Settings
from loomdex.sources.files import classify_uploads, golden_records, scan_files
from loomdex.operators.blocks import sheet_lines
from loomdex.plans.ingest import parse_files
from loomdex.sources.parsers import PARSERS, NoTextLayer, page_blocks, parse_docx, parse_xlsx
from loomdex.streaming.uploads import start_upload_stream
from stubs import HashEmbedder


def test_docx_tables_come_last_and_share_the_last_section():
    blocks = parse_docx(OFFER)
    assert [(b[0], b[3]) for b in blocks] == [
        ("text", ""), ("text", "Модели"), ("text", "Модели"), ("text", "Контакты"), ("text", "Контакты"), ("table", "Контакты"),
    ]
    assert blocks[2][1] == "Линейка блендеров МиксерПро."
    assert blocks[-1][4][2] == ["Артикул", "PMP-540"]


def test_docx_merged_cells():
    from xml.etree import ElementTree

    from files import W as NAMESPACE
    from loomdex.sources.parsers import _table_rows

    def cell(text, extra=""):
        return f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"

    xml = (
        f"<w:tbl {NAMESPACE}><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('c', '<w:vMerge w:val=\"restart\"/>')}</w:tr>"
        f"<w:tr>{cell('a')}{cell('b')}{cell('', '<w:vMerge/>')}</w:tr></w:tbl>"
    )
    assert _table_rows(ElementTree.fromstring(xml)) == [["wide", "wide", "c"], ["a", "b", "c"]]


def test_xlsx_rows(spark):
    def lines(blocks):
        rows = spark.createDataFrame([(b[4],) for b in blocks], "rows ARRAY<ARRAY<STRING>>")
        return [text for r in rows.select(sheet_lines(F.col("rows"))).collect() for text in r[0]]

    blocks = parse_xlsx(SPEC)
    assert lines(blocks) == ["KTL-22: Артикул: KTL-22; Мощность: 2200", "Мощность: 1.5; Цвет: белый"]
    assert {b[3] for b in blocks} == {"Спецификация"}
    assert lines(parse_xlsx(SPEC, "Other")) == ["x: y"]
    assert parse_xlsx(xlsx({"E": [[None]]})) == []
    assert lines([(0, 0, 0, 0, [["a", "b", "a", ""], ["1", "", "2", "3"], ["", "x"], [""]])]) == ["a: 2", "b: x", ""]


def test_page_blocks(spark):
    pages = [("first page", []), (" ", [[["a", None], ["1", " 2 "]]])]
    assert page_blocks(pages) == [("page", "first page", 1, "", None), ("table", "", 2, "", [["a", ""], ["1", "2"]])]
    with pytest.raises(NoTextLayer):
        page_blocks([("", [])])
    files = spark.createDataFrame([("d", "pdf", b"x"), ("e", "odd", b"x")], "doc_id STRING, kind STRING, content BINARY")
    raw = parse_files(files, {"pdf": lambda content: page_blocks(pages)}).collect()
    assert [(r["doc_id"], r["kind"]) for r in raw] == [("d", "page"), ("d", "table"), ("e", None)]


def upload(spark, rows):
    return spark.createDataFrame(rows, "seq INT, filename STRING, kind STRING, content BINARY")


FILES = [(1, "offer.docx", "docx", OFFER), (2, "spec.xlsx", "xlsx", SPEC), (3, "copy.docx", "docx", OFFER), (4, "bad.docx", "docx", b"no zip")]


def test_ingest(spark):
    done = ingest(upload(spark, FILES), make_embedder=HashEmbedder)
    documents = {r["filename"]: r for r in done.documents.collect()}
    assert set(documents) == {"offer.docx", "spec.xlsx", "bad.docx"}
    assert documents["offer.docx"]["status"] == "indexed" and documents["offer.docx"]["chunks_count"] == 6
    assert documents["bad.docx"]["status"] == "failed" and documents["bad.docx"]["error"].startswith("parse: BadZipFile")
    assert documents["bad.docx"]["chunks_count"] == 0
    chunks = done.chunks.filter(F.col("doc_id") == documents["offer.docx"]["doc_id"]).orderBy("ordinal").collect()
    assert [c["ordinal"] for c in chunks] == list(range(6))
    assert chunks[-1]["text"] == "Мощность: 540 Вт\nАртикул: PMP-540"
    assert chunks[-1]["metadata"]["articul"] == "PMP-540"
    assert done.vectors.count() == done.chunks.count() == 8
    again = ingest(upload(spark, FILES), existing=done.documents)
    assert again.documents.count() == 0 and again.chunks.count() == 0


PDF_PAGES = [("ПАСПОРТ БЛЕНДЕРА\n\nПогружной блендер МиксерПро.", [[["Параметр", "Значение"], ["Мощность", "540 Вт"]]]), ("Гарантия два года.", [])]


def pdf_parsers():
    return {**PARSERS, "pdf": lambda content: page_blocks(PDF_PAGES if content == b"%PDF text" else [("", [])])}


def test_ingest_pdf(spark):
    files = [*FILES[:1], (5, "passport.pdf", "pdf", b"%PDF text"), (6, "scan.pdf", "pdf", b"%PDF scan")]
    done = ingest(upload(spark, files), parsers=pdf_parsers())
    documents = {r["filename"]: r for r in done.documents.collect()}
    assert {f: (d["status"], d["error"]) for f, d in documents.items()} == {
        "offer.docx": ("indexed", None), "passport.pdf": ("indexed", None), "scan.pdf": ("failed", "no text layer"),
    }
    chunks = done.chunks.filter(F.col("doc_id") == documents["passport.pdf"]["doc_id"]).orderBy("ordinal").collect()
    assert documents["passport.pdf"]["chunks_count"] == len(chunks) > 0
    text = "\n".join(c["text"] for c in chunks)
    assert all(part in text for part in ("Погружной блендер МиксерПро.", "Мощность: 540 Вт", "Гарантия два года."))
    assert {f["error"] for f in ingest(upload(spark, files[1:])).documents.collect()} == {"parse: ValueError: no parser for pdf"}


def test_upload_stream_pdf(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "passport.pdf").write_bytes(b"%PDF text")
    seen = []

    def write(done, bad, batch_id):
        seen.extend((r["filename"], r["status"]) for r in done.documents.collect())

    start_upload_stream(spark, str(source), str(tmp_path / "ckpt"), write, parsers=pdf_parsers()).awaitTermination(120)
    assert seen == [("passport.pdf", "indexed")]


class FailingEmbedder:
    def embed(self, texts):
        if any("KTL" in t for t in texts):
            raise ConnectionError("no model")
        return HashEmbedder(8).embed(texts)


class ShuffledEmbedder:
    def __init__(self, extra=0):
        self.extra, self.calls = extra, 0

    def embed(self, texts):
        self.calls += 1
        assert all(t.startswith(DOCUMENT_PREFIX) for t in texts)
        numbers = [(i, [1.0, i + 1.0]) for i in range(len(texts) + self.extra)]
        return list(reversed(numbers))


def test_embed_failure_keeps_the_chunks(spark):
    done = ingest(upload(spark, FILES[1:2]), make_embedder=FailingEmbedder)
    row = done.documents.collect()[0]
    assert row["status"] == "embed_failed" and "no model" in row["error"] and row["chunks_count"] == 2
    assert done.vectors.count() == 0 and done.chunks.count() == 2
    with pytest.raises(Exception, match="no model"):
        embed_texts(done.chunks, FailingEmbedder, id_column="chunk_id").collect()


def test_embed_batch():
    embedder = ShuffledEmbedder()
    vectors = embed_batch(embedder, [f"чанк номер {i}" for i in range(7)], DOCUMENT_PREFIX)
    for i, v in enumerate(vectors):
        norm = (1 + (i + 1) ** 2) ** 0.5
        assert v == pytest.approx([1 / norm, (i + 1) / norm])
    assert embedder.calls == 1
    assert embed_batch(embedder, [], DOCUMENT_PREFIX) == [] and embedder.calls == 1
    with pytest.raises(EmbeddingError):
        embed_batch(ShuffledEmbedder(extra=1), ["x"], DOCUMENT_PREFIX)


def test_scan_rules(spark, tmp_path):
    for name, data in {"a.docx": OFFER, "b.PDF": b"x", "c.txt": b"x", "e.pdf": b"y" * 30}.items():
        (tmp_path / name).write_bytes(data)
    got = classify_uploads(scan_files(spark, str(tmp_path)), Settings(upload_max_bytes=len(OFFER)))
    codes = {r["filename"]: r["rejected"] for r in got.select("filename", "rejected").collect()}
    assert codes == {"a.docx": None, "b.PDF": None, "c.txt": 415, "e.pdf": None}
    # The file scan itself skips empty files; an upload table may hold one.
    empty = spark.createDataFrame([("x/d.xlsx", 0)], "path STRING, length BIGINT")
    assert classify_uploads(empty).collect()[0]["rejected"] == 400
    small = classify_uploads(scan_files(spark, str(tmp_path)), Settings(upload_max_bytes=10))
    assert {r["filename"] for r in small.filter("rejected = 413").collect()} == {"a.docx", "e.pdf"}


def test_upload_stream_resumes(spark, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "ckpt")
    source.mkdir()
    (source / "offer.docx").write_bytes(OFFER)
    (source / "note.txt").write_bytes(b"x")
    seen, rejected = [], []

    def write(done, bad, batch_id):
        seen.append(sorted(r["filename"] for r in done.documents.collect()))
        rejected.extend((r["filename"], r["rejected"]) for r in bad.collect())

    for extra in (None, "spec.xlsx"):
        if extra:
            (source / extra).write_bytes(SPEC)
        query = start_upload_stream(spark, str(source), checkpoint, write)
        query.awaitTermination(120)
    assert seen == [["offer.docx"], ["spec.xlsx"]] and rejected == [("note.txt", 415)]


def test_golden_records(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(
        '{"documents": {"a.pdf": {"product": "p", "characteristics": {"k": "v"}, '
        '"source_probes": {"x": {"page": 1, "text_contains": "t"}}}}, "eval_defaults": ["a.pdf"]}'
    )
    frame, defaults = golden_records(spark, str(path))
    row = frame.collect()[0]
    assert defaults == ["a.pdf"] and row["characteristics"] == {"k": "v"}
    assert row["source_probes"]["x"]["text_contains"] == "t" and row["missing_fields"] is None


class Flaky:
    model = "m"

    def __init__(self, errors):
        self.errors = list(errors)

    def complete(self, agent, prompt, timeout_s):
        if self.errors:
            raise self.errors.pop(0)
        return Completion("ok", 1, 2)


def test_model_retries():
    agent, waits = Agent("A", ""), []
    run = lambda *errors: call_model(Flaky(errors), agent, "p", Settings(), waits.append)
    assert run(ConnectionError("x"), ModelError("busy", 429))[:2] == ("ok", None)
    assert len(waits) == 2 and 1.0 <= waits[0] <= 1.25 and 2.0 <= waits[1] <= 2.5
    assert run(*[TimeoutError("slow")] * 3)[1] == "TimeoutError: slow"
    assert run(ModelError("bad", 400))[1] == "ModelError: bad"
    assert len(waits) == 4
    assert [is_retryable(e) for e in (ModelError("", 500), ModelError(""), ValueError())] == [True, True, False]
    assert len(run(ModelError("y" * 900, 400))[1]) == 912


def test_stream_registry_knows_contents_across_batches_and_restarts(spark, tmp_path):
    """Copies that come in later micro-batches keep the first upload's document."""
    from loomdex.operators.state import register_uploads
    from loomdex.streaming.registry import registered, start_registry, upload_facts

    rows = [(k, f"f{k}.pdf", "pdf", f"content {k % 5}".encode()) for k in range(40)]
    schema = "seq INT, filename STRING, kind STRING, content BINARY"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    arrival = rows[20:] + rows[:20]  # the first uploads arrive last
    for part in (arrival[:13], arrival[13:26], [], arrival[26:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_registry(upload_facts(stream), out, checkpoint).awaitTermination()
    want = register_uploads(spark.createDataFrame(rows, schema)).drop("created")
    assert sorted(map(tuple, registered(spark, out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_files_are_bounded(spark, tmp_path, monkeypatch):
    from loomdex.catalog import documents as d

    rows = [(k, f"text {k % 30} " * 5, "en", f"s{k}") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(d, "STREAM_FILE_BYTES", 500)
    monkeypatch.setattr(d, "scratch_folder", lambda spark, label: str(tmp_path / label))
    got = d.streamed_uploads(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, d.upload_deduplication(spark, str(tmp_path)).collect())) and len(got) == 30
    assert len(list((tmp_path / "stream" / "in").glob("*.parquet"))) > 8
    # Two micro-batches for each half, however many files.
    assert len(list((tmp_path / "stream" / "out").glob("batch=*"))) == 4
