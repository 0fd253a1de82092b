import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from textlode.operators.lookup import NotFound
from textlode.plans import service
from textlode.plans.ingest import HashingEmbedder, chunk_rows, ingest
from textlode.sources import formats, loaders
from textlode.sources.paths import safe_path
from textlode.sources.store import ChunkStore, with_store_id
from textlode.streaming.ingest import ingest_stream, requests_per_window, watch


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def pdf(pages, compress=True):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} >>"]
    parts = [o.encode() for o in objects]
    for k, text in enumerate(pages):
        parts.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>".encode())
        body = b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(" + line.encode("cp1252") + b") Tj" for line in text.split("\n")) + b" ET"
        data = zlib.compress(body) if compress else body
        parts.append(b"<< /Length %d%s >>\nstream\n" % (len(data), b" /Filter /FlateDecode" if compress else b"") + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, p) for k, p in enumerate(parts, 1))


W = 'xmlns:w="http://w"'
DOCX = archive({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello </w:t><w:t>DOCX</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>"})
PPTX = archive({f"ppt/slides/slide{k}.xml": f'<sld xmlns:a="http://a"><a:p><a:r><a:t>Slide {k}</a:t></a:r></a:p></sld>' for k in (10, 2, 1)})
XLSX = archive({
    "xl/sharedStrings.xml": '<sst xmlns="http://s"><si><t>Item</t></si><si><r><t>Te</t></r><r><t>st</t></r></si></sst>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://s"><sheetData><row><c t="s"><v>0</v></c><c><v>4.5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c><c t="s"><v>1</v></c></row></sheetData></worksheet>',
})
EPUB = archive({
    "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
    "O/p.opf": '<package xmlns="o"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
    "O/a.xhtml": "<html><head><title>no</title></head><body><h1>Chapter</h1><p>One &amp; two</p></body></html>",
    "O/b.xhtml": "<html><body><p>End</p></body></html>",
})
FILES = {
    "test.txt": ("text/plain", "Hello TXT\n".encode(), ["Hello TXT\n"]),
    "test.csv": ("text/csv", b"name,value\nAlpha,1\nBeta, 2,3\n", ["name: Alpha\nvalue: 1", "name: Beta\nvalue: 2\nNone: 3"]),
    "latin1.csv": ("text/csv", "name,value\nJosé Muñoz,señor está aquí\n".encode("latin-1"), ["name: José Muñoz\nvalue: señor está aquí"]),
    "test.json": ("application/json", b'{"a": 1}', ['{"a": 1}']),
    "test.md": ("text/markdown", b"# Title\n\nSome **bold** and [link](http://x).\n\n- item\n", ["Title\n\nSome bold and link.\n\nitem"]),
    "test.rst": ("text/x-rst", b"Title\n=====\n\nBody ``code`` here.\n", ["Title", "Body code here."]),
    "test.xml": ("application/xml", b"<r><a>One</a><b> Two </b></r>", ["One\nTwo"]),
    "test.py": ("text/x-python", b"print(1)\n", ["print(1)\n"]),
    "test.pdf": ("application/pdf", pdf(["PAGE 0\nline (x) é".replace("(", "\\(").replace(")", "\\)"), "PAGE 1"]), ["PAGE 0\nline (x) é", "PAGE 1"]),
    "plain.pdf": ("application/pdf", pdf(["RAW"], compress=False), ["RAW"]),
    "test.docx": ("", DOCX, ["Hello DOCX\n\nSecond"]),
    "test.pptx": ("", PPTX, ["Slide 1\n\nSlide 2\n\nSlide 10"]),
    "test.xlsx": ("", XLSX, ["Item\t4.5\nin\tTest"]),
    "test.epub": ("", EPUB, ["Chapter\nOne & two\n\nEnd"]),
    "utf16.txt": ("text/plain", "héllo".encode("utf-16"), ["héllo"]),
    "utf32.txt": ("text/plain", "héllo".encode("utf-32"), ["héllo"]),
    "bom.txt": ("text/plain", b"\xef\xbb\xbfhi", ["hi"]),
    "nothing.bin": ("", b"data", ["data"]),
}


def manifest(spark, files):
    rows = [(name, name, mime, f"/up/{name}", bytearray(data)) for name, (mime, data, _) in files.items()]
    return spark.createDataFrame(rows, "file_id string, filename string, file_content_type string, path string, content binary")


def test_every_format_loads(spark):
    got = {}
    for r in loaders.load(manifest(spark, FILES)).orderBy("file_id", "part_index").collect():
        assert r["error"] is None, r
        got.setdefault(r["file_id"], []).append(r)
    for name, (_, _, want) in FILES.items():
        assert [r["page_content"] for r in got[name]] == want, name
    assert [r["page"] for r in got["test.pdf"]] == [0, 1] and json.loads(got["test.pdf"][1]["metadata"]) == {"source": "/up/test.pdf", "page": 1}
    assert got["test.txt"][0]["page"] is None


def test_broken_files_report_and_raw_keeps_markdown(spark):
    bad = {n: ("", b"not a zip", None) for n in ("a.docx", "b.xlsx", "c.pptx", "d.epub", "e.pdf")} | {"f.xml": ("", b"<a><b></a>", None), "ok.md": ("", b"# T", None)}
    rows = {r["file_id"]: r for r in loaders.load(manifest(spark, bad), raw=True).collect()}
    assert all(rows[n]["error"] and rows[n]["page_content"] is None for n in bad if n != "ok.md")
    assert rows["ok.md"]["page_content"] == "# T"


def test_extract_text_is_verbatim(spark):
    records = loaders.load(manifest(spark, {k: FILES[k] for k in ("test.csv", "test.txt", "test.pdf")}))
    out = {r["file_id"]: r["text"] for r in loaders.extract_text(records).collect()}
    assert out["test.txt"] == "Hello TXT" and out["test.csv"].startswith("name: Alpha\nvalue: 1\nname: Beta") and out["test.pdf"].endswith("PAGE 1")


@pytest.mark.parametrize(
    ("name", "mime", "want"),
    [
        ("report.docx", "text/csv", "csv"), ("report.docx", "text/markdown", "word"), ("x.PDF", None, "pdf"), ("Dockerfile", None, "text"), ("a.html", "text/html", "text"),
        ("a.bin", None, "unknown"), (None, None, "unknown"), ("a.txt", "application/json", "json"), ("a.md", "application/pdf", "pdf"), ("page.xml", "text/plain", "xml"), ("n", "text/x-markdown", "markdown"),
    ],
)
def test_dispatch(spark, name, mime, want):
    df = spark.createDataFrame([(name, mime)], "n string, m string")
    assert df.select(formats.loader(F.col("n"), F.col("m"))).first()[0] == want


def test_safe_path(tmp_path):
    base = tmp_path / "base"
    base.mkdir()
    (tmp_path / "base2").mkdir()
    (base / "in").write_text("x")
    (base / "link").symlink_to(tmp_path / "base2")
    assert safe_path(str(base), "in") == str(base / "in")
    assert safe_path(str(base), "a/../in") == str(base / "in")
    for bad in ("../x", "/etc/passwd", "../base2/x", "link/x", "", "  ", None, "a/../../x"):
        assert safe_path(str(base), bad) is None


def _records(spark, texts):
    rows = [(f, k, t, f"/up/{f}.txt", None, json.dumps({"source": f"/up/{f}.txt"})) for f, parts in texts.items() for k, t in enumerate(parts)]
    return spark.createDataFrame(rows, "file_id string, part_index int, page_content string, source string, page int, metadata string")


def test_store_versions_search_and_context(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    api = service.Service(store)
    with pytest.raises(NotFound):
        api.list_ids()
    report = ingest(store, _records(spark, {"a": ["alpha beta gamma", "delta"], "b": ["epsilon zeta"]}), "ann", "c1")
    assert report["status"] and store.version() == 1
    assert ingest(store, _records(spark, {"a": ["alpha again"]}), "ann", "c1")["version"] == 2
    assert store.read(1).count() == 3 and store.read().count() == 4
    assert {r["id"] for r in api.list_ids().collect()} == {"a", "b"}
    hits = api.query("alpha beta gamma", "a", 2, "ann").collect()
    assert hits[0]["document"] == "alpha beta gamma" and abs(hits[0]["score"]) < 1e-6
    assert api.query("alpha", "a", 2, "eve").count() == 0
    assert {r["file_id"] for r in api.query_multiple("epsilon zeta", ["a", "b"], 4).collect()} == {"a", "b"}
    with pytest.raises(NotFound):
        api.query_multiple("x", ["none"])
    assert api.context("a").first()["context"] == "a.txt\nalpha beta gammadeltaalpha again"
    assert api.get_documents(["b"]).count() == 1 and api.health() == {"status": "UP"}
    store.delete_by_metadata({"user_id": "ann", "file_id": "b"}, "c1")
    assert {r["id"] for r in api.list_ids().collect()} == {"a"}
    with pytest.raises(NotFound, match="zzz"):
        api.delete_documents(["a", "zzz"])
    assert store.read().count() == 0 and store.read(2).count() == 4
    assert store.is_laid_out_by("file_id") and not store.is_laid_out_by("page")


def test_failed_ingest_leaves_the_store_alone(spark, tmp_path):
    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise RuntimeError("provider down")

    store = ChunkStore(spark, str(tmp_path / "s"))
    assert ingest(store, _records(spark, {"a": ["one"]}), "ann", "c1")["status"]
    report = ingest(store, _records(spark, {"a": ["two"]}), "ann", "c1", Broken())
    assert not report["status"] and "provider down" in report["error"]
    assert store.version() == 1 and store.read().count() == 1


def test_second_writer_fails_on_publishing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    state = {"parts": [], "done": {}}
    store._publish(state, 0)
    with pytest.raises(FileExistsError):
        store._publish(state, 0)
    # a draft that a dying writer left, and a published version that it told nobody of, block no other
    store.files.write("_versions/0000000002.json.abc", "{")
    assert ingest(ChunkStore(spark, str(tmp_path / "s")), _records(spark, {"a": ["one"]}), "ann", "c1")["version"] == 2
    assert store.version() == 2 and store.read().count() == 1


def _files(store):
    import pathlib

    return {str(p) for p in pathlib.Path(store.root.removeprefix("file:")).rglob("*.parquet")}


def test_deletions_touch_only_their_buckets(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    ingest(store, _records(spark, {f"f{i}": [f"text {i}", "more"] for i in range(40)}), "ann", "c1")
    before = _files(store)
    assert store.delete_by_ids(["f3"], "other") == 1 and store.delete_by_ids(["absent"]) == 1  # nothing to delete, no new version
    assert store.delete_by_ids(["f3"]) == 2
    (bucket,) = store._buckets_of(spark.createDataFrame([("f3",)], "id string"), {"of": 8, "keep": None})
    assert {p.split("/_bucket=")[1].split("/")[0] for p in _files(store) - before} == {str(bucket)}
    assert store.read().count() == 78 and store.of_files(["f3"]).count() == 0 and store.read(1).count() == 80
    assert store.delete_by_metadata({"file_id": "f5"}, "c1") == 3 and store.read().count() == 76
    assert {r["file_id"] for r in store.of_files([f"f{i}" for i in range(40)]).collect()} == {f"f{i}" for i in range(40)} - {"f3", "f5"}
    assert store.compact() == 4 and store.read().count() == 76 and store.of_files(["f7"]).count() == 2


def test_streams_are_told_apart(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    for name in ("a", "b"):
        _records(spark, {name: ["one"]}).write.parquet(str(tmp_path / name))
        source = watch(spark, str(tmp_path / name), _records(spark, {}).schema)
        for _ in range(2):
            ingest_stream(source, store, "ann", "c", HashingEmbedder(8), str(tmp_path / f"c{name}")).awaitTermination()
    assert sorted(r["file_id"] for r in store.read().collect()) == ["a", "b"]
    done = store._state(store.version())["done"]
    assert len(done) == 2 and all(len(name) == 36 for name in done)  # by query id
    # a batch that was published before the stream could note it isn't published again
    name, version = next(iter(done)), store.version()
    assert store.append(_records(spark, {"z": ["again"]}), name, 0) == version


def test_searches_of_files_open_their_buckets_only(spark, tmp_path):
    """Equality and lists of file ids become partition filters of the scan, and filters that Parquet skips row groups by."""
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=16)
    ingest(store, _records(spark, {f"f{i}": ["some text"] for i in range(60)}), "ann", "c1")
    whole = store.read()._jdf.queryExecution().executedPlan().toString()
    for ids in (["f7"], ["f7", "f8"]):
        df = store.of_files(ids)
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "_bucket" in filters and "_bucket" not in whole.split("PartitionFilters: [")[1].split("]")[0]
        assert "file_id" in plan.split("PushedFilters: [")[1].split("]")[0]
        assert df.count() == len(ids)


def test_dedup_profile_replaces_by_store_id(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), "dedup")
    for _ in range(2):
        assert ingest(store, _records(spark, {"a": ["same", "same", "other"]}), "ann", "c1")["status"]
    rows = store.read().collect()
    assert sorted(r["document"] for r in rows) == ["other", "same"]
    assert all(r["store_id"].startswith("a_") for r in rows)
    df = with_store_id(spark.createDataFrame([(None, None, "x")], "file_id string, digest string, document string"))
    assert df.first()["store_id"] is None


def test_chunk_rows_are_the_same_when_run_again(spark):
    rows = chunk_rows(_records(spark, {"a": ["one two", "three"]}), "ann", "c", HashingEmbedder(8), ("f" * 32, 5))
    assert rows.orderBy("uuid").collect() == rows.orderBy("uuid").collect()
    assert {r["row_seq"] for r in rows.collect()} == {5, 6}


def test_files_are_read_from_a_folder(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "a.txt").write_text("hello there")
    (folder / "b.docx").write_bytes(b"broken")
    requests = spark.createDataFrame([("fa", "a.txt", None, str(folder / "a.txt")), ("fb", "b.docx", None, str(folder / "b.docx"))], "file_id string, filename string, file_content_type string, filepath string")
    api = service.Service(ChunkStore(spark, str(tmp_path / "s")))
    report = api.embed_files(requests, str(folder), "ann", "c1")
    assert report["status"] and len(report["unreadable"]) == 1
    assert api.extract(requests, str(folder)).first()["text"] == "hello there"


def test_what_is_not_in_the_folder_is_reported(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (tmp_path / "secret.txt").write_text("secret")
    (tmp_path / "up-other").mkdir()
    (tmp_path / "up-other" / "x.txt").write_text("secret")
    (folder / "link.txt").symlink_to(tmp_path / "secret.txt")
    (folder / "a b.txt").write_text("fine")
    paths = ["a b.txt", str(folder / "a b.txt"), "../secret.txt", str(tmp_path / "secret.txt"), "../up-other/x.txt", "link.txt", "absent.txt", None]
    requests = spark.createDataFrame([(f"f{i}", "a.txt", None, p) for i, p in enumerate(paths)], "file_id string, filename string, file_content_type string, filepath string")
    out = {r["file_id"]: (r["page_content"], r["error"]) for r in loaders.load(loaders.read_files(requests, str(folder))).collect()}
    assert out["f0"] == out["f1"] == ("fine", None)
    assert all(out[f"f{i}"][0] is None and "FileNotFoundError" in out[f"f{i}"][1] for i in range(2, 8))


def test_pdf_fonts_with_tables_of_codes():
    table = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange
        2 beginbfchar <0003> <0020> <0010> <00660069> endbfchar 2 beginbfrange <0024> <0028> <0041> <0050> <0051> [<03B1> <D835DC00>] endbfrange"""
    single = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <01> <03> <0430> endbfrange"
    content = b"BT /F1 12 Tf <00240003002500100050> Tj 0 -14 Td /F2 9 Tf (\\001\\002\\003) Tj 0 -14 Td /F3 9 Tf (plain) Tj [<0051>] TJ ET"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /ProcSet [/PDF] /Font << /F1 5 0 R /F2 6 0 R /F3 9 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length 1 /Filter /FlateDecode >>\nstream\n" + zlib.compress(content) + b"\nendstream",
        b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", b"<< /Type /Font /ToUnicode 8 0 R >>", b"<< /Length 1 >>\nstream\n" + table + b"\nendstream",
        b"<< /Length 1 >>\nstream\n" + single + b"\nendstream", b"<< /Type /Font /Subtype /Type1 >>",
    ]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1))
    assert loaders.read_pdf(data) == [("A Bfiα\nабв\nplainQ", 0)]


def test_pdf_text_is_cleaned_when_extracted(spark):
    df = spark.createDataFrame([("a", 0, "x\x00y", "/u/a.pdf"), ("b", 0, "x\x00y", "/u/b.txt")], "file_id string, part_index int, page_content string, source string")
    assert {r["file_id"]: r["text"] for r in loaders.extract_text(df).collect()} == {"a": "xy", "b": "x\x00y"}


def test_searches_keep_to_their_collection(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    for collection in ("c1", "c2"):
        ingest(store, _records(spark, {"a": [f"alpha {collection}"]}), "ann", collection)
    api = service.Service(store, collection="c1")
    assert [r["document"] for r in api.query("alpha", "a", user="ann").collect()] == ["alpha c1"]
    assert [r["document"] for r in api.query("alpha", "a", user="ann", collection="c2").collect()] == ["alpha c2"]
    assert api.query_multiple("alpha", ["a"]).count() == 1 and service.Service(store).query_multiple("alpha", ["a"]).count() == 2


def test_failed_ingest_may_take_whole_files_away(spark, tmp_path):
    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise RuntimeError("provider down")

    store = ChunkStore(spark, str(tmp_path / "s"), "dedup")
    assert ingest(store, _records(spark, {"a": ["one"], "b": ["two"]}), "ann", "c1")["status"]
    assert not ingest(store, _records(spark, {"a": ["more"]}), "ann", "c1", Broken(), whole_files=True)["status"]
    assert [r["file_id"] for r in store.read().collect()] == ["b"]


def test_intermediate_tables_go(spark):
    from pathlib import Path

    from textlode.session import intermediate, shared_dir, stage

    with intermediate(spark):
        assert stage(spark.range(3)).count() == 3
        held = set(Path(shared_dir(spark).removeprefix("file://")).glob("stage-*"))
        assert held
    assert len(held - set(Path(shared_dir(spark).removeprefix("file://")).glob("stage-*"))) == 1


def test_catalog(spark):
    spark.createDataFrame([(1, "x")], "b int, custom_id string").createOrReplaceTempView("some_chunks")
    assert "some_chunks" in service.tables(spark) and service.columns(spark, "some_chunks") == ["b", "custom_id"]
    assert service.records(spark, "some_chunks", ["some_chunks"], "x").count() == 1
    with pytest.raises(ValueError):
        service.records(spark, "other", ["some_chunks"])
    assert service.search_path("app", "x, app,public") == ["app", "x", "public"]
    assert service.use_schemas(spark, "default") == ["default"]
    assert service.find_table(spark, "some_chunks", ["default"]).count() == 1 if spark.catalog.tableExists("default.some_chunks") else True
    with pytest.raises(NotFound):
        service.use_schemas(spark, "default", "nowhere")
    with pytest.raises(NotFound):
        service.find_table(spark, "nothing", ["default"])


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    records = _records(spark, {"a": ["one"], "b": ["two", "three"]})
    records.write.parquet(source)
    store = ChunkStore(spark, str(tmp_path / "s"))
    for _ in range(2):  # started again, nothing is stored twice
        ingest_stream(watch(spark, source, records.schema), store, "ann", "c", HashingEmbedder(8), str(tmp_path / "c")).awaitTermination()
        assert store.read().count() == 3
    requests = str(tmp_path / "req")
    spark.sql("""SELECT 'f' AS file_id, 'p' AS filepath, timestamp'2025-01-01 10:00:00' AS requested_at, timestamp'2025-01-01 10:00:01' AS received_at
                 UNION ALL SELECT 'f', 'p', timestamp'2025-01-01 10:00:00', timestamp'2025-01-01 10:00:01'
                 UNION ALL SELECT 'g', 'p', timestamp'2025-01-02 10:00:00', timestamp'2025-01-02 10:00:01'""").write.parquet(requests)
    q = requests_per_window(watch(spark, requests, spark.read.parquet(requests).schema)).writeStream.format("memory").queryName("per_day").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r["day"]["start"].day: r["n_requests"] for r in spark.sql("SELECT * FROM per_day").collect()}
    assert rows == {1: 1, 2: 1}
