"""Reading files into text records ``(file_id, part_index, page_content, source, page, metadata)``.

Files come as rows of a manifest and are read where the tasks run, a file at a time; only the standard library parses them. Formats that
need more (legacy Office, encrypted files) give an error record instead of text.
"""

from __future__ import annotations

import codecs
import csv
import html
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions.text import clean_text, drop_surrogates
from textlode.session import ship
from textlode.sources.formats import extension, loader
from textlode.sources.paths import safe_path

HEAD = 4096  # bytes looked at to guess an encoding
_BOMS = [
    (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"),
    (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"),
]
Part = tuple[str, int | None]  # text, page


class Unsupported(ValueError):
    """No reader for this file."""


def detect_encoding(data: bytes) -> str:
    """The encoding of a file: by byte order mark (the longer marks first), else UTF-8 if all of it decodes, else a guess over
    the first bytes."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data[:HEAD]).best()
        if best is not None and best.encoding not in ("utf_8", "ascii"):
            high = [c for c in str(best) if c > "\x7f"]
            # a few accented letters don't tell the Latin code pages apart: then the most common one
            if len(high) >= 20 or any(c > "\u024f" for c in high):
                return best.encoding
    except ImportError:
        pass
    return "cp1252"


def decode(data: bytes) -> str:
    return data.decode(detect_encoding(data), "replace").replace("\r\n", "\n")


def read_text(data: bytes) -> list[Part]:
    return [(decode(data), None)]


def read_csv(data: bytes) -> list[Part]:
    """A record for each row, a line ``column: value`` for each column; surplus values go under the name of None."""
    reader = csv.DictReader(io.StringIO(decode(data)))
    out = []
    for row in reader:
        lines = []
        for k, v in row.items():
            value = ",".join(map(str.strip, v)) if isinstance(v, list) else (v or "").strip()
            lines.append(f"{k.strip() if k is not None else k}: {value}")
        out.append(("\n".join(lines), None))
    return out


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data[: 1 << 20]:
        raise Unsupported("entity declarations are not read")
    return ElementTree.fromstring(data)


def read_xml(data: bytes) -> list[Part]:
    """All text of the document, a line for each element that has some."""
    return [("\n".join(t.strip() for t in _tree(data).itertext() if t.strip()), None)]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element, paragraph: str, run: str) -> list[str]:
    out = []
    for p in root.iter():
        if _local(p.tag) == paragraph:
            text = "".join("\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else x.text or "" for x in p.iter() if _local(x.tag) in (run, "tab", "br"))
            if text.strip():
                out.append(text)
    return out


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise Unsupported("not an Open XML or EPUB file") from None


def _members(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [n for n in archive.namelist() if re.fullmatch(pattern, n)]
    return sorted(found, key=lambda n: [int(x) for x in re.findall(r"\d+", n)] or [0])


def read_word(data: bytes) -> list[Part]:
    with _archive(data) as z:
        return [("\n\n".join(_paragraphs(_tree(z.read("word/document.xml")), "p", "t")), None)]


def read_slides(data: bytes) -> list[Part]:
    with _archive(data) as z:
        slides = [_paragraphs(_tree(z.read(n)), "p", "t") for n in _members(z, r"ppt/slides/slide\d+\.xml")]
    return [("\n\n".join("\n".join(s) for s in slides if s), None)]


def read_sheet(data: bytes) -> list[Part]:
    """Cells of each row separated by tabs, sheets by a blank line."""
    with _archive(data) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _tree(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        sheets = []
        for name in _members(z, r"xl/worksheets/sheet\d+\.xml"):
            lines = []
            for row in (r for r in _tree(z.read(name)).iter() if _local(r.tag) == "row"):
                cells = []
                for c in (c for c in row if _local(c.tag) == "c"):
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter() if _local(t.tag) == "t"))
                        continue
                    v = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                if any(cells):
                    lines.append("\t".join(cells))
            sheets.append("\n".join(lines))
    return [("\n\n".join(s for s in sheets if s), None)]


def _plain_html(text: str) -> str:
    text = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", " ", text)
    text = re.sub(r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n", text)
    lines = [re.sub(r"[^\S\n]+", " ", x).strip() for x in html.unescape(re.sub(r"<[^>]+>", "", text)).split("\n")]
    return "\n".join(x for x in lines if x)


def read_epub(data: bytes) -> list[Part]:
    with _archive(data) as z:
        names = set(z.namelist())
        container = _tree(z.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        root, folder = _tree(z.read(package)), package.rpartition("/")[0]
        items = {x.get("id"): x.get("href") for x in root.iter() if _local(x.tag) == "item"}
        spine = [items.get(x.get("idref")) for x in root.iter() if _local(x.tag) == "itemref"]
        paths = [f"{folder}/{h}" if folder else h for h in spine if h]
        return [("\n\n".join(_plain_html(decode(z.read(p))) for p in paths if p in names), None)]


def strip_markdown(text: str) -> str:
    """Running text without Markdown's marks; code keeps its lines."""
    text = re.sub(r"(?ms)^(```|~~~)[^\n]*\n(.*?)^\1[ \t]*$", r"\2", text)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(?m)^[ \t]{0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d+\.[ \t]+)", "", text)
    text = re.sub(r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$|^[=-]{3,}[ \t]*$", "", text)
    text = re.sub(r"(\*\*|__|~~|`)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def read_markdown(data: bytes) -> list[Part]:
    return [(strip_markdown(decode(data)), None)]


def read_rst(data: bytes) -> list[Part]:
    """A record for each block; underlines of headings, directives and inline marks are dropped."""
    text = re.sub(r"(?m)^([=\-~^\"'`#*+.])\1{2,}[ \t]*$", "", decode(data))
    text = re.sub(r"(?m)^\.\. .*$", "", text)
    text = re.sub(r":\w+:`([^`<]+)(?:<[^>]*>)?`|``([^`]+)``|`([^`<]+)(?:<[^>]*>)?`_*|\*\*([^*]+)\*\*", lambda m: next(g for g in m.groups() if g is not None), text)
    return [(re.sub(r"\s*\n\s*", "\n", block).strip(), None) for block in re.split(r"\n\s*\n", text) if block.strip()]


_PDF_STRING = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>")
_PDF_TEXT = re.compile(rb"((?:\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|[^\]])*\]\s*TJ)|(-?[\d.]+\s+-?[\d.]+\s+T[dD])|(T\*|\bET\b|(?:-?[\d.]+\s+){6}Tm)|/([^\s/<>\[\]()]+)\s+-?[\d.]+\s+Tf", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_bytes(token: bytes) -> bytes:
    """The bytes of a string in hexadecimal or literal form."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _pdf_string(token: bytes, codes: tuple[int, dict[int, str]] | None = None) -> str:
    """The text of a string: by the font's table of codes, else as its bytes suggest."""
    raw = _pdf_bytes(token)
    if codes is not None:
        width, known = codes
        return "".join(known.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))
    if token.startswith(b"<"):
        return raw.decode("utf-16-be", "replace") if len(raw) > 1 and raw[0] == 0 else raw.decode("latin-1")
    return raw.decode("utf-16", "replace") if raw.startswith((b"\xfe\xff", b"\xff\xfe")) else raw.decode("cp1252", "replace")


_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")
#: Codes of one range that are spelled out, at most: two bytes have no more.
_RANGE = 1 << 16


def _to_unicode(table: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code, text by code) of a font's ToUnicode table."""

    def text(digits: bytes) -> str:
        return _pdf_bytes(b"<" + digits + b">").decode("utf-16-be", "replace")

    space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f\s]*)>", table)
    width = max(1, len(_pdf_bytes(b"<" + space[1] + b">"))) if space else 2
    known: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        found = _HEX.findall(block)
        known |= {int(a, 16): text(b) for a, b in zip(found[::2], found[1::2]) if a.strip()}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for lo, hi, first, several in re.findall(rb"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", block, re.S):
            start, end = int(lo, 16), int(hi, 16)
            if several:
                known |= {start + k: text(d) for k, d in enumerate(_HEX.findall(several))}
            elif first and 0 <= end - start < _RANGE:
                base = text(first)
                known |= {start + k: base[:-1] + chr(min(ord(base[-1]) + k, 0x10FFFF)) for k in range(end - start + 1) if base}
    return width, known


def read_pdf(data: bytes) -> list[Part]:
    """The text of PDF pages, one record a page from 0: by the fonts' ToUnicode tables, else as bytes of common encodings. Images, forms and encrypted
    files are not read."""
    if not data.lstrip().startswith(b"%PDF"):
        raise Unsupported("not a PDF file")
    if b"/Encrypt" in data:
        raise Unsupported("encrypted PDF")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        if not m:
            return b""
        if b"/FlateDecode" in body[: m.start()]:
            return zlib.decompressobj().decompress(m[1])
        if b"/Filter" in body[: m.start()]:
            return b""
        return m[1]

    for body in list(objects.values()):
        if b"/ObjStm" in body:  # objects packed into a stream
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            flat = stream(body)
            index = list(map(int, flat[:first].split()[: 2 * n]))
            ends = [*index[3::2], len(flat) - first]
            for number, at, end in zip(index[::2], index[1::2], ends):
                objects.setdefault(number, flat[first + at : first + end])

    def pages(number: int, depth: int = 0) -> Iterator[bytes]:
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids and depth < 50:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                yield from pages(int(k), depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body

    tables: dict[int, tuple[int, dict[int, str]]] = {}

    def part(body: bytes, name: bytes) -> bytes:
        """A dictionary inside ``body`` or the object that it refers to; empty if there is none."""
        at = re.search(rb"/" + name + rb"\s*(?:(\d+)\s+\d+\s+R|<<)", body)
        if not at:
            return b""
        if at[1]:
            return objects.get(int(at[1]), b"")
        depth, k = 1, at.end()
        while depth and k < len(body):  # to the end of nested dictionaries
            step = body[k : k + 2]
            depth += (step == b"<<") - (step == b">>")
            k += 2 if step in (b"<<", b">>") else 1
        return body[at.end() : k]

    def fonts(page: bytes, depth: int = 0) -> dict[bytes, tuple[int, dict[int, str]]]:
        """The tables of a page's fonts that have one, by name; resources may be those of a parent."""
        own = part(part(page, b"Resources"), b"Font")
        parent = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", page)
        if not own and parent and depth < 50:
            return fonts(objects.get(int(parent[1]), b""), depth + 1)
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", own):
            table = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(int(number), b""))
            if table:
                if int(table[1]) not in tables:
                    tables[int(table[1])] = _to_unicode(stream(objects.get(int(table[1]), b"")))
                out[name] = tables[int(table[1])]
        return out

    root = next((re.search(rb"/Pages\s+(\d+)", b) for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), None)
    found = list(pages(int(root[1]))) if root else [b for b in objects.values() if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for k, page in enumerate(found):
        content = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", page, re.S)
        text, by_font, font = [], fonts(page), None
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", (content[1] or content[2]) if content else b""):
            for m in _PDF_TEXT.finditer(stream(objects.get(int(ref), b""))):
                if m[4]:
                    font = by_font.get(m[4])
                elif m[1]:
                    text += [_pdf_string(t, font) for t in _PDF_STRING.findall(m[1])]
                elif m[3] or not re.match(rb"-?[\d.]+\s+-?0*\.?0*\s+T", m[2]):
                    text.append("\n")
        lines = [x.strip() for x in "".join(text).split("\n")]
        out.append(("\n".join(x for x in lines if x), k))
    return out


READERS: dict[str, Callable[[bytes], list[Part]]] = {
    "pdf": read_pdf, "csv": read_csv, "rst": read_rst, "xml": read_xml, "slides": read_slides, "markdown": read_markdown, "epub": read_epub,
    "word": read_word, "sheet": read_sheet, "json": read_text, "text": read_text, "unknown": read_text,
}
SCHEMA = "file_id string, part_index int, page_content string, source string, page int, metadata string, error string"


def load_bytes(data: bytes, kind: str, raw: bool = False) -> list[Part]:
    """The records of a file; ``raw`` keeps Markdown as it is."""
    parts = (read_text if raw and kind == "markdown" else READERS[kind])(data)
    return [(drop_surrogates(t), p) for t, p in parts]


def load(manifest: DataFrame, raw: bool = False) -> DataFrame:
    """Records of every file of ``manifest`` (file_id, filename, file_content_type, path, content binary).

    A file that can't be read gives one record without text and with ``error``; the others go on. ``source`` is the file's own path.
    """
    ship(manifest.sparkSession)
    rows = manifest.select("file_id", "path", loader(F.col("filename"), F.col("file_content_type")).alias("kind"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for file_id, path, kind, content in batch.itertuples(index=False):
                try:
                    if content is None:
                        raise FileNotFoundError("no such file in the folder")
                    parts = load_bytes(bytes(content), kind, raw)
                    out = [(file_id, k, t, path, p, json.dumps({"source": path} | ({} if p is None else {"page": p})), None) for k, (t, p) in enumerate(parts)]
                except Exception as e:  # noqa: BLE001 - one bad file mustn't end the job; what failed is reported
                    out = [(file_id, 0, None, path, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(out, columns=columns).astype({"page": "Int32"})

    return rows.mapInPandas(run, SCHEMA)


#: Files up to this number are opened by name; of more, all of the folder are read and the others dropped.
NAMED_FILES = 10_000


def read_files(requests: DataFrame, folder: str) -> DataFrame:
    """The manifest of the files under ``folder`` that ``requests`` (file_id, filename, file_content_type, filepath) name, by a path in the folder or a
    whole one. A file requested again is there once a request. What isn't a file below the folder, links that lead out of it included, has no content,
    and ``load`` reports it."""
    spark = requests.sparkSession
    base = folder.rstrip("/")
    path = F.col("filepath")
    whole = F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(f"{base}/"), path))
    wanted = requests.select("file_id", "filename", "file_content_type", F.regexp_replace(whole, r"^file:/*", "/").alias("path"))

    @F.pandas_udf("boolean")
    def inside(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not p.startswith("file:") or safe_path(base.removeprefix("file://"), re.sub("^file:/*", "/", p)) is not None)

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    plain = F.regexp_replace("at", r"^file:/*", "/").alias("path")
    # only names are listed here: no content is read
    there = reader.load(folder).select(F.col("path").alias("at")).where(inside("at")).select("at", plain)
    there = there.join(wanted.select("path").distinct(), "path", "left_semi")
    named = [r["at"] for r in there.select("at").limit(NAMED_FILES + 1).collect()]
    if len(named) > NAMED_FILES:
        files = reader.load(folder).select(F.col("path").alias("at"), "content").join(there.select("at"), "at", "left_semi")
    elif named:
        files = reader.load(named).select(F.col("path").alias("at"), "content")
    else:
        files = spark.createDataFrame([], "at string, content binary")
    return wanted.join(files.select(plain, "content"), "path", "left").select("file_id", "filename", "file_content_type", "path", "content")


def extract_text(records: DataFrame, clean: Column | bool = False) -> DataFrame:
    """``(file_id, text)``: the verbatim text of each file, its parts each on lines of their own, without newlines at the end. ``clean`` says
    where U+0000 is removed; text of PDF files is always cleaned."""
    pdf = F.coalesce(extension(F.col("source")) == "pdf", F.lit(False))
    content = F.when(pdf | (F.lit(clean) if isinstance(clean, bool) else clean), clean_text(F.col("page_content"))).otherwise(F.col("page_content"))
    parts = F.array_sort(F.collect_list(F.struct("part_index", content.alias("t"))))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["t"], F.lit("\n"))), "")
    return records.where("page_content IS NOT NULL").groupBy("file_id").agg(F.rtrim(joined, F.lit("\n")).alias("text"))
