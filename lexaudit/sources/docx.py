"""Word documents as rows.

Files come through Spark's `binaryFile`, so any file system works and Spark deals them out; each is
parsed in an Arrow batch by one pass over the XML tree, with what a node inherits (container kind,
deletion, inactive alternative) passed down. A file that breaks a limit becomes a row with `error`.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from dataclasses import dataclass, replace
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: limits, name spaces and part names
MAX_FILE, MAX_ENTRIES, MAX_INFLATED, MAX_PART = 25 << 20, 3000, 150 << 20, 15 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
MAIN = "word/document.xml"
PARTS = re.compile(r"word/(?:header\d*|footer\d*|footnotes|endnotes)\.xml")
EMU_PER_INCH = 914400
JPEG_FRAMES = {192, 193, 194, 195, 197, 198, 199, 201, 202, 203, 205, 206, 207}
WRITTEN = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-", W + "softHyphen": "­"}

RECORD = "struct<rec_no:int,id:string,text:string,part:string,kind:string,style:string,highlighted:boolean>"
IMAGE = "struct<img_no:int,relationship_id:string,part:string,path:string,name:string,description:string,external:boolean,missing:boolean,width:int,height:int,dpi:double>"
SCHEMA = f"path string, records array<{RECORD}>, images array<{IMAGE}>, table_count int, warnings array<string>, saved_words int, is_word boolean, error string"


class Refused(Exception):
    """A file outside the limits or without text."""


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a PNG, GIF or JPEG header."""
    if data[:4] == b"\x89PNG" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 8 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xD9, 0xDA):  # end of image, start of scan
            return None
        if marker in (0, 0xFF) or 0xD0 <= marker <= 0xD8:  # no payload
            at += 2
            continue
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        if size < 2 or at + 2 + size > len(data):
            return None
        if marker in JPEG_FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def resolve(part: str, target: str) -> str:
    """The path in the archive that a relationship of a part points at."""
    if target.startswith("/"):
        return target[1:]
    out = part.split("/")[:-1]
    for step in target.split("/"):
        if step == "..":
            out = out[:-1]
        elif step != ".":
            out.append(step)
    return "/".join(out)


def _on(node) -> bool:
    return node.get(W + "val", node.get("val", "")).lower() not in ("false", "0", "off")


def _live(node):
    """Children, but of an alternative's choices and fallbacks only the first choice."""
    choice = node.find(MC + "Choice") if any(c.tag in (MC + "Choice", MC + "Fallback") for c in node) else None
    for child in node:
        if choice is None or child is choice or child.tag not in (MC + "Choice", MC + "Fallback"):
            yield child


@dataclass(frozen=True)
class _State:
    kind: str
    textbox: bool = False
    table: bool = False
    drawing: object = None


def _text(node, top: bool = True) -> str:
    """What a paragraph shows: no deleted or hidden text, no field codes, no paragraphs inside."""
    tag = node.tag
    if not top and tag in (W + "p", W + "del", W + "moveFrom", W + "instrText"):
        return ""
    if tag == W + "r" and (p := node.find(W + "rPr")) is not None and any(_on(v) for v in p.iter(W + "vanish")):
        return ""
    if tag in (W + "t", M + "t"):
        return "".join(node.itertext())
    return WRITTEN.get(tag, "") + "".join(_text(c, False) for c in _live(node))


def _walk(node, state: _State, paragraphs: list, blips: list) -> None:
    tag = node.tag
    if tag in (W + "footnote", W + "endnote") and node.get(W + "type") in ("separator", "continuationSeparator", "continuationNotice"):
        return
    if tag == W + "p":
        paragraphs.append((node, state.kind or ("textbox" if state.textbox else "table" if state.table else "body")))
    elif tag == A + "blip":
        blips.append((node, state.drawing))
    state = replace(state, textbox=True) if tag == W + "txbxContent" else replace(state, table=True) if tag == W + "tbl" else replace(state, drawing=node) if tag == W + "drawing" else state
    for child in _live(node):
        if child.tag in (W + "del", W + "moveFrom"):  # deleted paragraphs go, deleted pictures are still assets
            _walk(child, state, [], blips)
        else:
            _walk(child, state, paragraphs, blips)


def _tree(data: bytes):
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise Refused("a part declares entities")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Refused("a part is no readable XML") from e


def parse_docx(path: str, data: bytes) -> dict:
    """One file as a row of SCHEMA."""
    row: dict = {"path": path, "records": [], "images": [], "table_count": 0, "warnings": [], "saved_words": None, "is_word": None, "error": None}
    try:
        _fill(row, path, data)
    except (Refused, zipfile.BadZipFile, RecursionError, NotImplementedError) as e:
        row |= {"records": [], "images": [], "error": str(e) or type(e).__name__}
    return row


def _fill(row: dict, path: str, data: bytes) -> None:
    if not path.lower().endswith(".docx"):
        raise Refused("not a .docx file")
    if len(data) > MAX_FILE:
        raise Refused("the file is too large")
    archive = zipfile.ZipFile(io.BytesIO(data))
    sizes = {i.filename: i.file_size for i in archive.infolist()}
    if len(sizes) > MAX_ENTRIES or sum(sizes.values()) > MAX_INFLATED:
        raise Refused("the archive is too large")
    if MAIN not in sizes:
        raise Refused(f"{MAIN} is missing")
    for part in [MAIN, *sorted(n for n in sizes if PARTS.fullmatch(n))]:
        text = archive.read(part)
        if len(text.decode("utf-8", "replace")) > MAX_PART:
            raise Refused("a part is too large")
        root = _tree(text)
        own = next((k for k, p in (("header", "word/header"), ("footer", "word/footer"), ("footnote", "word/footnotes"), ("endnote", "word/endnotes")) if part.startswith(p)), "")
        paragraphs, blips = [], []
        _walk(root, _State(own), paragraphs, blips)
        for p, kind in paragraphs:
            shown = _text(p)
            if not shown.strip():
                continue
            n = len(row["records"]) + 1
            style = next((s.get(W + "val", "") for s in p.iter(W + "pStyle")), "")
            row["records"].append({"rec_no": n, "id": f"P{n:04d}", "text": shown, "part": part, "kind": kind, "style": style, "highlighted": any(h.get(W + "val") != "none" for h in p.iter(W + "highlight"))})
        if part == MAIN:
            row["table_count"] = sum(1 for _ in root.iter(W + "tbl"))
        _images(row, archive, sizes, part, blips)
        tags = {e.tag for e in root.iter()}
        for code, names in (("altchunk", ("altChunk",)), ("tracked-changes", ("del", "ins")), ("objects", ("object", "pict"))):
            if tags & {W + n for n in names}:
                row["warnings"].append(f"{code}:{part}")
    if not row["records"]:
        raise Refused("no text to audit")
    if "docProps/app.xml" in sizes:
        try:
            values = {e.tag.rpartition("}")[2]: "".join(e.itertext()) for e in _tree(archive.read("docProps/app.xml"))}
            if values.get("Words", "").strip().isdecimal() and int(values["Words"]) > 0:
                row |= {"saved_words": int(values["Words"]), "is_word": bool(re.search("Microsoft.*Word", values.get("Application", ""), re.I))}
        except Refused:
            row["warnings"].append("word-statistics")


def _images(row: dict, archive, sizes: dict, part: str, blips: list) -> None:
    folder, _, name = part.rpartition("/")
    links = f"{folder}/_rels/{name}.rels"
    relations = {r.get("Id"): r for r in _tree(archive.read(links))} if links in sizes else {}
    for blip, drawing in blips:
        rid = blip.get(R + "embed") or blip.get(R + "link") or ""
        rel = relations.get(rid)
        external = rel is not None and rel.get("TargetMode") == "External"
        path = resolve(part, rel.get("Target", "")) if rel is not None and not external else ""
        size = image_size(archive.read(path)) if path in sizes else None
        extent = next(drawing.iter(WP + "extent"), None) if drawing is not None else None
        about = next(drawing.iter(WP + "docPr"), None) if drawing is not None else None
        inches = float(extent.get("cx", 0)) / EMU_PER_INCH if extent is not None else 0
        row["images"].append({
            "img_no": len(row["images"]), "relationship_id": rid, "part": part, "path": path, "name": about.get("name") if about is not None else path, "description": about.get("descr") if about is not None else "",
            "external": external, "missing": not (external or path in sizes), "width": size[0] if size else None, "height": size[1] if size else None, "dpi": size[0] / inches if size and inches else None,
        })


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """One row of SCHEMA for each .docx file below a path or glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return parse_files(files)


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of (path, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield pa.RecordBatch.from_pylist([parse_docx(path or "", data or b"")], schema=arrow)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def records(parsed: DataFrame, doc_id: str = "path") -> DataFrame:
    return parsed.select(F.col(doc_id).alias("doc_id"), F.inline("records"))


def images(parsed: DataFrame, doc_id: str = "path") -> DataFrame:
    return parsed.select(F.col(doc_id).alias("doc_id"), F.inline("images"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): whole plain-text files, doc_id being a hash of the path."""
    files = spark.read.option("wholetext", "true").text(path).withColumn("path", F.col("_metadata.file_path"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("value").alias("text"))
