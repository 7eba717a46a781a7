"""Margin comments in Word documents: a copy of a file with a comment plan written into it.

The texts of the copy are read again and compared with the original's, and a difference is an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from .docx import MAIN, W, Refused, _State, _text, _tree, _walk, parse_docx

COMMENTS = "word/comments.xml"
_NS = W[1:-1]


def annotate_docx(name: str, data: bytes, plan: list[tuple[str, str]], author: str = "Audit") -> bytes:
    """data with a comment for each (paragraph id, text); ids that are not in the main part are an error."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    parts = {i.filename: archive.read(i.filename) for i in archive.infolist()}
    for prefix, uri in re.findall(r'xmlns:(\w+)="([^"]+)"', parts[MAIN].decode("utf-8", "replace")):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    root = _tree(parts[MAIN])
    found: list = []
    _walk(root, _State(""), found, [])
    shown = [p for p, _ in found if _text(p).strip()]
    at = {f"P{i + 1:04d}": p for i, p in enumerate(shown)}
    old = parts.get(COMMENTS, b"").decode("utf-8", "replace")
    number = 1 + max([-1, *map(int, re.findall(r'w:id="(\d+)"', old))])
    made = []
    for paragraph, text in plan:
        if paragraph not in at:
            raise Refused(f"no paragraph {paragraph}")
        node = at[paragraph]
        mark = {W + "id": str(number)}
        first = 1 if len(node) and node[0].tag == W + "pPr" else 0
        node.insert(first, ElementTree.Element(W + "commentRangeStart", mark))
        node.append(ElementTree.Element(W + "commentRangeEnd", mark))
        run = ElementTree.SubElement(node, W + "r")
        ElementTree.SubElement(run, W + "commentReference", mark)
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
        made.append(f'<w:comment w:id="{number}" w:author="{escape(author, {chr(34): "&quot;"})}" w:initials="A">{body}</w:comment>')
        number += 1
    parts[MAIN] = ElementTree.tostring(root, "utf-8", xml_declaration=True)
    if old:
        parts[COMMENTS] = old.replace("</w:comments>", "".join(made) + "</w:comments>").encode()
    else:
        parts[COMMENTS] = f'<?xml version="1.0" encoding="UTF-8"?><w:comments xmlns:w="{_NS}">{"".join(made)}</w:comments>'.encode()
        links = "word/_rels/document.xml.rels"
        base = parts.get(links, b'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>').decode()
        parts[links] = base.replace("</Relationships>", '<Relationship Id="rIdAuditComments" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments" Target="comments.xml"/></Relationships>').encode()
        types = parts.get("[Content_Types].xml", b"").decode()
        parts["[Content_Types].xml"] = types.replace("</Types>", '<Override PartName="/word/comments.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"/></Types>').encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, content in parts.items():
            z.writestr(part, content)
    if parse_docx(name, out.getvalue())["records"] != parse_docx(name, data)["records"]:
        raise Refused("the copy's text would differ")
    return out.getvalue()
