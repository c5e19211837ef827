"""Blocks as files again: Markdown, plain text and DOCX, and writing them within a bound."""

from __future__ import annotations

import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.files import MOST_BYTES

KINDS = ("md", "txt", "docx")
_STYLES = {"list_item": "ListParagraph", "caption": "Caption", "quote": "Quote", "code": "Code"}


def markdown(blocks: list[dict]) -> str:
    """Markdown that reads back as the same blocks."""
    parts = []
    for b in blocks:
        text = b["text"]
        if b["kind"] == "heading":
            text = f"{'#' * (b['level'] or 1)} {text}"
        elif b["kind"] == "table":
            head, *rows = text.split("\n")
            text = "\n".join([head, "|" + "---|" * max(1, head.count("|") - 1), *rows])
        elif b["kind"] == "quote":
            text = f"> {text}"
        elif b["kind"] == "code":
            text = f"```\n{text}\n```"
        parts.append(text)
    return "\n\n".join(parts) + "\n"


def plain(blocks: list[dict]) -> str:
    """The texts, blank lines between and page breaks as form feeds."""
    out, page = "", None
    for b in blocks:
        out += "\f" if page is not None and b["page"] != page else "\n\n" if out else ""
        out, page = out + b["text"], b["page"]
    return out + "\n"


def docx(blocks: list[dict], title: str = "") -> bytes:
    """A DOCX file with styles for headings, lists, captions, quotes and code, and page breaks."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda text: "<w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n")) + "</w:r>"
    styled = lambda text, style, before="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{before}{run(text)}</w:p>'
    body, page = "", None
    for b in blocks:
        turn = '<w:r><w:br w:type="page"/></w:r>' if page is not None and b["page"] != page else ""
        page = b["page"]
        if b["kind"] == "table":
            body += f"<w:p>{turn}</w:p>" if turn else ""
            rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in b["text"].split("\n")]
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{styled(c, 'Normal')}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
        else:
            body += styled(b["text"], f"Heading{b['level'] or 1}" if b["kind"] == "heading" else _STYLES.get(b["kind"], "Normal"), turn)
    kinds = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
    core = f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", kinds), ("docProps/core.xml", core), ("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _number(x) -> int | None:
    """Whole numbers with gaps arrive as floats."""
    return None if x is None or x != x else int(x)


def render(documents: DataFrame, kind: str) -> DataFrame:
    """(document_id, name, content) of documents (document_id, title, blocks) as files of one kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    key = documents.schema["document_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            made = []
            for doc, title, blocks in pdf.itertuples(index=False):
                rows = [{"kind": b["kind"], "level": _number(b["level"]), "page": _number(b["page"]) or 1, "text": b["text"] or ""} for b in (blocks if blocks is not None else [])]
                data = docx(rows, title or "") if kind == "docx" else (markdown(rows) if kind == "md" else plain(rows)).encode()
                made.append((doc, f"{doc}.{kind}", data))
            yield pd.DataFrame(made, columns=["document_id", "name", "content"])

    return documents.select("document_id", "title", "blocks").mapInPandas(run, f"document_id {key}, name string, content binary")


def write_files(files: DataFrame, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(name, bytes, written): each file of (name, content) under ``folder``, a URI that all executors share.

    A file goes to a part of its own name first and is moved when it is whole, so a lost executor leaves no half of one; files over ``most_bytes``,
    and names that would leave the folder, are not written. Nothing happens until the result is read.
    """

    def run(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for pdf in batches:
            made = []
            for name, data in pdf.itertuples(index=False):
                fine = len(data) <= most_bytes and "/" not in name and "\\" not in name and name not in ("", ".", "..")
                if fine:
                    part = f"{root}/{name}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part) as out:
                        out.write(bytes(data))
                    store.move(part, f"{root}/{name}")
                made.append((name, len(data), fine))
            yield pd.DataFrame(made, columns=["name", "bytes", "written"])

    return files.select("name", F.coalesce("content", F.lit(b"")).alias("content")).mapInPandas(run, "name string, bytes bigint, written boolean")
