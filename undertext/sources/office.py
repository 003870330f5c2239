"""DOCX and PPTX files as tables, by the standard library, a batch of files at a time."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Limits of a file, of one part and of a whole package, in bytes.
MOST_FILE, MOST_PART, MOST_PACKAGE = 50 << 20, 100 << 20, 200 << 20
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
TRUE = ("1", "true", "on")

RUN_SCHEMA = "path string, error string, para_no int, run_no int, text string, hidden boolean, size_pt double, color_val string"
SHAPE_SCHEMA = "path string, error string, slide_no int, shape_id string, left_emu double, top_emu double, text string, notes string"


class Unreadable(Exception):
    """Carries the error code of a file."""


def package(content: bytes) -> zipfile.ZipFile:
    if content[:8] == COMPOUND:
        raise Unreadable("ENCRYPTED")
    try:
        found = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable("CORRUPT") from e
    sizes = [i.file_size for i in found.infolist()]
    if max(sizes, default=0) > MOST_PART or sum(sizes) > MOST_PACKAGE:
        raise Unreadable("OVERSIZED")
    return found


def tree(files: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        raw = files.read(name)
        if b"<!DOCTYPE" in raw[:4096]:
            raise Unreadable("CORRUPT")
        return ElementTree.fromstring(raw)
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile) as e:
        raise Unreadable("CORRUPT") from e


def run_text(run: ElementTree.Element) -> str:
    plain = {f"{W}tab": "\t", f"{W}ptab": "\t", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    out = []
    for x in run:
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}br":
            out.append("\n" if x.get(f"{W}type") in (None, "textWrapping") else "")
        else:
            out.append(plain.get(x.tag, ""))
    return "".join(out)


def half_points(value: str | None) -> float | None:
    return int(value) / 2 if value and value.isascii() and value.isdigit() else None


def docx_runs(content: bytes) -> list[tuple]:
    """(para_no, run_no, text, hidden, size_pt, color_val) of runs directly in paragraphs directly in the body."""
    body = tree(package(content), "word/document.xml").find(f"{W}body")
    out = []
    for para_no, para in enumerate(body.findall(f"{W}p") if body is not None else [], 1):
        for run_no, run in enumerate(para.findall(f"{W}r"), 1):
            get = lambda name: run.find(f"{W}rPr/{W}{name}")  # noqa: B023, E731
            vanish, size, color = get("vanish"), get("sz"), get("color")
            hidden = None if vanish is None else vanish.get(f"{W}val", "true") in TRUE
            out.append((para_no, run_no, run_text(run), hidden, half_points(size.get(f"{W}val") if size is not None else None), color.get(f"{W}val") if color is not None else None))
    return out


def relations(files: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """(id, kind, target) of a part's relationships; none if it has no such file."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in files.namelist():
        return []
    return [(x.get("Id"), x.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join(folder, x.get("Target", ""))).lstrip("/")) for x in tree(files, path)]


def body_text(holder: ElementTree.Element | None) -> str | None:
    if holder is None:
        return None
    return "\n".join("".join("\v" if x.tag == f"{A}br" else (x.findtext(f"{A}t") or "") for x in p if x.tag in (f"{A}r", f"{A}br", f"{A}fld")) for p in holder.findall(f"{A}p"))


def number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def pptx_shapes(content: bytes) -> list[tuple]:
    """(slide_no, shape_id, left_emu, top_emu, text, notes); a row without a shape carries a slide's notes."""
    files = package(content)
    main = "ppt/presentation.xml"
    targets = {i: t for i, _, t in relations(files, main)}
    slides = [targets.get(x.get(f"{R}id")) for x in tree(files, main).iter(f"{P}sldId")]
    out = []
    for slide_no, part in enumerate([s for s in slides if s in files.namelist()], 1):
        note = next((t for _, kind, t in relations(files, part) if kind == "notesSlide"), None)
        notes = None
        if note in files.namelist():
            bodies = [s for s in tree(files, note).iter(f"{P}sp") if (ph := s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and ph.get("type") == "body"]
            notes = body_text(bodies[0].find(f"{P}txBody")) if bodies else None
        out.append((slide_no, None, None, None, None, notes))
        shapes = tree(files, part).find(f"{P}cSld/{P}spTree")
        for shape in [s for s in (shapes if shapes is not None else []) if s.tag == f"{P}sp"]:
            name, off = shape.find(f"{P}nvSpPr/{P}cNvPr"), shape.find(f"{P}spPr/{A}xfrm/{A}off")
            left, top = (number(off.get(k)) if off is not None else None for k in ("x", "y"))
            out.append((slide_no, name.get("id") if name is not None else None, left, top, body_text(shape.find(f"{P}txBody")), None))
    return out


def _reader(parse, schema: str):
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    rows = [(path, None, *r) for r in parse(content or b"")]
                except Unreadable as e:
                    rows = [(path, str(e), *[None] * (len(fields) - 2))]
                columns = list(zip(*rows)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    return run


def read_runs(files: DataFrame) -> DataFrame:
    """Runs of the DOCX files in a binaryFile table; a file that cannot be read has one row with its error code."""
    return files.where(F.col("length") <= MOST_FILE).select("path", "content").mapInArrow(_reader(docx_runs, RUN_SCHEMA), RUN_SCHEMA)


def read_shapes(files: DataFrame) -> DataFrame:
    """Slides and shapes of the PPTX files in a binaryFile table, errors as in read_runs."""
    return files.where(F.col("length") <= MOST_FILE).select("path", "content").mapInArrow(_reader(pptx_shapes, SHAPE_SCHEMA), SHAPE_SCHEMA)


def oversized(files: DataFrame) -> DataFrame:
    """Files beyond the limit; their content is never read."""
    return files.where(F.col("length") > MOST_FILE).select("path", F.lit("OVERSIZED").alias("error"))
