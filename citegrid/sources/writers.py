"""Texts as files of several formats, as binary columns, with comments on spans where a format has them."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape
from ..operators.rich import TAGS, rich_html

FORMATS = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "rtf": "application/rtf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "odt": "application/vnd.oasis.opendocument.text", "pdf": "application/pdf"}
# made by operators.reports from findings, not from texts
REPORTS = {"json": "application/json", "csv": "text/csv", "report-md": "text/markdown"}
COMMENTED = ("docx", "odt")
_HEAD, _FOOT = '<!doctype html>\n<html><head><meta charset="utf-8"></head><body>\n', "\n</body></html>\n"
_INVALID = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
Comment = tuple[int, int, str]
Mark = tuple[str, int, int]
MARKS = ("bold", "italic", "underline")


def paragraphs(text: str, comments: list[Comment], marks: list[Mark] = ()) -> list[list[tuple]]:
    """Paragraphs as parts: ("text", words, their marks), ("start", number of a comment) and ("end", number).

    At one place ends come before starts. Comments without length, or past the text, are left
    out. Offsets are those of the given text; characters that XML does not allow are dropped.
    """
    gone = [m.start() for m in _INVALID.finditer(text)] if _INVALID.search(text) else []
    text = _INVALID.sub("", text) if gone else text
    moved = lambda p: p - bisect_right(gone, p - 1) if gone else p
    places = [(moved(s), moved(e)) for s, e, _ in comments]
    stops = sorted(m for i, (s, e) in enumerate(places) if 0 <= s < e <= len(text) for m in ((s, 1, i), (e, 0, i)))
    inked = [(m, moved(s), moved(e)) for m, s, e in marks] if gone else marks
    cuts = sorted({p for _, s, e in inked for p in (s, e)})

    def words(a: int, b: int) -> list[tuple]:
        if a >= b:
            return []
        if not cuts:
            return [("text", text[a:b], ())]
        out, x = [], a
        for y in (*cuts[bisect_right(cuts, a) : bisect_left(cuts, b)], b):
            here = [k for k, s, e in inked if s <= x < e]
            out.append(("text", text[x:y], tuple([m for m in MARKS if m in here]) if here else ()))
            x = y
        return out

    out, at, k = [], 0, 0
    for line in text.split("\n"):
        if not stops:
            out.append(words(at, at + len(line)))
            at += len(line) + 1
            continue
        parts: list[tuple] = []
        end = at + len(line)
        while k < len(stops) and stops[k][0] <= end:
            place, kind, i = stops[k]
            parts += words(at, place)
            parts.append(("start" if kind else "end", i))
            at, k = place, k + 1
        out.append(parts + words(at, end))
        at = end + 1
    return out


def rich_page(text: Column, marks: Column) -> Column:
    return F.concat(F.lit(_HEAD), rich_html(text, marks), F.lit(_FOOT))


def html_page(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<p>"), html_escape(x), F.lit("</p>")))
    return F.concat(F.lit(_HEAD), F.array_join(lines, "\n"), F.lit(_FOOT))


def html_document(text: str, comments: list[Comment] = (), marks: list[Mark] = ()) -> bytes:
    """The page that rich_page gives, made outside the JVM. It has no comments."""

    def made(x: str, ink: tuple[str, ...]) -> str:
        x = escape(x, {'"': "&quot;"})
        for m in reversed(ink):
            x = f"<{TAGS[m]}>{x}</{TAGS[m]}>"
        return x

    lines = "\n".join("<p>" + "".join(made(x, ink) for _, x, ink in line) + "</p>" for line in paragraphs(text, [], marks))
    return f"{_HEAD}{lines}{_FOOT}".encode()


_RTF_MARKS = {"bold": "\\b", "italic": "\\i", "underline": "\\ul"}


_RTF_SPECIAL = re.compile(r"[\\{}\t]|[^\x00-\x7f]")


def _rtf_code(m: re.Match) -> str:
    c = m[0]
    if c in "\\{}":
        return "\\" + c
    if c == "\t":
        return "\\tab "
    units = c.encode("utf-16-le")
    return "".join(f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2))


def _rtf(text: str) -> str:
    return _RTF_SPECIAL.sub(_rtf_code, text)


def rtf_document(text: str, comments: list[Comment] = (), marks: list[Mark] = ()) -> bytes:
    """An RTF file; marked words stand in groups. It has no comments."""
    made = lambda x, ink: f"{{{''.join(_RTF_MARKS[m] for m in ink)} {_rtf(x)}}}" if ink else _rtf(x)
    lines = ["".join(made(x, ink) for _, x, ink in line) for line in paragraphs(text, [], marks)]
    return ("{\\rtf1\\ansi\\uc1\n" + "\\par\n".join(lines) + "}").encode("ascii")


SHORT = 3800  # bytes that a window of 4 KB has in sight
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
_DAY = (1980 - 1980) << 9 | 1 << 5 | 1  # the first that an archive can tell


def _member(name: str, content: str, plain: bool = False) -> tuple[bytes, bytes, tuple]:
    """A part of an archive: its name, its bytes as they stand there, and what both directories say of them."""
    data = content.encode()
    # a window of 32 KB takes longer to set up than a short part to pack, and has no more in sight
    packed = data if plain else zlib.compress(data, wbits=-12 if len(data) <= SHORT else -zlib.MAX_WBITS)
    return name.encode(), packed, (20, 0, 0 if plain else 8, 0, _DAY, zlib.crc32(data), len(packed), len(data), len(name.encode()), 0)



def _zip(parts: list[tuple[bytes, bytes, tuple]]) -> bytes:
    """Parts as an archive. The module zipfile takes several times as long for so small ones."""
    out, directory = bytearray(), bytearray()
    for name, packed, told in parts:
        directory += _CENTRAL.pack(b"PK\x01\x02", 20, *told, 0, 0, 0, 0o600 << 16, len(out)) + name
        out += _LOCAL.pack(b"PK\x03\x04", *told) + name + packed
    return bytes(out + directory + _END.pack(b"PK\x05\x06", 0, 0, len(parts), len(parts), len(directory), len(out), 0))


_WORD_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_WORD_PART = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _relations(kind: str, target: str) -> str:
    return f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/{kind}" Target="{target}"/></Relationships>'


@lru_cache(2)
def _word_fixed(commented: bool) -> tuple[list, list]:
    """What stands in front of the text and behind it, the same in all files: packed once."""
    types = [("document", "main")] + ([("comments", "comments")] if commented else [])
    overrides = "".join(f'<Override PartName="/word/{name}.xml" ContentType="{_WORD_PART}.{kind if kind != "main" else "document.main"}+xml"/>' for name, kind in types)
    front = [
        _member("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{overrides}</Types>'),
        _member("_rels/.rels", _relations("officeDocument", "word/document.xml")),
    ]
    return front, [_member("word/_rels/document.xml.rels", _relations("comments", "comments.xml"))] if commented else []


_WORD_MARKS = {"bold": "<w:b/>", "italic": "<w:i/>", "underline": '<w:u w:val="single"/>'}


@lru_cache(64)
def _word_look(ink: tuple[str, ...]) -> str:
    return f"<w:rPr>{''.join(_WORD_MARKS[m] for m in ink)}</w:rPr>" if ink else ""


def _word_run(x: str, ink: tuple[str, ...] = ()) -> str:
    return f'<w:r>{_word_look(ink)}<w:t xml:space="preserve">{escape(x)}</w:t></w:r>'


def docx_document(text: str, comments: list[Comment] = (), marks: list[Mark] = ()) -> bytes:
    """A DOCX file; marked words are runs with properties; the part with comments and the relation to it are there only if there are comments."""
    made = {
        "text": _word_run,
        "start": lambda i: f'<w:commentRangeStart w:id="{i}"/>',
        "end": lambda i: f'<w:commentRangeEnd w:id="{i}"/><w:r><w:commentReference w:id="{i}"/></w:r>',
    }
    lines = paragraphs(text, list(comments), marks)
    used = sorted({x[0] for line in lines for kind, *x in line if kind == "start"})
    body = "".join("<w:p>" + "".join(made[kind](*x) for kind, *x in line) + "</w:p>" for line in lines)
    front, back = _word_fixed(bool(used))
    parts = [*front, _member("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_WORD_NS}><w:body>{body}</w:body></w:document>')]
    if used:
        notes = "".join(f'<w:comment w:id="{i}" w:author="citegrid">' + "".join(f'<w:p>{made["text"](x)}</w:p>' for x in _INVALID.sub("", comments[i][2]).split("\n")) + "</w:comment>" for i in used)
        parts += [_member("word/comments.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:comments {_WORD_NS}>{notes}</w:comments>')]
    return _zip(parts + back)


_ODT_MARKS = {"bold": 'fo:font-weight="bold"', "italic": 'fo:font-style="italic"', "underline": 'style:text-underline-style="solid"'}


@lru_cache(64)
def _odt_style(ink: tuple[str, ...]) -> str:
    return "T" + "".join(m[0].upper() for m in ink)


@lru_cache(1)
def _odt_fixed() -> list:
    """What stands in front of the text, the same in all files: packed once."""
    mime = FORMATS["odt"]
    manifest = f'<?xml version="1.0"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return [_member("mimetype", mime, plain=True), _member("META-INF/manifest.xml", manifest)]


def odt_document(text: str, comments: list[Comment] = (), marks: list[Mark] = ()) -> bytes:
    """An ODT file; each combination of marks in use has a style, comments stand where they begin."""
    ns = 'xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    made = {
        "text": lambda x, ink: f'<text:span text:style-name="{_odt_style(ink)}">{escape(x)}</text:span>' if ink else escape(x),
        "start": lambda i: f'<office:annotation office:name="c{i}"><dc:creator>citegrid</dc:creator>' + "".join(f"<text:p>{escape(x)}</text:p>" for x in _INVALID.sub("", comments[i][2]).split("\n")) + "</office:annotation>",
        "end": lambda i: f'<office:annotation-end office:name="c{i}"/>',
    }
    lines = paragraphs(text, list(comments), marks)
    body = "".join("<text:p>" + "".join(made[kind](*x) for kind, *x in line) + "</text:p>" for line in lines)
    inks = sorted({x[1] for line in lines for kind, *x in line if kind == "text" and x[1]})
    styles = "".join(f'<style:style style:name="{_odt_style(ink)}" style:family="text"><style:text-properties {" ".join(_ODT_MARKS[m] for m in ink)}/></style:style>' for ink in inks)
    return _zip([*_odt_fixed(), _member("content.xml", f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {ns}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>')])


# Widths of the characters from space to tilde in Helvetica, in thousandths of the size.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556,
    556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
PAGE, MARGIN, SIZE, LEADING = (612, 792), 72, 11, 14


def win_ansi(text: str) -> bytes:
    """Text in the encoding of PDF base fonts; other letters lose their accents, or become a question mark."""
    out = bytearray()
    for c in text.replace("\t", "    "):
        for form in (c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() or "?"):
            try:
                out += form.encode("cp1252")
                break
            except UnicodeEncodeError:
                continue
    return bytes(out)


def wrapped(line: bytes, width: float) -> list[bytes]:
    """Lines of at most width points; a word that is wider is cut."""
    wide = lambda b: sum(HELVETICA[c - 32] if 32 <= c < 127 else 556 for c in b) * SIZE / 1000
    out, now, used = [], b"", 0.0
    for word in re.findall(rb"\S+\s*|\s+", line):
        size, bare = wide(word), wide(word.rstrip())
        if now and used + bare > width:
            out.append(now)
            now, used = b"", 0.0
        if bare <= width:
            now, used = now + word, used + size
            continue
        for c in (word[i : i + 1] for i in range(len(word))):
            if now and used + wide(c) > width:
                out.append(now)
                now, used = b"", 0.0
            now, used = now + c, used + wide(c)
    return [x.rstrip() for x in [*out, now]]


def pdf_document(text: str, comments: list[Comment] = (), marks: list[Mark] = ()) -> bytes:
    """A PDF file of wrapped lines in Helvetica, without comments and marks."""
    lines = [x for line in text.split("\n") for x in wrapped(win_ansi(line), PAGE[0] - 2 * MARGIN)]
    room = int((PAGE[1] - 2 * MARGIN) // LEADING)
    pages = [lines[i : i + room] for i in range(0, len(lines), room)]
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        shown = b"".join(b"(%s) Tj T*\n" % re.sub(rb"([\\()])", rb"\\\1", re.sub(rb"[\x00-\x1f]", b"", x)) for x in page)
        stream = b"BT /F1 %d Tf %d TL %d %d Td\n%sET" % (SIZE, LEADING, MARGIN, PAGE[1] - MARGIN - SIZE, shown)
        parts.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (*PAGE, 5 + 2 * i))
        parts.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, part in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, part)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, table, len(parts) + 1, len(out))


_MARKS = "array<struct<mark:string,start:int,end:int>>"
MAKERS = {"html": html_document, "rtf": rtf_document, "docx": docx_document, "odt": odt_document, "pdf": pdf_document}

SMALL = 1 << 14  # texts that repeat are made once in a worker, up to this length


@lru_cache(1024)
def _made_once(kind: str, text: str, comments: tuple[Comment, ...], marks: tuple[Mark, ...]) -> bytes:
    return MAKERS[kind](text, comments, marks)


def made(kind: str, text: str, comments: tuple[Comment, ...], marks: tuple[Mark, ...]) -> bytes:
    small = len(text) + sum(len(c[2]) for c in comments) + 16 * len(marks) <= SMALL
    return _made_once(kind, text, comments, marks) if small else MAKERS[kind](text, comments, marks)


def _spans(told: str | None, names: tuple[str, str, str]) -> tuple[tuple, ...]:
    """A JSON list of objects as tuples, none for a null."""
    return tuple([tuple([x.get(n) for n in names]) for x in json.loads(told)]) if told else ()


def _files(kind: str, texts: pa.Array, notes: pa.Array, marks: pa.Array) -> pa.Array:
    """Files of the rows of a batch; equal rows are made once, and equal lists of spans read once."""
    texts, notes, marks = (x.dictionary_encode("encode") for x in (texts, notes, marks))
    text = texts.dictionary.to_pylist()
    note = [_spans(x, ("s", "e", "b")) for x in notes.dictionary.to_pylist()]
    mark = [_spans(x, ("mark", "start", "end")) for x in marks.dictionary.to_pylist()]
    first: dict[tuple, int] = {}
    at = [first.setdefault(x, len(first)) for x in zip(*(x.indices.to_numpy().tolist() for x in (texts, notes, marks)), strict=True)]
    out = pa.array([None if text[t] is None else made(kind, text[t], note[n], mark[m]) for t, n, m in first], pa.binary())
    return out.take(pa.array(at)) if len(first) < len(at) else out


def exported(docs: DataFrame, kind: str, comments: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, content (binary) in one of FORMATS.

    comments: (doc_id, start, end, body), for COMMENTED formats. A column marks of docs, an array
    of (mark, start, end), shows in HTML, RTF, DOCX and ODT. A null text has null content.
    """
    if kind in ("txt", "md"):
        return docs.select("doc_id", F.col("text").cast("binary").alias("content"))
    ink = F.col("marks").cast(_MARKS) if "marks" in docs.columns else F.lit(None).cast(_MARKS)
    if kind == "html":
        page = rich_page(F.col("text"), ink) if "marks" in docs.columns else html_page(F.col("text"))
        return docs.select("doc_id", page.cast("binary").alias("content"))

    @F.arrow_udf("binary")
    def content(texts: pa.Array, notes: pa.Array, marks: pa.Array) -> pa.Array:
        return _files(kind, texts, notes, marks)

    # marks without a start or an end are left out
    ink = F.filter(ink, lambda m: m["start"].isNotNull() & m["end"].isNotNull())
    docs = docs.select("doc_id", "text", ink.alias("marks"))
    if comments is not None and kind in COMMENTED:
        per = comments.filter("start is not null and end is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), F.coalesce("body", F.lit("")).alias("b")))).alias("_notes"))
        docs = docs.join(per, "doc_id", "left")
    else:
        docs = docs.withColumn("_notes", F.lit(None).cast("array<struct<s:int,e:int,b:string>>"))
    # spans go as JSON: Spark measures a batch after each row, which for a column of arrays goes over the batch anew
    return docs.select("doc_id", content("text", F.to_json("_notes"), F.to_json("marks")).alias("content"))
