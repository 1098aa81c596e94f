"""Documents from files: what a file is, and its text. Readers run on the executors over binary content."""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import stored

MAX_BYTES = 100 << 20
LEAST_PAGE_CHARS = 100
SMALL, MOST_KNOWN, BATCH_CHARS = 1 << 14, 1024, 4 << 20
PdfPages = Callable[[bytes], list[str]]
PageReader = Callable[[bytes, int], str]
SCHEMA = "path string, format string, text string, error string, warning string"
# Tags and groups without text of their own; tags that end a line.
SILENT_TAGS = frozenset("script style head title noscript template".split())
BLOCK_TAGS = frozenset("p div section article header footer li ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6".split())
SILENT_GROUPS = frozenset("fonttbl colortbl stylesheet listtable listoverridetable revtbl rsidtbl generator info pict object themedata colorschememapping latentstyles datastore xmlnstbl filetbl fchars lchars".split())
RTF_WORDS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "emdash": "—", "endash": "–", "emspace": "\u2003", "enspace": "\u2002", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "nbsp": "\u00a0"}
RTF_SYMBOLS = {"~": "\u00a0", "_": "\u2011", "-": "", "\n": "\n", "\\": "\\", "{": "{", "}": "}"}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([a-zA-Z]+));")


def _decoded(m: re.Match) -> str:
    hexadecimal, decimal, name = m.groups()
    if name:
        return ENTITIES.get(name.lower(), m[0])
    code = int(hexadecimal, 16) if hexadecimal else int(decimal)
    if 0xD800 <= code <= 0xDFFF:  # half of a pair is no character
        return "\ufffd"
    return chr(code) if code <= 0x10FFFF else m[0]


def decode_entities(text: str) -> str:
    """The entities of XML, the hard blank and numbers; any other stays as it is written."""
    return _ENTITY.sub(_decoded, text) if "&" in text else text


_RETURNS, _TRAILING, _GAPS = re.compile(r"\r\n?"), re.compile(r"[ \t]+\n"), re.compile(r"\n{3,}")


def tidied(text: str) -> str:
    if "\r" in text:
        text = _RETURNS.sub("\n", text)
    return (_GAPS.sub("\n\n", _TRAILING.sub("\n", text)) if "\n" in text else text).strip()


_AMPERSAND = "\ufdd0"  # a code point that stands for no character


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT_TAGS:
            self.depth += 1
        elif tag == "br":
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in SILENT_TAGS:
            self.depth = max(0, self.depth - 1)
        elif tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(re.sub(r"\s+", " ", decode_entities(data.replace(_AMPERSAND, "&"))))


def html_text(source: str) -> str:
    p = _Html()
    p.feed(source.replace("&", _AMPERSAND))  # entities are for decode_entities alone
    p.close()
    return tidied(re.sub(r" ?\n ?", "\n", "".join(p.out)))


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}]+)", re.S)


def rtf_text(source: str) -> str:
    """RTF by a stack of groups: each keeps whether it is silent and how many characters stand in for a \\u."""
    out, stack, silent, width, skip, fresh = [], [], False, 1, 0, False
    for m in _RTF.finditer(source):
        code, word, number, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((silent, width))
            fresh = True
            continue
        if brace == "}":
            silent, width = stack.pop() if stack else (False, 1)
            skip = 0
        elif word:
            if fresh and word in SILENT_GROUPS:
                silent = True
            elif word == "uc" and number:
                width = int(number)
            elif word == "u" and number:
                if not silent:
                    out.append(chr(int(number) % 65536))
                skip = width
            elif word in RTF_WORDS and not silent:
                out.append(RTF_WORDS[word])
        elif code:
            if skip:
                skip -= 1
            elif not silent:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif symbol:
            if symbol == "*":
                silent = True
            elif not silent:
                out.append(RTF_SYMBOLS.get(symbol, ""))
        elif plain:
            plain = plain.replace("\r", "").replace("\n", "")
            cut = min(skip, len(plain))
            skip -= cut
            if not silent:
                out.append(plain[cut:])
        fresh = fresh and bool(symbol == "*")
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return tidied(text)


_TAG = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(.*?)\]\]>|<(/?)([\w:.-]+)((?:[^'\">/]+|\"[^\"]*\"|'[^']*'|/(?!>))*+)(/?)>|([^<]+)", re.S)


class TooLarge(Exception):
    """A part of an archive that inflates beyond MAX_BYTES."""


_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")


class _Plain:
    """An archive of the plainest make, read without zipfile, which takes several times as long for a small one.

    Whatever is not as simple archivers leave it (flags, comments, names beyond ASCII, parts out of order, sizes or sums that
    are not as told) is Unplain, and for zipfile to read or to refuse.
    """

    class Unplain(Exception):
        pass

    def __init__(self, data: bytes):
        self.data, self.parts = data, {}
        if len(data) < _END.size or data[-_END.size - 20 : -_END.size - 16] == b"PK\6\7":
            raise self.Unplain
        sign, disk, first, here, count, size, at, comment = _END.unpack_from(data, len(data) - _END.size)
        end = len(data) - _END.size
        if sign != b"PK\5\6" or disk or first or comment or here != count or at + size != end:
            raise self.Unplain
        past, last = at, None
        for _ in range(count):
            if at + _CENTRAL.size > end:
                raise self.Unplain
            sign, _, needs, flags, method, _, _, crc, packed, whole, n, extra, note, disk, _, _, place = _CENTRAL.unpack_from(data, at)
            name = data[at + _CENTRAL.size : at + _CENTRAL.size + n]
            at += _CENTRAL.size + n
            if sign != b"PK\1\2" or needs > 45 or flags or method not in (0, 8) or extra or note or disk or len(name) != n or not name.isascii() or b"\0" in name:
                raise self.Unplain
            if last is not None:
                if place < self.parts[last][0]:
                    raise self.Unplain
                self.parts[last][-1] = place
            last = name.decode()
            if last in self.parts:
                raise self.Unplain
            self.parts[last] = [place, name, method, crc, packed, whole, past]
        if at != end:
            raise self.Unplain

    def namelist(self) -> list[str]:
        return list(self.parts)

    def read(self, name: str) -> bytes:
        if name not in self.parts:
            raise self.Unplain
        place, raw, method, crc, packed, whole, past = self.parts[name]
        if place + _LOCAL.size > len(self.data) or whole > MAX_BYTES:
            raise self.Unplain
        sign, _, flags, same, _, _, _, _, _, n, extra = _LOCAL.unpack_from(self.data, place)
        start = place + _LOCAL.size + n + extra
        if sign != b"PK\3\4" or flags or same != method or self.data[place + _LOCAL.size : place + _LOCAL.size + n] != raw or start + packed > past:
            raise self.Unplain
        content = self.data[start : start + packed]
        if method:
            unpacking = zlib.decompressobj(-zlib.MAX_WBITS)
            try:
                content = unpacking.decompress(content, whole + 1)
            except zlib.error as e:
                raise self.Unplain from e
            if not unpacking.eof or unpacking.unused_data:
                raise self.Unplain
        if len(content) != whole or zlib.crc32(content) != crc:
            raise self.Unplain
        return content


def _archive(data: bytes | zipfile.ZipFile) -> zipfile.ZipFile:
    return data if isinstance(data, zipfile.ZipFile) else zipfile.ZipFile(io.BytesIO(data))


def _part(data: bytes | zipfile.ZipFile | _Plain, name: str) -> str:
    if isinstance(data, _Plain):
        try:
            return data.read(name).decode("utf-8", "replace")
        except _Plain.Unplain:
            data = data.data
    with _archive(data) as z, z.open(name) as part:
        content = part.read(MAX_BYTES + 1)  # what the archive says of sizes need not be true
    if len(content) > MAX_BYTES:
        raise TooLarge(f"{name} has more than {MAX_BYTES} bytes")
    return content.decode("utf-8", "replace")


def _opened(data: bytes) -> zipfile.ZipFile | _Plain:
    try:
        return _Plain(data)
    except _Plain.Unplain:
        return _archive(data)


def docx_text(data: bytes | zipfile.ZipFile) -> str:
    out, reading = [], False
    for cdata, close, tag, _, single, plain in _TAG.findall(_part(data, "word/document.xml")):
        if not tag:
            if reading:
                out.append(cdata or decode_entities(plain))
            continue
        name = tag.rpartition(":")[2]
        if name == "t" and not single:
            reading = not close
        elif name == "tab" and not close:
            out.append("\t")
        elif name in ("br", "cr") and not close:
            out.append("\n")
        elif name == "p" and (close or single):
            out.append("\n")
    return tidied("".join(out))


ODT_SILENT = frozenset("annotation tracked-changes note-citation sequence-decls automatic-styles styles font-face-decls meta settings scripts".split())


def odt_text(data: bytes | zipfile.ZipFile) -> str:
    out, depth = [], 0
    for cdata, close, tag, attrs, single, plain in _TAG.findall(_part(data, "content.xml")):
        if not tag:
            if not depth:
                out.append(cdata or decode_entities(plain))
            continue
        name = tag.rpartition(":")[2]
        if name in ODT_SILENT:
            depth += 0 if single else -1 if close else 1
        elif depth:
            continue
        elif name == "s" and not close:
            m = re.search(r'c="(\d+)"', attrs)
            out.append(" " * int(m[1] if m else 1))
        elif name == "tab" and not close:
            out.append("\t")
        elif name == "line-break" and not close:
            out.append("\n")
        elif name in ("p", "h") and (close or single):
            out.append("\n")
    return tidied("".join(out))


def looks_like_text(data: bytes) -> bool:
    head = data[:4096]
    return 0 not in head and sum(b < 32 and b not in (9, 10, 12, 13) for b in head) < max(1, len(head)) * 0.01


_SECTION_RUN = re.compile(r"((?:U\.\s*S\.\s*C\.|C\.F\.R\.)\s*)(?=[§8 ]{1,8}\d)(?=[8 ]*§)[8 ]*(§)[8 ]*(§?)[8 ]*(?=\d)")


def pdf_text(data: bytes, extract: PdfPages, ocr: PageReader | None = None, mode: str = "auto") -> tuple[str, str | None]:
    """(pages joined by blank lines, a warning about pages without text).

    A page with under LEAST_PAGE_CHARS characters goes to ocr, if there is one, unless mode is
    never; all do if it is always. Section signs that ocr takes for eights are repaired, in what it read alone.
    """
    pages, empty = [], []
    for i, page in enumerate(extract(data)):
        scan = ocr is not None and (mode == "always" or (mode == "auto" and len(page.strip()) < LEAST_PAGE_CHARS))
        pages.append(_SECTION_RUN.sub(r"\1\2\3 ", ocr(data, i)) if scan else page)
        if not pages[-1].strip():
            empty.append(str(i + 1))
    return tidied("\n\n".join(pages)), f"no text on page {', '.join(empty)}" if empty else None


def import_document(path: str, data: bytes, pdf: PdfPages | None = None, ocr: PageReader | None = None, mode: str = "auto") -> tuple[str, str | None, str | None, str | None]:
    """(format, text, error, warning) of a file. pdf gives the page texts of a PDF file, ocr that of one scanned page."""
    if data[:5] == b"%PDF-" and pdf is not None and len(data) <= MAX_BYTES:
        text, warning = pdf_text(data, pdf, ocr, mode)
        return "pdf", text, None, warning
    return (*_read(path, data), None)


def _read(path: str, data: bytes) -> tuple[str, str | None, str | None]:
    """(format, text, error): content decides before the name does."""
    if not data:
        return "none", None, "the file is empty"
    if len(data) > MAX_BYTES:
        return "none", None, f"the file has more than {MAX_BYTES} bytes"
    if data[:5] == b"%PDF-":
        return "pdf", None, "PDF needs an extractor; none is part of this package"
    if data[:4] == b"\xd0\xcf\x11\xe0":
        return "doc", None, "the older Word format is not supported; save as DOCX"
    if data[:2] == b"PK":
        try:
            archive = _opened(data)
            names = archive.namelist()
            if "word/document.xml" in names:
                return "docx", docx_text(archive), None
            if "content.xml" in names:
                return "odt", odt_text(archive), None
            return "zip", None, "the archive holds neither word/document.xml nor content.xml"
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, TooLarge) as e:
            return "zip", None, f"the archive cannot be read: {e}"
    if not looks_like_text(data):
        return "binary", None, "the file is not text"
    text = data.decode("utf-8-sig", "replace")
    if text.lstrip().startswith("{\\rtf"):
        return "rtf", rtf_text(text), None
    if re.search(r"<!doctype html|<html[\s>]", text[:1024], re.I) or path.lower().endswith((".html", ".htm")):
        return "html", html_text(text), None
    return "text", re.sub(r"\r\n?", "\n", text), None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


class Once:
    """read(path, data), small files that repeat read once. Of the path only the ending matters."""

    def __init__(self, read: Callable[[str, bytes], tuple]):
        self.read, self.known = read, {}

    def __call__(self, path: str, data: bytes) -> tuple:
        if len(data) > SMALL or data[:5] == b"%PDF-":
            return self.read(path, data)
        key = ((path or "").lower().endswith((".html", ".htm")), data)
        out = self.known.get(key)
        if out is None:
            out = self.read(path, data)
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            if len(out[1] or "") <= SMALL:  # a small archive may hold a long text
                self.known[key] = out
        return out


def told(path: str, data: bytes, pdf: PdfPages | None, ocr: PageReader | None, mode: str) -> tuple:
    """import_document(), where a reader that fails tells its error."""
    try:
        out = import_document(path, data, pdf, ocr, mode)
        for x in out:
            if x is not None:
                x.encode()  # a text that is none
        return out
    except Exception as e:  # noqa: BLE001 - one damaged file must not end the job
        return "none", None, f"the file cannot be read: {type(e).__name__}: {ascii(str(e))}", None


def _reading(pdf: PdfPages | None, ocr: PageReader | None, mode: str):
    """What a task does with batches of (path, content): rows of SCHEMA, in batches of some size."""

    def run(batches):
        read = Once(lambda path, data: told(path, data, pdf, ocr, mode))
        for batch in batches:
            rows, size = [], 0
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((path, *read(path, data or b"")))
                size += len(rows[-1][2] or "") + 256
                if size > BATCH_CHARS:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    return run


def imported(files: DataFrame, pdf: PdfPages | None = None, ocr: PageReader | None = None, mode: str = "auto") -> DataFrame:
    """(path, content) -> path, format, text, error, warning: one row per file, refused ones with a reason; a reader that fails tells its error."""
    return files.select("path", "content").mapInArrow(_reading(pdf, ocr, mode), SCHEMA)


def read_documents(spark: SparkSession, folder: str, pdf: PdfPages | None = None, ocr: PageReader | None = None, mode: str = "auto") -> DataFrame:
    return imported(spark.read.format("binaryFile").load(folder), pdf, ocr, mode)


def distinct_contents(files: DataFrame) -> DataFrame:
    """(path, content) -> digest, path (the first), paths: files of equal content need reading once. Contents are not shuffled."""
    keyed = files.select("path", F.sha2("content", 256).alias("digest"))
    return keyed.groupBy("digest").agg(F.min("path").alias("path"), F.array_sort(F.collect_list("path")).alias("paths"))


KEPT = "digest string, named string, settings string, format string, text string, error string, warning string"
READ_AS = "1"  # to be raised when a reader gives another text for the same file


def imported_once(files: DataFrame, store: str, pdf: PdfPages | None = None, ocr: PageReader | None = None, mode: str = "auto", settings: str = "", run: str | None = None) -> DataFrame:
    """(path, content) -> path, digest, format, text, error, warning, as imported() gives them, each different content read once, over all runs.

    The store is a folder that is keyed by the content's digest, by what the path says of the
    format (named: only "html" matters) and by the settings: READ_AS, mode, the names of pdf and
    ocr, and what the caller adds of its own (a version of an extractor). What it has is not read
    again; what is new is written as the part `run`, which a repeated run replaces. Of files with
    equal content that with the smallest path is read; texts then go to all their paths. Files that cannot be read
    are kept with their reason, too. Null contents are empty files; rows that repeat a path and content
    count as they stand (and are read each, where theirs is the path that is read).
    """
    spark = files.sparkSession
    names = [getattr(f, "__qualname__", type(f).__name__) if f else "" for f in (pdf, ocr)]
    how = "|".join([READ_AS, mode, *names, settings])
    html = F.when(F.lower("path").rlike(r"\.html?$"), "html").otherwise("")
    content = F.coalesce("content", F.lit(b""))
    known = stored(files.select("path", F.sha2(content, 256).alias("digest"), html.alias("named")))
    kept = stored(_kept_texts(spark, store).filter(F.col("settings") == how).join(known.select("digest", "named").distinct(), ["digest", "named"], "left_semi"))
    first = known.groupBy("digest", "named").agg(F.min("path").alias("_path")).join(kept, ["digest", "named"], "left_anti")
    # contents move only where the paths to be read are too many for a broadcast
    chosen = files.select("path", "content", F.sha2(content, 256).alias("_digest")).join(first.select("_path", F.col("digest").alias("_first")), (F.col("path") == F.col("_path")) & (F.col("_digest") == F.col("_first")), "left_semi")
    read = imported(chosen.select("path", "content"), pdf, ocr, mode).groupBy("path").agg(F.first(F.struct("format", "text", "error", "warning")).alias("x"))
    fresh = stored(first.join(read, first["_path"] == read["path"]).select("digest", "named", F.lit(how).alias("settings"), "x.*"))
    if fresh.limit(1).count():
        fresh.write.mode("overwrite").parquet(f"{store.rstrip('/')}/run={run or uuid.uuid4().hex}")
    texts = kept.unionByName(fresh).drop("settings")
    return known.join(texts, ["digest", "named"]).select("path", "digest", "format", "text", "error", "warning")


def _kept_texts(spark: SparkSession, store: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], KEPT)
    rows = spark.read.schema(f"{KEPT}, run string").option("basePath", store).parquet(store)
    return rows.groupBy("digest", "named", "settings").agg(F.first(F.struct("format", "text", "error", "warning")).alias("x")).select("digest", "named", "settings", "x.*")


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> page_id, text."""

    @F.pandas_udf("string")
    def text(x):
        return x.map(lambda v: None if v is None else html_text(v))

    return pages.select("page_id", text("html").alias("text"))
