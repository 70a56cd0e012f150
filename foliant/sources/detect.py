"""Format detection by magic bytes, archive members, extension; capabilities; image filters."""

from __future__ import annotations

import re
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.zips import Members

#: (format, extension, media type, has pages, can be rendered). All formats have tables. Fixed values.
FORMATS = [
    ("PDF", "pdf", "application/pdf", True, True),
    ("DOCX", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", False, False),
    ("XLSX", "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", True, False),
    ("PPTX", "pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", True, False),
    ("DOC", "doc", "application/msword", False, False),
    ("XLS", "xls", "application/vnd.ms-excel", True, False),
    ("PPT", "ppt", "application/vnd.ms-powerpoint", True, False),
    ("ODT", "odt", "application/vnd.oasis.opendocument.text", False, False),
    ("ODS", "ods", "application/vnd.oasis.opendocument.spreadsheet", True, False),
    ("ODP", "odp", "application/vnd.oasis.opendocument.presentation", True, False),
    ("RTF", "rtf", "application/rtf", False, False),
    ("MD", "md", "text/markdown", False, False),
]

#: Image filters by leading bytes (hex), in the order of tests; the least length is that of the test group. Fixed values.
IMAGE_MAGIC = [
    ("png", "89504E470D0A1A0A", 8),
    ("gif", "474946383761", 8),
    ("gif", "474946383961", 8),
    ("jpeg2000", "0000000C6A502020", 8),
    ("jbig2", "974A42320D0A1A0A", 8),
    ("jpeg", "FFD8FF", 4),
    ("jpeg2000", "FF4FFF51", 4),
    ("tiff", "49492A00", 4),
    ("tiff", "4D4D002A", 4),
    ("wmf", "D7CDC69A", 4),
    ("bmp", "424D", 2),
]


def formats(spark: SparkSession) -> DataFrame:
    """The twelve formats as a dimension table; it has a fixed size and may be broadcast."""
    return spark.createDataFrame(FORMATS, "format string, extension string, mime string, has_pages boolean, can_render boolean").withColumn("has_tables", F.lit(True))


def magic(content: Column) -> Column:
    """RTF at the start, PDF within 1,024 bytes, then the two container kinds; else null. Native."""
    head = F.hex(F.substring(content, 1, 8))
    pdf = F.locate("%PDF", F.decode(F.substring(content, 1, 1024), "ISO-8859-1")) > 0
    return F.when(F.startswith(head, F.lit("7B5C727466")), "RTF").when(pdf, "PDF").when(F.startswith(head, F.lit("504B0304")), "ZIP").when(F.startswith(head, F.lit("D0CF11E0")), "CFB")


def zip_member_format(data: bytes) -> str | None:
    """The document format of a ZIP archive, from its mimetype member or its content types."""
    try:
        z = Members(data)
        if "mimetype" in z.sizes:
            kind = z.read("mimetype")[:200].decode("ascii", "replace").strip()
            for name, _, mime, _, _ in FORMATS:
                if kind == mime and name.startswith("OD"):
                    return name
        if "[Content_Types].xml" in z.sizes:
            types = z.read("[Content_Types].xml")[: 1 << 20].decode("utf-8", "replace")
            for key, name in (("wordprocessingml", "DOCX"), ("spreadsheetml", "XLSX"), ("presentationml", "PPTX")):
                if f"{key}." in types:
                    return name
    except (zipfile.BadZipFile, OSError, KeyError, NotImplementedError, RuntimeError):
        return None
    return None


def cfb_names(data: bytes) -> list[str]:
    """Names in the directory of a compound file."""
    from foliant.sources.cfb import CompoundFile

    try:
        return list(CompoundFile(data).entries)
    except (ValueError, struct.error, IndexError):
        return []


def cfb_member_format(data: bytes) -> str | None:
    names = cfb_names(data)
    for name, fmt in (("WordDocument", "DOC"), ("Workbook", "XLS"), ("Book", "XLS"), ("PowerPoint Document", "PPT")):
        if name in names:
            return fmt
    return None


def _member(kind: pd.Series, content: pd.Series) -> pd.Series:
    tests = {"ZIP": zip_member_format, "CFB": cfb_member_format}
    return pd.Series([tests[k](bytes(c)) if k in tests and c is not None else k for k, c in zip(kind, content, strict=True)], dtype=object)


def from_bytes(content: Column) -> Column:
    """The format of document bytes, or null. Only containers are opened in Python."""
    kind = magic(content)
    member = F.pandas_udf(_member, "string")
    return F.when(kind.isin("ZIP", "CFB"), member(kind, content)).otherwise(kind)


def from_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(ext == "markdown", "MD")
    for name, known, _, _, _ in FORMATS:
        out = out.when(ext == known, name)
    return out


def detect(path: Column, content: Column) -> Column:
    """Bytes first, then the extension."""
    return F.coalesce(from_bytes(content), from_extension(path))


_EXTENSIONS = {ext: name for name, ext, _, _, _ in FORMATS} | {"markdown": "MD"}


def format_of(path: str | None, data: bytes | None) -> str | None:
    """As ``detect``, for one file in Python: the scan needs no second pass of the bytes through a worker."""
    found = None
    if data is not None:
        if data.startswith(b"{\\rtf"):
            found = "RTF"
        elif b"%PDF" in data[:1024]:
            found = "PDF"
        elif data.startswith(b"PK\x03\x04"):
            found = zip_member_format(data)
        elif data.startswith(b"\xd0\xcf\x11\xe0"):
            found = cfb_member_format(data)
    if found is None and path is not None and (m := re.search(r"\.([^./]+)\Z", path)):
        found = _EXTENSIONS.get(m[1].lower())
    return found


def detect_strict(path: Column, content: Column) -> Column:
    """As ``detect``, with an error where nothing matches."""
    return F.coalesce(detect(path, content), F.raise_error(F.concat(F.lit("unable to detect format: "), path)))


def image_filter(content: Column) -> Column:
    """The filter of image bytes by their first bytes; 'raw' if none is known."""
    head, n = F.hex(F.substring(content, 1, 8)), F.octet_length(content)
    out = None
    for name, lead, least in IMAGE_MAGIC[:-2]:
        test = (n >= least) & F.startswith(head, F.lit(lead))
        out = F.when(test, name) if out is None else out.when(test, name)
    emf = (n >= 44) & F.startswith(head, F.lit("01000000")) & (F.hex(F.substring(content, 41, 4)) == "20454D46")
    out = out.when(emf, "emf")
    for name, lead, least in IMAGE_MAGIC[-2:]:
        out = out.when((n >= least) & F.startswith(head, F.lit(lead)), name)
    return out.otherwise("raw")


def image_size(content: Column) -> Column:
    """(width, height) of PNG bytes; (0, 0) for others. JPEG needs a scan of markers: see ``foliant.sources.images``."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    png = (F.octet_length(content) >= 24) & F.startswith(F.hex(F.substring(content, 1, 8)), F.lit("89504E470D0A1A0A"))
    return F.when(png, F.struct(number(17).alias("width"), number(21).alias("height"))).otherwise(F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")))


def scan_files(spark: SparkSession, path: str | list[str], most_bytes: int | None = None, hidden: bool = False) -> DataFrame:
    """Files of a folder tree as rows (path, length, content), in path order by ``ord``.

    The size limit is pushed to the file source, which then does not read the content of
    larger files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    if not hidden:
        files = files.where(~F.col("path").rlike(r"/\.[^/]*$"))
    return files.select("path", "length", "content")
