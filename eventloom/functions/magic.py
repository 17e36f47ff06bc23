"""File types of byte buffers by their signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Published signatures: first bytes in hexadecimal, MIME type, name.
SIGNATURES = (
    ("89504E470D0A1A0A", "image/png", "PNG image"), ("FFD8FF", "image/jpeg", "JPEG image"), ("474946383761", "image/gif", "GIF image"), ("474946383961", "image/gif", "GIF image"),
    ("255044462D", "application/pdf", "PDF document"), ("504B0304", "application/zip", "Zip archive"), ("1F8B", "application/gzip", "gzip data"), ("425A68", "application/x-bzip2", "bzip2 data"),
    ("FD377A585A00", "application/x-xz", "XZ data"), ("28B52FFD", "application/zstd", "Zstandard data"), ("377ABCAF271C", "application/x-7z-compressed", "7-zip archive"), ("7F454C46", "application/x-executable", "ELF file"),
    ("4D5A", "application/x-dosexec", "DOS executable"), ("CAFEBABE", "application/java-vm", "Java class"), ("50415231", "application/vnd.apache.parquet", "Parquet file"), ("4F524331", "application/x-orc", "ORC file"),
    ("D4C3B2A1", "application/vnd.tcpdump.pcap", "packet capture"), ("A1B2C3D4", "application/vnd.tcpdump.pcap", "packet capture"), ("0A0D0D0A", "application/x-pcapng", "packet capture"), ("4F676753", "audio/ogg", "Ogg data"),
    ("664C6143", "audio/flac", "FLAC audio"), ("494433", "audio/mpeg", "MP3 audio"), ("52494646", "application/x-riff", "RIFF data"), ("53514C69746520666F726D6174203300", "application/vnd.sqlite3", "SQLite database"),
    ("EFBBBF", "text/plain", "UTF-8 text with mark"), ("7B5C727466", "text/rtf", "RTF document"),
)
#: Texts by how they begin, white space apart, in lower case.
TEXTS = (("<!doctype html", "text/html", "HTML document"), ("<html", "text/html", "HTML document"), ("<?xml", "text/xml", "XML document"), ("#!", "text/x-script", "script text"), ("{", "application/json", "JSON data"), ("[", "application/json", "JSON data"))


def file_type(c: Column | str, mime: bool = False) -> Column:
    """The type of a buffer: by signature, then as text, else data."""
    c = F.col(c) if isinstance(c, str) else c
    b = c.cast("binary")
    head, out = F.hex(F.substring(b, 1, 32)), F.lit(None).cast("string")
    text = F.lower(F.ltrim(F.decode(F.substring(b, 1, 256), "ISO-8859-1")))
    out = F.when(b.isNull(), F.lit(None).cast("string")).when(F.octet_length(b) == 0, "application/x-empty" if mime else "empty")
    for magic, kind, name in SIGNATURES:
        out = out.when(head.startswith(magic), kind if mime else name)
    for begin, kind, name in TEXTS:
        out = out.when(text.startswith(begin), kind if mime else name)
    plain = F.length(F.regexp_replace(F.decode(F.substring(b, 1, 4096), "ISO-8859-1"), r"[^\x00-\x08\x0E-\x1F]", "")) == 0
    return out.when(plain, "text/plain" if mime else "text").otherwise("application/octet-stream" if mime else "data")
