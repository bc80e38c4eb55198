"""Scalar functions on text, paths and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions by kind, directory names that a scan leaves out.
IMAGE = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "avif", "jxl")
RAW = ("dng", "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "orf", "rw2", "raf", "pef", "srw", "3fr")
VIDEO = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "mts", "m2ts", "3gp", "mpg")
EXCLUDED_PREFIX, EXCLUDED_SUFFIX = ".trash-", ".photoslibrary"


def extension(path: Column) -> Column:
    """Lower-case extension of the last component; empty without one, for names that start with a dot and for ``._`` companions."""
    name = file_name(path)
    ext = F.lower(F.regexp_extract(name, r"^.+\.([A-Za-z0-9]+)$", 1))
    return F.when(name.startswith("._") | name.isNull(), F.lit("")).otherwise(ext)


def media_kind(path: Column) -> Column:
    """``image``, ``raw`` or ``video``; null for other files."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE), "image").when(ext.isin(*RAW), "raw").when(ext.isin(*VIDEO), "video")


def file_name(path: Column) -> Column:
    """Last component that isn't empty; null if there is none."""
    return F.get(F.reverse(F.filter(F.split(path, "/"), lambda x: x != "")), F.lit(0))


def exclusion(name: Column, names: list[str]) -> Column:
    """Why a directory is left out: by name, else by prefix, else by suffix; null if it isn't."""
    low = F.lower(name)
    return F.when(low.isin(*names), "name").when(low.startswith(EXCLUDED_PREFIX), "prefix").when(low.endswith(EXCLUDED_SUFFIX), "suffix")


def normal_extensions(values: Column) -> Column:
    """Options as given: dots and case away, empty ones dropped, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.regexp_replace(x, r"^\.+", ""))), lambda x: x != "")))


def valid_path(path: Column) -> Column:
    """Relative path of 1 to 1024 components, none empty, ``.`` or ``..``, each of 16 KiB at most and 64 KiB in all, without NUL."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda x: x.isin("", ".", "..") | (F.octet_length(x) > 16384))
    return ~bad & (F.size(parts) <= 1024) & (F.octet_length(path) <= 65536) & (F.instr(path, "\x00") == 0)


def valid_windows_path(path: Column) -> Column:
    """``valid_path``, and no component with a reserved device name, a forbidden character, or a dot or space at its end."""
    parts = F.split(path, "/")
    device = r"^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    bad = F.exists(parts, lambda x: x.rlike(device) | x.rlike(r'[<>:"\\|?*\x01-\x1f]') | x.rlike(r"[. ]$"))
    return valid_path(path) & ~bad


def join_path(root: Column, relative: Column) -> Column:
    """Both parts with one slash; either may be empty."""
    return F.concat_ws("/", F.nullif(root, F.lit("")), F.nullif(relative, F.lit("")))


def field_trim(raw: Column) -> Column:
    """Drop NUL, blank, tab and line ends at the end; null if nothing or a NUL inside is left."""
    out = F.regexp_replace(raw, r"[\x00 \t\r\n]+$", "")
    return F.when((out != "") & (F.instr(out, "\x00") == 0), out)


def csv_field(value: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line end; quotes are doubled."""
    return F.when(value.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def base64_unpadded(value: Column) -> Column:
    return F.regexp_replace(F.base64(value.cast("binary")), "[\r\n=]", "")


def from_base64_unpadded(value: Column) -> Column:
    """Bytes of canonical unpadded base64; null for anything else."""
    padded = F.rpad(value, F.length(value) + F.pmod(-F.length(value), F.lit(4)), "=")
    ok = value.rlike("^[A-Za-z0-9+/]*$") & (F.length(value) % 4 != 1)
    bytes_ = F.when(ok, F.unbase64(padded))
    return F.when(base64_unpadded(bytes_) == value, bytes_)


def is_digest(value: Column) -> Column:
    """64 lower-case hexadecimal digits."""
    return value.rlike("^[0-9a-f]{64}$")


def canonical_decimal(value: Column) -> Column:
    """An integer as text, without plus, leading zeros or minus zero."""
    return (value == "0") | value.rlike("^-?[1-9][0-9]*$")


def utf8_truncate(value: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters."""
    out = F.when(F.octet_length(value) <= limit, value)
    for cut in (F.substring(value.cast("binary"), 1, limit - k) for k in range(min(4, limit + 1))):  # a character has four bytes at most
        out = out.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string"))
    return out


def format_bytes(n: Column) -> Column:
    """Base 1024 with B to TiB; one decimal below ten except for bytes."""
    power = F.when(n < 1024, 0).otherwise(F.least(F.lit(4), sum((F.when(n >= 1024**k, 1).otherwise(0) for k in range(1, 5)), F.lit(0))))
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "TiB"))), power.cast("int") + 1)
    value = n / F.element_at(F.array(*(F.lit(1024**k) for k in range(5))), power.cast("int") + 1)
    digits = F.when((value >= 10) | (power == 0), F.format_string("%d", F.floor(value + 0.5))).otherwise(F.format_string("%d.%d", F.floor(F.floor(value * 10 + 0.5) / 10), F.floor(value * 10 + 0.5) % 10))
    return F.concat(digits, F.lit(" "), unit)


def path_key(profile: Column, encoding: Column, raw: Column) -> Column:
    """Digest of a path's bytes with its profile and encoding, lengths first."""
    return F.sha2(F.concat(F.lit("path-key-1|"), profile, F.lit("|"), encoding, F.lit("|"), F.octet_length(raw).cast("string"), F.lit("|"), raw), 256)


def container_format(content: Column) -> Column:
    """Format by the first bytes: ``jpeg``, ``tiff``, ``iso-bmff`` or ``unknown``."""
    head = F.hex(F.substring(content, 1, 12))
    box = F.substring(head, 9, 8)
    boxes = tuple(x.encode().hex().upper() for x in ("ftyp", "moov", "wide", "free"))
    return F.when(head.startswith("FFD8"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(box.isin(*boxes), "iso-bmff").otherwise("unknown")
