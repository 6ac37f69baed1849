"""Staged files: FILE values and their attributes. A FILE is a struct; stages are URL prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import REGISTRY, ColumnOrName, col, function, must

#: Content types by file extension (fixed values).
CONTENT_TYPES = {
    "csv": "text/csv", "txt": "text/plain", "json": "application/json", "xml": "application/xml", "parquet": "application/octet-stream",
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html": "text/html", "md": "text/markdown", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml",
    "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm",
    "gz": "application/gzip", "zip": "application/zip", "bz2": "application/x-bzip2", "zst": "application/zstd",
}
DOCUMENTS = ("application/pdf", "application/msword", "text/plain", "text/html", "text/markdown", CONTENT_TYPES["docx"])
COMPRESSED = ("application/gzip", "application/zip", "application/x-bzip2", "application/zstd")

#: Stage name -> URL.
STAGES: dict[str, str] = {}


def _types() -> Column:
    return F.create_map(*(F.lit(x) for p in CONTENT_TYPES.items() for x in p))


def stage_url(stage: str) -> str:
    name = stage.lstrip("@").rstrip("/")
    return STAGES.get(name, name).rstrip("/")


@function()
def get_stage_location(stage: str) -> Column:
    return F.lit(stage_url(stage) + "/")


@function()
def get_absolute_path(stage: str, path: ColumnOrName) -> Column:
    return F.concat(F.lit(stage_url(stage) + "/"), F.ltrim(col(path), F.lit("/")))


@function()
def get_relative_path(stage: str, path: ColumnOrName) -> Column:
    root = stage_url(stage) + "/"
    return F.when(F.startswith(col(path), F.lit(root)), F.substring(col(path), len(root) + 1, 1 << 30)).otherwise(col(path))


@function("BUILD_STAGE_FILE_URL", "BUILD_SCOPED_FILE_URL", "GET_PRESIGNED_URL")
def build_stage_file_url(stage: str, path: ColumnOrName, *_: object) -> Column:
    """URL of a staged file; a cluster's store signs nothing here, so all forms are plain URLs."""
    return get_absolute_path(stage, path)


@function()
def try_to_file(stage: str, path: ColumnOrName, size: ColumnOrName | None = None, modified: ColumnOrName | None = None) -> Column:
    """A FILE value; null for a path without a file name."""
    p = F.ltrim(col(path), F.lit("/"))
    extension = F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.try_element_at(_types(), extension), F.lit("application/octet-stream"))
    url = get_absolute_path(stage, path)
    value = F.struct(
        F.lit("@" + stage.lstrip("@")).alias("stage"), p.alias("relative_path"), kind.alias("content_type"),
        (F.lit(None) if size is None else col(size)).cast("long").alias("size"), F.md5(url).alias("etag"),
        (F.lit(None) if modified is None else col(modified)).cast("timestamp").alias("last_modified"),
        url.alias("stage_file_url"), url.alias("scoped_file_url"),
    )
    return F.when(F.length(F.element_at(F.split(p, "/"), -1)) > 0, value)


@function()
def to_file(stage: str, path: ColumnOrName, size: ColumnOrName | None = None, modified: ColumnOrName | None = None) -> Column:
    f = try_to_file(stage, path, size, modified)
    return must(col(path).isNull() | f.isNotNull(), f, "TO_FILE: no file name")


for _name in ("content_type", "etag", "last_modified", "relative_path", "scoped_file_url", "size", "stage", "stage_file_url"):

    def _attribute(f: ColumnOrName, _name=_name) -> Column:
        return col(f)[_name]

    globals()[f"fl_get_{_name}"] = REGISTRY[f"FL_GET_{_name.upper()}"] = _attribute


@function()
def fl_get_file_type(f: ColumnOrName) -> Column:
    kind = F.substring_index(col(f)["content_type"], "/", 1)
    return F.when(fl_is_document(f), "document").when(fl_is_compressed(f), "compressed").when(kind.isin("image", "audio", "video"), kind).otherwise("unknown")


@function()
def fl_is_document(f: ColumnOrName) -> Column:
    return col(f)["content_type"].isin(*DOCUMENTS)


@function()
def fl_is_compressed(f: ColumnOrName) -> Column:
    return col(f)["content_type"].isin(*COMPRESSED)


for _name in ("image", "audio", "video"):

    def _media(f: ColumnOrName, _name=_name) -> Column:
        return F.startswith(col(f)["content_type"], F.lit(_name + "/"))

    globals()[f"fl_is_{_name}"] = REGISTRY[f"FL_IS_{_name.upper()}"] = _media

