"""Row predicates over catalog columns.

Every function returns a boolean ``Column``, so predicates combine with ``&``, ``|`` and ``~``,
merge into one ``Filter`` and, where Parquet can test them, reach the scan. ``now`` defaults to
the query's start time; pass a timestamp to make a run repeatable.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.naming import base_name, dotted, extension_of

# Extension lists of the file-type predicates.
TEXT_EXTENSIONS = [".txt", ".md", ".log", ".csv", ".json", ".xml", ".yaml", ".yml"]
CODE_EXTENSIONS = [
    ".go", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".hpp", ".rs", ".rb", ".php",
    ".swift", ".kt", ".scala", ".sh", ".bash",
]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".ico"]
VIDEO_EXTENSIONS = [".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v"]
AUDIO_EXTENSIONS = [".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a", ".wma"]
DOCUMENT_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods"]
ARCHIVE_EXTENSIONS = [".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz", ".tgz"]

# Directories left out of listings, names and suffixes left out of change logs.
SKIPPED_DIRECTORIES = [".git", "node_modules", ".svn", ".hg", "__pycache__", ".vscode", ".idea"]
IGNORED_EXTENSIONS = [".tmp", ".swp", ".bak"]
IGNORED_NAMES = ["Thumbs.db", "desktop.ini", ".DS_Store"]

# Fixed value: what counts as large when no threshold is given.
LARGE_FILE_BYTES = 100 * 1024 * 1024


def _is_file() -> Column:
    return ~F.col("is_dir")


def _now(now) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def size_between(minimum: int = 0, maximum: int = 0) -> Column:
    """Files whose size lies in the closed range; a bound of 0 or less is no bound."""
    parts = [_is_file()]
    if minimum > 0:
        parts.append(F.col("size") >= minimum)
    if maximum > 0:
        parts.append(F.col("size") <= maximum)
    return reduce(and_, parts)


def min_size(size: int) -> Column:
    return size_between(size, 0)


def max_size(size: int) -> Column:
    return size_between(0, size)


def non_empty() -> Column:
    return _is_file() & (F.col("size") > 0)


def large(threshold: int = 0) -> Column:
    return min_size(threshold or LARGE_FILE_BYTES)


def modified_after(when) -> Column:
    return F.col("modified_time") > when


def modified_before(when) -> Column:
    return F.col("modified_time") < when


def modified_between(start, end) -> Column:
    return F.col("modified_time").between(start, end)


def modified_within_days(days: int, now=None) -> Column:
    """Later than ``days`` calendar days before ``now``."""
    return F.col("modified_time") > _now(now) - F.make_interval(days=F.lit(days))


def modified_within_hours(hours: int, now=None) -> Column:
    return F.col("modified_time") > _now(now) - F.make_dt_interval(hours=F.lit(hours))


def older_than_days(days: int, now=None) -> Column:
    return F.col("modified_time") < _now(now) - F.make_interval(days=F.lit(days))


def modified_today(now=None) -> Column:
    """Later than the midnight that starts ``now``'s day; midnight itself is not included."""
    return F.col("modified_time") > F.date_trunc("day", _now(now))


def has_any_extension(*extensions: str) -> Column:
    """Files with one of the extensions (dot optional, case kept); ``''`` means none at all."""
    if not extensions:
        return F.lit(False)
    return _is_file() & F.col("extension").isin([dotted(e) for e in extensions])


def no_extension() -> Column:
    return _is_file() & (F.col("extension") == "")


def has_extension() -> Column:
    return _is_file() & (F.col("extension") != "")


def text_files() -> Column:
    return has_any_extension(*TEXT_EXTENSIONS)


def code_files() -> Column:
    return has_any_extension(*CODE_EXTENSIONS)


def image_files() -> Column:
    return has_any_extension(*IMAGE_EXTENSIONS)


def video_files() -> Column:
    return has_any_extension(*VIDEO_EXTENSIONS)


def audio_files() -> Column:
    return has_any_extension(*AUDIO_EXTENSIONS)


def document_files() -> Column:
    return has_any_extension(*DOCUMENT_EXTENSIONS)


def archive_files() -> Column:
    return has_any_extension(*ARCHIVE_EXTENSIONS)


def directories() -> Column:
    return F.col("is_dir")


def files_only() -> Column:
    return _is_file()


def hidden() -> Column:
    return F.col("name").startswith(".")


def visible() -> Column:
    return (F.col("name") != "") & ~F.col("name").startswith(".")


def recent_large(minimum: int, days: int, now=None) -> Column:
    return min_size(minimum) & modified_within_days(days, now)


def old_large(minimum: int, days: int, now=None) -> Column:
    return min_size(minimum) & older_than_days(days, now)


def all_of(*predicates: Column) -> Column:
    return reduce(and_, predicates) if predicates else F.lit(True)


def any_of(*predicates: Column) -> Column:
    """OR of the predicates; with none given every row passes."""
    return reduce(or_, predicates) if predicates else F.lit(True)


def not_(predicate: Column) -> Column:
    return ~predicate


def apply_filters(df: DataFrame, *predicates: Column) -> DataFrame:
    return df.filter(all_of(*predicates)) if predicates else df


def matches_extension(extension: str) -> Column:
    """``''`` passes every row; directories are not excluded."""
    return F.lit(True) if extension == "" else F.col("extension") == dotted(extension)


def should_ignore(path: Column | None = None) -> Column:
    """Hidden, temporary and system files, by the last component of the path."""
    name = base_name(F.col("path") if path is None else path)
    return (
        name.startswith(".")
        | extension_of(name).isin(IGNORED_EXTENSIONS)
        | name.endswith("~")
        | name.isin(IGNORED_NAMES)
    )


def in_skipped_dir(
    path: Column | None = None,
    is_dir: Column | None = None,
    root: str = "/",
    skip: list[str] | None = None,
) -> Column:
    """Rows that a pruned listing of ``root`` would not have produced.

    That is a path with a skipped directory above it and below the root, or such a directory
    itself.
    """
    path = F.col("path") if path is None else path
    is_dir = F.col("is_dir") if is_dir is None else is_dir
    skipped = F.array(*[F.lit(s) for s in (SKIPPED_DIRECTORIES if skip is None else skip)])
    prefix = root.rstrip("/") + "/"
    below = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise("")
    parts = F.split(below, "/")
    parents = F.slice(parts, F.lit(1), F.array_size(parts) - 1)
    return F.arrays_overlap(parents, skipped) | (
        is_dir & F.array_contains(skipped, F.element_at(parts, -1))
    )
