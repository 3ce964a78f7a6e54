"""File names, paths and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by category.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif", ".bmp", ".tiff", ".tif", ".dng", ".raw", ".cr2", ".nef", ".arw"]
VIDEO_EXTENSIONS = [".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".3gp", ".mts", ".wmv", ".mpg"]
AUDIO_EXTENSIONS = [".mp3", ".m4a", ".wav", ".aac", ".flac", ".ogg", ".opus", ".wma", ".amr"]
SCANNED_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif", ".bmp", ".tiff", ".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".3gp"]
# Names that look like a copy, a screen picture, a messenger download; cloud-native documents.
COPY_NAME = r"(?i)(copy|copie|duplicate|\(\d+\)| \d+\.\w+$)"
COPY_MARK = r"(?i)(copy|copie|duplicate|\(\d+\))"
SCREEN_NAME = r"(?i)(screen\s?shot|screencap|screen_recording)"
MESSENGER_NAME = r"(?i)(whatsapp|wa\d{4}|telegram|IMG-\d{8}-WA)"
NATIVE_PREFIX = "application/vnd.google-apps"
FOLDER_MIME = "application/vnd.google-apps.folder"
FOLDER_ID = r"^[A-Za-z0-9_-]{20,}$"


def kind_of(mime: Column) -> Column:
    """video for video types, photo for everything else, a null type included."""
    return F.when(mime.startswith("video/"), "video").otherwise("photo")


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty where there is none or the name only begins with a dot."""
    return F.lower(F.regexp_extract(name, r"^.*[^/](\.[^./]+)$", 1))


def category_of(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(IMAGE_EXTENSIONS), "photos").when(ext.isin(VIDEO_EXTENSIONS), "videos").when(ext.isin(AUDIO_EXTENSIONS), "audio").otherwise("other")


def top_folder(path: Column) -> Column:
    """First segment of a path; a file at the root counts as its own folder; null where it is empty."""
    return F.nullif(F.element_at(F.split(path, "/"), 1), F.lit(""))


def safe_name(name: Column) -> Column:
    """Slashes replaced by the fraction slash, outer blanks gone, never empty."""
    return F.coalesce(F.nullif(F.trim(F.replace(name, F.lit("/"), F.lit("⁄"))), F.lit("")), F.lit("_"))


def in_folder(path: Column, folder: str) -> Column:
    """Below a folder, letter case ignored, % and _ in the folder's name are wildcards."""
    return path.ilike(folder.rstrip("/") + "/%")


def contains_text(column: Column, text: str) -> Column:
    """Substring test, letter case ignored, % and _ are wildcards."""
    return column.ilike(f"%{text}%")


def looks_copied(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(COPY_NAME)


def year_in_name(name: Column, latest: int) -> Column:
    """Year of the first plausible date in a file name (1900..latest, month 1..12, day 1..31), else null."""
    pattern = F.lit(r"(?<!\d)((?:19|20)\d{2})[-_.]?(\d{2})[-_.]?(\d{2})(?!\d)")
    parts = F.arrays_zip(*[F.regexp_extract_all(name, pattern, F.lit(i)).alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"))])
    sane = F.filter(parts, lambda p: p["y"].cast("int").between(1900, latest) & p["m"].cast("int").between(1, 12) & p["d"].cast("int").between(1, 31))
    return F.try_element_at(sane, F.lit(1))["y"].cast("int")


def resolved_year(sidecar: Column, embedded: Column, video: Column, name: Column, modified: Column) -> Column:
    """struct(year, source): the first known of sidecar, embedded data, file name, modification time.

    The embedded year of a video counts only after 1971, where clocks never set begin.
    """
    inside = F.when(~video | (embedded > 1971), embedded)
    year = F.coalesce(F.nullif(sidecar, F.lit(0)), inside, name, modified)
    source = F.when(sidecar > 0, "takeout-sidecar").when(inside.isNotNull(), "embedded-metadata").when(name.isNotNull(), "filename").otherwise("file-mtime")
    return F.struct(year.cast("int").alias("year"), source.alias("source"))


def _fixed(n: Column, unit: float, digits: int) -> Column:
    """``n / unit`` as text, rounded by the exact value of the double and exact ties to even, as C and Python print it.

    Java's formatter rounds the shortest decimal text half up, so 150 000 bytes would be 0.2 MB, though the double is below 0.15.
    """
    v, step = F.abs(n / unit), 10**digits
    low = F.floor(v * step)
    # The product of v and an integer below 2 ** 26 is exact in two halves of v.
    wide = v * 134217729.0
    high = wide - (wide - v)
    over = (high * (2.0 * step) - (2 * low + 1)) + (v - high) * (2.0 * step)
    whole = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(n < 0, "-").otherwise(""), F.format_string(f"%d.%0{digits}d", F.floor(whole / step), whole % step))


def human_bytes(n: Column) -> Column:
    return F.when(n >= 1e9, F.concat(_fixed(n, 1e9, 2), F.lit(" GB"))).otherwise(F.concat(_fixed(n, 1e6, 1), F.lit(" MB")))


def human_seconds(sec: Column) -> Column:
    """Hours and minutes or minutes and seconds; a dash for null, NaN, negative or over a week."""
    h, m, s = (F.floor(sec / 3600), F.floor(sec % 3600 / 60), F.floor(sec % 60))
    ok = sec.isNotNull() & ~F.isnan(sec) & sec.between(0, 604800)
    return F.when(~ok, "—").when(h > 0, F.format_string("%dh %02dm", h, m)).otherwise(F.format_string("%dm %02ds", m, s))
