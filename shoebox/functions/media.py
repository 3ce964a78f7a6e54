"""Scalars over photo and video metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.functions.names import MESSENGER_NAME, SCREEN_NAME

# Pixel sizes of phone screens.
SCREEN_SIZES = [(1170, 2532), (1179, 2556), (1080, 2340), (1284, 2778), (1290, 2796), (750, 1334), (828, 1792), (1125, 2436), (1440, 3200), (1080, 2400), (2532, 1170), (2340, 1080)]


def exif_time(raw: Column) -> Column:
    """'2020:01:02 03:04:05' as '2020-01-02T03:04:05'."""
    return F.regexp_replace(F.regexp_replace(raw, r"^(\d{4}):(\d{2}):", "$1-$2-"), r"^(\S+) ", "$1T")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds as one number, negative in the south and west."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def quality_score(sharpness: Column, mean: Column, megapixels: Column) -> Column:
    """0..1 from sharpness, exposure around 0.45 and size, three decimals; null where one is missing."""
    exposure = 1 - F.least(F.lit(1.0), F.abs(mean - 0.45) / 0.45)
    score = F.round(0.5 * F.least(F.lit(1.0), sharpness / 500) + 0.25 * exposure + 0.25 * F.least(F.lit(1.0), megapixels / 8), 3)
    return F.when(sharpness.isNotNull() & mean.isNotNull() & megapixels.isNotNull(), score)


def padded_box(box: Column, width: Column, height: Column, pad: float = 0.35) -> Column:
    """[x1, y1, x2, y2] grown by a share of its size on each side and kept inside the picture."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    w, h = (x2 - x1) * pad, (y2 - y1) * pad
    zero = F.lit(0.0)
    return F.array(F.greatest(zero, x1 - w), F.greatest(zero, y1 - h), F.least(width.cast("double"), x2 + w), F.least(height.cast("double"), y2 + h))


def frame_times(duration: Column, most: int = 300) -> Column:
    """Sampling times of a video: at most ``most``, at least a second apart, each in the middle of its interval."""
    step = F.greatest(F.lit(1.0), duration / most)
    n = F.greatest(F.lit(1), F.floor(duration / step)).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(i * step + step / 2, F.greatest(F.lit(0.0), duration - 1)))
    return F.when(duration.isNotNull() & ~F.isnan(duration) & (duration >= 0), at)


def date_text_rank(text: Column) -> Column:
    """Sum of the character codes of the first ten characters ('9999' where there is no date)."""
    first = F.substring(F.coalesce(F.nullif(text, F.lit("")), F.lit("9999")), 1, 10)
    return F.aggregate(F.transform(F.split(first, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)


def heuristic_labels(name: Column, width: Column, height: Column, mime: Column, has_exif: Column) -> Column:
    """array<struct(label, score)> guessed from name, size and type alone."""
    n, w, h = F.coalesce(name, F.lit("")), F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    screen = F.struct(w.alias("w"), h.alias("h")).isin([F.struct(F.lit(a), F.lit(b)) for a, b in SCREEN_SIZES])
    slim = (F.coalesce(mime, F.lit("")) == "image/png") & ~has_exif & (w > 0) & (h > 0) & (w / F.nullif(h, F.lit(0)) > 0.4) & (w / F.nullif(h, F.lit(0)) < 0.6)
    score = F.when(n.rlike(SCREEN_NAME), 0.97).when(screen & ~has_exif, 0.75).when(slim, 0.6)
    one = lambda label, s: F.struct(F.lit(label).alias("label"), s.cast("double").alias("score"))
    both = F.array(F.when(score.isNotNull(), one("screenshot", score)), F.when(n.rlike(MESSENGER_NAME), one("messaging_download", F.lit(0.8))))
    return F.filter(both, lambda x: x.isNotNull())
