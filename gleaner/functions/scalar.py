"""Column functions that queries share. All are built from Spark's own expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Grey weights of blue, green, red.
GREY = (0.114, 0.587, 0.299)
HASH_ROWS, HASH_COLS = 8, 8
#: Role classes; any other is read as unknown.
ROLES = ("villager", "outcast", "minion", "demon", "unknown")
UNKNOWN = "unknown"


def stride_for_fps(media_fps: Column, target_fps: Column) -> Column:
    """Frames from one sample to the next: the ratio rounded half to even, at least 1; non-positive rates are an error."""
    bad = (media_fps <= 0) | (target_fps <= 0)
    return F.when(bad, F.raise_error(F.lit("frame rates must be positive"))).otherwise(F.greatest(F.lit(1), F.rint(media_fps / target_fps).cast("int")))


def timestamp_of(index: Column, fps: Column) -> Column:
    return F.when(fps > 0, index / fps).otherwise(0.0)


def media_fps(container: Column, probe: Column, fallback: float = 30.0) -> tuple[Column, Column]:
    """(frame rate, where it is from): the container's if between 0 and 1000, else the probe's `n/d`, else the fallback."""
    parts = F.split(probe, "/")
    rational = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))
    usable = (container > 0) & (container < 1000) & ~F.isnan(container)
    probed = F.when(rational > 0, rational)
    return F.when(usable, container).otherwise(F.coalesce(probed, F.lit(fallback))), F.when(usable, "container").when(probed.isNotNull(), "probe").otherwise("fallback")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in two's complement."""
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column) -> Column:
    """An array of booleans as one integer, first bit highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def gradient_hash(cells: Column, rows: int = HASH_ROWS, cols: int = HASH_COLS) -> Column:
    """Difference hash of a row-major grid of `rows` x (`cols` + 1) brightness cells: a bit is 1 where the right neighbour is brighter."""
    at = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    left = lambda i: (F.floor(i / cols) * (cols + 1) + i % cols).cast("int")
    return pack_bits(F.transform(at, lambda i: F.get(cells, left(i) + 1) > F.get(cells, left(i))))


def pixel_edge(relative: Column, size: Column, most: Column) -> Column:
    """A relative edge in pixels, rounded half to even and kept in 0 .. most."""
    return F.least(F.greatest(F.rint(relative * size).cast("int"), F.lit(0)), most)


def valid_role(role: Column) -> Column:
    return F.when(role.isin(*ROLES), role).otherwise(UNKNOWN)


#: Characters that count as white space at the ends of a title.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def slugify(text: Column) -> Column:
    """White space at the ends goes, blanks become `_`, and so does what is no ASCII letter, digit, dot, `_` or `-`."""
    return F.regexp_replace(F.replace(F.trim(text, F.lit(WHITE_SPACE)), F.lit(" "), F.lit("_")), "[^A-Za-z0-9._-]", "_")


def frame_name(stem: Column) -> tuple[Column, Column, Column]:
    """`video_index_tseconds[s]` -> (video, index, seconds), each with a fallback: the stem, 0, 0.0."""
    parts = F.split(stem, "_")
    seconds = F.rtrim(F.ltrim(F.get(parts, F.lit(2)), F.lit("t")), F.lit("s"))
    video = F.when(F.size(parts) > 0, F.get(parts, F.lit(0))).otherwise(stem)
    return video, F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0)), F.coalesce(seconds.try_cast("double"), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, least: float = 1e-9) -> Column:
    """`v` over its length; all zeros if that is under `least`."""
    n = F.sqrt(dot(v, v))
    return F.when(n < least, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / n))


def exact_round(x: Column, digits: int) -> Column:
    """The nearest decimal of so many digits to the exact binary value, half to even; Spark's own rounding goes by the shortest decimal."""

    @F.arrow_udf(DoubleType())
    def rounded(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, digits) for v in values.to_pylist()], pa.float64())

    return rounded(x)


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as ISO-8601 in UTC, whatever the session's zone: YYYY-MM-DDTHH:MM:SS+00:00."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.floor(seconds).cast("long") - F.floor(seconds / 86400) * 86400
    return F.format_string("%sT%02d:%02d:%02d+00:00", day.cast("string"), F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
