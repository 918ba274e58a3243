"""Files as frames: image folders, gallery trees, cached pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleaner.operators.frames import first_of

VIDEO_TYPES = ("mp4", "mov", "mkv", "avi")
PAGE = StructType([StructField("title", StringType()), StructField("wikitext", StringType()), StructField("html", StringType()), StructField("images", ArrayType(StringType())), StructField("categories", ArrayType(StringType()))])


def _absent(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, w, h, n_channels, pixels): decoded PNG files, bytes in blue-green-red order; files that do not decode are left out.

    `path`: a folder, without those below it unless `recursive`, or a file; if it is not there, no rows.
    """
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.png")
    try:
        df = reader.load(path)
    except AnalysisException as e:
        if not _absent(e):
            raise
        return spark.createDataFrame([], "path string, w int, h int, n_channels int, pixels binary")
    return df.select(F.col("image.origin").alias("path"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("pixels"))


def collection(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """The images of `path` in order of path; the first `most` if above 0."""
    return first_of(images(spark, path), None, ["path"], most).orderBy("path")


def gallery_tree(spark: SparkSession, root: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Images of `root/role/identity/file.png` with role (lower case), identity and file stem from the path.

    `aliases` names identities anew. No such root is a FileNotFoundError, no image a ValueError.
    """
    df = images(spark, root, recursive=True)
    if df.isEmpty():
        try:
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        except AnalysisException as e:
            if _absent(e):
                raise FileNotFoundError(root) from None
            raise
        raise ValueError(f"no images in {root}")
    parts = F.split("path", "/")
    raw = F.element_at(parts, -2)
    identity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), raw), raw) if aliases else raw
    return df.select(F.lower(F.element_at(parts, -3)).alias("role"), identity.alias("identity"), F.regexp_replace(F.element_at(parts, -1), r"\.png$", "").alias("file_stem"), "w", "h", "n_channels", "pixels")


def videos(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of video files in a folder, in order of path."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return spark.read.format("binaryFile").load(path).where(kind.isin(*VIDEO_TYPES)).select("path", "length").orderBy("path")


def cached_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", True).json(path)
