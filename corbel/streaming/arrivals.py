"""An extension: bundles as they arrive, by Structured Streaming.

The batch plans read a whole set; these read new files of a folder, split them
with the same reader, and keep the first copy of each module by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bundles

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*.js") -> DataFrame:
    """(path, modificationTime, name, deps, source_sha256, slice): modules of new files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(path)
    named = files.select(F.xxhash64("path").alias("bundle_ord"), "content")
    return bundles.split(named).select("bundle_ord", "name", "deps", F.sha2("slice", 256).alias("source_sha256"), "slice")


def new_contents(modules: DataFrame) -> DataFrame:
    """Each (name, content) once, whatever the number of bundles that carry it; the state holds a hash for each."""
    return modules.dropDuplicates(["name", "source_sha256"])


def copies(modules: DataFrame) -> DataFrame:
    """(name, copies): how often each module has arrived, for a sink that takes updates."""
    return modules.groupBy("name").agg(F.count("*").alias("copies"))
