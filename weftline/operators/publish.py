"""A folder of versions of a table: publish, guard, clean up, read the live one.

``root/versions/<name>`` holds a whole version, with a marker that its writer ends with; ``root/CURRENT`` holds the name of the
live one and is replaced by a rename, so readers see one version or the other. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A new version with fewer rows than this share of the live one is refused.
LEAST_SHARE = 0.5
#: Versions that stay: the live one and the newest others up to so many in all.
KEEP = 3
#: A folder without its marker may be another publisher's work; after so many milliseconds it is dead.
DEAD_MS = 3_600_000
_DONE = "_SUCCESS"


class _Files:
    """The few file operations that versions need, on the file system of ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside ``name``, then renames over it: a reader finds the old text or the new one."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside))
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(beside), self.path(name), options)

    def folders(self, name: str) -> list[tuple[int, str]]:
        """Time of change and name of the folders in ``name``, newest first."""
        if not self.exists(name):
            return []
        return sorted(((s.getModificationTime(), s.getPath().getName()) for s in self.fs.listStatus(self.path(name)) if s.isDirectory()), reverse=True)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the whole versions, newest first."""
    files = _Files(spark, root)
    return [name for _, name in files.folders(f"{root}/versions") if files.exists(f"{root}/versions/{name}/{_DONE}")]


def publish_version(table: DataFrame, root: str, force: bool = False, version: str | None = None, model: str | None = None, keep: int = KEEP) -> str:
    """Writes a version and makes it live; returns its name.

    A ``version`` of this name that is there already isn't written again. A version with under ``LEAST_SHARE`` of the live one's
    rows is refused and deleted, unless ``force``. ``model`` names what made its vectors. Afterwards the live version and the
    newest others stay, ``keep`` in all, and unfinished folders of dead publishers go.
    """
    spark = table.sparkSession
    files = _Files(spark, root)
    version = version or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    path, live = f"{root}/versions/{version}", files.read(f"{root}/CURRENT")
    if not files.exists(f"{path}/{_DONE}"):
        rows = table if model is None else table.withColumn("model", F.lit(model))
        rows.write.mode("overwrite").parquet(path)
        if live and live != version and not force and files.exists(f"{root}/versions/{live}/{_DONE}"):
            now, before = (spark.read.parquet(p).count() for p in (path, f"{root}/versions/{live}"))
            if now < LEAST_SHARE * before:
                files.delete(path)
                raise ValueError(f"{now} rows are under {LEAST_SHARE:.0%} of the {before} of the live version")
    files.replace(f"{root}/CURRENT", version)
    whole = [v for v in versions(spark, root) if v != version]
    for name in whole[keep - 1 :]:
        files.delete(f"{root}/versions/{name}")
    now = int(datetime.now(timezone.utc).timestamp() * 1000)
    for changed, name in files.folders(f"{root}/versions"):
        if now - changed > DEAD_MS and not files.exists(f"{root}/versions/{name}/{_DONE}"):
            files.delete(f"{root}/versions/{name}")
    return version


def load_version(spark: SparkSession, root: str, width: int | None = None, known: DataFrame | None = None, model: str | None = None) -> DataFrame | None:
    """The live version if it is whole and fits, else the newest other one that does; None if there is none.

    Fit: vectors of ``width``, ids that ``known`` has, made by ``model``.
    """
    live = _Files(spark, root).read(f"{root}/CURRENT")
    names = versions(spark, root)
    for name in sorted(names, key=lambda v: v != live):  # a stable sort: the live one, then the newest
        table = spark.read.parquet(f"{root}/versions/{name}")
        if model is not None and ("model" not in table.columns or not table.where(~F.col("model").eqNullSafe(F.lit(model))).isEmpty()):
            continue
        if width and not table.where(~F.coalesce(F.size("vector") == width, F.lit(False))).isEmpty():
            continue
        if known is not None and not table.join(known, "item_id", "left_anti").isEmpty():
            continue
        return table
    return None
