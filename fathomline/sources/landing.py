"""Folders that all executors see, and files landed there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as on one machine, a temporary folder that goes with the process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        folder = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage; ``dropped`` deletes the files."""
    place = new_place(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def dropped(df: DataFrame) -> None:
    """Delete the files that ``kept`` wrote for ``df``."""
    spark = df.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, parent)


def delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def land(pages: DataFrame, place: str | None = None) -> str:
    """Write ``pages(listing, page, body)``, a file each page, as ``listing=…/page=…``; the folder's name."""
    place = place or new_place(pages.sparkSession, "landed")
    one = pages.select("listing", "page", "body").repartition("listing", "page")
    one.write.partitionBy("listing", "page").text(place)
    return place
