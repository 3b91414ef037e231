"""Folders for what is written on the way: below the folder that the cluster names, which every executor reaches."""

from __future__ import annotations

import atexit
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

#: Where they lie if the session names none and all runs on one machine.
LOCAL = "/tmp/checkpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
    return f"file://{LOCAL}"


def _remove(path: str) -> None:
    try:
        fs, top = pyarrow.fs.FileSystem.from_uri(path)
        if fs.get_file_info(top).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(top)
    except Exception:  # noqa: BLE001 - the store may be gone; the folder is then the cluster's to clear
        pass


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, removed when the driver ends."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path
