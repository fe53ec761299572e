"""Written copies of slow sources, named after what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files


def signature(path: str, key: str, version: str = "1") -> str:
    """Names a copy after its source's place, size and time, what was read from it, and the layout's version."""
    system, at = files.opened(path)
    info = system.get_file_info(at)
    return hashlib.sha256("|".join([path, key, str(info.size), str(info.mtime_ns), version]).encode()).hexdigest()


def cached(spark: SparkSession, root: str, path: str, key: str, build: Callable[[], DataFrame], order: str = "idx") -> DataFrame:
    """build()'s rows as Parquet in root, range-partitioned and sorted by order so that row groups can be skipped; built again when the source changes.

    A copy is written under a name of its own; the small file that points to it is
    written last, so a reader never sees half of one, in any store. The pointer holds the
    number of rows, and a copy that has another is refused.
    """
    pointer = f"{root}/{signature(path, key)}.json"
    if not files.exists(pointer):
        folder = f"{root}/{uuid.uuid4().hex}"
        build().repartitionByRange(order).sortWithinPartitions(order).write.parquet(folder)
        files.write(pointer, json.dumps({"source": path, "key": key, "folder": folder, "rows": spark.read.parquet(folder).count()}).encode())
    held = json.loads(files.read(pointer))
    copy = spark.read.parquet(held["folder"])
    if copy.count() != held["rows"]:  # of the files' footers
        raise ValueError(f"{held['folder']} is not whole: {held['rows']} rows expected")
    return copy


def convert(events: DataFrame, path: str, names: dict[str, str] | None = None, compression: str = "zstd", mode: str = "overwrite") -> int:
    """Writes events as Parquet with renamed columns; the number of rows."""
    out = events.select(*[events[c].alias((names or {}).get(c, c)) for c in events.columns])
    out.write.mode(mode).option("compression", compression).parquet(path)
    return events.sparkSession.read.parquet(path).count()
