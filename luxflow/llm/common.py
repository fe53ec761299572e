"""What the operators share: table access, written intermediate tables, batch helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in a local session, an error on a cluster."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="luxflow-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's own default of rows in an Arrow batch, and what the operators set in its place: of long texts the default is much memory for each worker.
DEFAULT_ROWS, ROWS = 10_000, 500


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches from here on, unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == DEFAULT_ROWS:
        spark.conf.set(key, ROWS)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null: empty) and the named columns; any others are left out."""
    lean(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *[docs[c] for c in more])


def columns(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 500) -> Iterator[tuple[list, ...]]:
    """The named columns of the batches, as Python lists of that many rows at most, so that a batch's texts are never all held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


def chunked(items: Iterator[tuple[str, int]], limit: int) -> Iterator[list]:
    """Groups (item, weight) pairs into lists of about limit weight each."""
    out, total = [], 0
    for item, weight in items:
        out.append(item)
        total += weight
        if total >= limit:
            yield out
            out, total = [], 0
    if out:
        yield out


class WordCache(dict):
    """Words and their ids, about `limit` bytes of them: when half of that is full it becomes the older half, from which words that come again are taken over."""

    def __init__(self, limit: int):
        self.limit, self.size, self.older = limit, 0, {}

    def missing(self, words: set[str]) -> list[str]:
        """Those of words that neither half holds; those of the older half are taken over."""
        new = [w for w in words if w not in self]  # a difference of sets goes through the whole cache
        again = [w for w in new if w in self.older]
        self.add(again, list(map(self.older.__getitem__, again)))
        return [w for w in new if w not in self.older]

    def add(self, words: list[str], ids: list[bytes]) -> None:
        self.update(zip(words, ids, strict=True))
        self.size += len("".join(words)) + len(b"".join(ids)) + 190 * len(words)  # two objects' heads and a place in the table

    def trim(self) -> None:
        """To be called when the batch that was added to it has been read."""
        if self.size > self.limit // 2:
            self.older = dict(self)
            self.clear()
            self.size = 0


_HELD: dict[tuple, object] = {}


def worker_held(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next: one thing, so another key's takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, as a task that drops what other operators' tasks have left in the worker (all but keys that start with keeps) and gives freed memory back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from luxflow.llm import common  # the worker's own module, not a pickled copy of its state

        for key in [k for k in common._HELD if k[0] != keeps]:
            del common._HELD[key]
        try:
            yield from run(batches)
        finally:
            common._give_back()

    return task
