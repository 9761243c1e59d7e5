"""Arrays that tasks write, Spark hands out, and workers map into memory.

A table of (part int, payload binary), one row a part, is written to the shared folder; Spark
hands its files to every executor once, and none passes through the driver's memory. The first
worker of an executor that needs a file lays its payloads out as flat files beside it, which
all workers of the executor map, so that they share the pages and no heap holds them. An
executor that comes later fetches the same files.

A payload is a header and arrays one after another, each from a multiple of 64 bytes on.
No rows give no parts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import Staged

EDGE = 64


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays, which have one dimension, as one payload."""
    told, at = {}, 0
    for name, x in arrays.items():
        told[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // EDGE) * EDGE
    head = json.dumps(told).encode()
    first = -(-(8 + len(head)) // EDGE) * EDGE
    out = [np.int64(len(head)).tobytes(), head, bytes(first - 8 - len(head))]
    for x in arrays.values():
        out += [np.ascontiguousarray(x).tobytes(), bytes(-x.nbytes % EDGE)]
    return b"".join(out)


def opened(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file that holds a payload, mapped."""
    raw = np.memmap(path, np.uint8, "r")
    size = int(raw[:8].view(np.int64)[0])
    first = -(-(8 + size) // EDGE) * EDGE
    told = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[first + at : first + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in told.items()}


def hand_out(parts: DataFrame, operator: str) -> list[str]:
    """Writes the parts to the shared folder and registers their files; returns the files' names."""
    spark = parts.sparkSession
    files = Staged(spark, operator).put(parts.select("part", "payload"), "parts", tidy=False).inputFiles()
    for f in sorted(files):
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in sorted(files)]


def handed(names: list[str]) -> dict[int, str]:
    """In a task: part to the path of its flat file, laid out by the first worker that asks."""
    found = {}
    for name in names:
        source = SparkFiles.get(name)
        for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["part"]):
            for part in batch.column(0).to_pylist():
                found[part] = f"{source}.{part}.map"
        if all(os.path.exists(p) for p in found.values()):
            continue
        for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = f"{found[part]}.{os.getpid()}"
                with open(own, "wb") as out:
                    out.write(payload.as_buffer())
                os.replace(own, found[part])
    return found
