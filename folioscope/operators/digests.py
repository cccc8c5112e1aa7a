"""SHA-256 of large files, of which no task reads more than a block.

The hash is a chain over a file's bytes, so its blocks are taken one after the other, each by a task of its own
that gets the state after the block before it (112 bytes) and gives the next; files go on side by side. Blocks are
those in which Spark reads lines (``spark.sql.files.maxPartitionBytes`` at most). A line is what lies between two
bytes 0x0A, whatever a file holds, and belongs to the block it begins in; a line longer than a block is read whole.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"\xef\xbb\xbf"
#: state: after the lines so far; seen: their number; fed: their bytes, with those between them; last: where the last block begins
STATE = "path string, state binary, seen long, fed long, last long"


class _Context(ctypes.Structure):
    """OpenSSL's SHA256_CTX as openssl/sha.h has it; its bytes can go from task to task, which hashlib's objects can't."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


def openssl() -> ctypes.CDLL | None:
    """The library under hashlib, or the system's; none where Python has it built in and the system lacks it."""
    try:
        import _hashlib

        places = [getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")]
    except ImportError:
        places = [ctypes.util.find_library("crypto")]
    for place in filter(None, places):
        try:
            lib = ctypes.CDLL(place)
            lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            lib.SHA256_Init.argtypes, lib.SHA256_Final.argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]
            return lib
        except (OSError, AttributeError):
            continue
    return None


def _begun(start: bytes) -> bytes:
    lib, context = openssl(), _Context()
    lib.SHA256_Init(ctypes.byref(context))
    lib.SHA256_Update(ctypes.byref(context), start, len(start))
    return bytes(context)


def _ended(state: bytes, rest: bytes) -> str:
    lib, context, out = openssl(), _Context.from_buffer_copy(state), ctypes.create_string_buffer(32)
    lib.SHA256_Update(ctypes.byref(context), rest, len(rest))
    lib.SHA256_Final(out, ctypes.byref(context))
    return out.raw.hex()


def _step(before: tuple):
    """What a task does with a block's lines (value, start), and gives as one row."""

    def run(batches):
        path, state, seen, fed, last = before
        lib, context = openssl(), _Context.from_buffer_copy(state)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = batch.column("start").to_numpy()
            if starts[0] < last or (starts[1:] < starts[:-1]).any():
                raise ValueError(f"{path}: blocks aren't read in order")
            # the byte between two lines goes before the later one: only the file's length tells if there is one at its end
            data = b"\n".join([*([b""] if seen else []), *batch.column("value").to_pylist()])
            lib.SHA256_Update(ctypes.byref(context), data, len(data))
            seen, fed, last = seen + batch.num_rows, fed + len(data), int(starts[-1])
        yield pa.RecordBatch.from_pydict({"path": [path], "state": [bytes(context)], "seen": [seen], "fed": [fed], "last": [last]})

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(plain(path))
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("start"))


def plain(path: str) -> str:
    """A path that Spark's readers take as it is, and not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def chained(spark: SparkSession, lengths: dict[str, int], start: bytes = b"") -> dict[str, str]:
    """path -> SHA-256 (hex) of files (path -> length) that begin with ``start`` if Spark's reader of lines leaves it out.

    Rounds are as many as the blocks of the largest file; only states come to the driver.
    """
    sc = spark.sparkContext
    lines = {p: _lines(spark, p) for p in lengths}
    at = {p: (p, _begun(start), 0, len(start), -1) for p in lengths}
    parts = {p: df.rdd.getNumPartitions() for p, df in lines.items()}
    for k in range(max(parts.values())):
        going = [p for p in lengths if k < parts[p]]
        # a file's parts are its blocks in order, which each step holds against where they begin
        steps = sc.union([lines[p].mapInArrow(_step(at[p]), STATE).rdd for p in going])
        for row in sc.runJob(steps, list, [first + k for first in accumulate((parts[p] for p in going[:-1]), initial=0)]):
            at[row["path"]] = (row["path"], bytes(row["state"]), row["seen"], row["fed"], row["last"])
    found, marked = {}, {}
    for p, length in lengths.items():
        _, state, _, fed, _ = at[p]
        if length - fed in (0, 1):
            found[p] = _ended(state, b"\n" * (length - fed))
        elif not start and length - fed - len(MARK) in (0, 1):
            marked[p] = length  # lines are read without the mark that a file begins with
        else:
            raise ValueError(f"{p}: {fed} of {length} bytes were read")
    return found | (chained(spark, marked, MARK) if marked else {})
