"""Token ids as Parquet list columns, written in order of documents and read back.

Documents are dealt to files by ranges of their ids; each task encodes its range and
Spark's writer stores it with dictionary pages for ids, delta encoding for numbers (the
format's version 2), bounded row groups, and page indexes, so that a reader can take the
metadata columns alone or the pages of a few documents. Files hold positions within
themselves; the place of a document in the whole follows from the files' totals, one
small row each.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, shared_dir
from .words import batches_of, hash_pieces, text_bytes

#: Row groups of about this size in memory, and pages of at most this size.
WRITE_OPTIONS = {
    "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(2 << 20), "compression": "zstd",
}
FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, token_ids array<int>"
#: Distinct pieces whose ids a worker remembers (about 30 bytes each); beyond, it starts anew.
REMEMBERED = 500_000
#: Rows and bytes of text that are encoded at once.
ROWS, BYTES = 500, 1 << 19
#: Texts that tell whether a tokenizer's ids of a text are those of its pieces.
PROBES = (
    "It's an EXAMPLE, isn't it?  Two   spaces;\ttabs\nand lines.", "a1b22 3.14 don''t (x) [y] {z} <w> --- ... 'S", "Größe ÉTÉ Straße αβγ ΣΑΣ Привет, мир!",
    "日本語のテキスト。 한국어 العربية ไทย 😀👍🏽", " leading and trailing ", "CamelCase snake_case kebab-case e-mail@example.org https://example.org/a?b=c#d", "", " ", "\x1c\x85\xa0 x\u200by", "Z\u0301 é e\u0301 ﬁ ½ Ⅷ",
)

# classes of bytes: white space, ASCII letters and digits, ASCII marks, and what may join either
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
for _c in range(33, 127):
    _CLASS[_c] = 1 if chr(_c).isalnum() else 3 if chr(_c) == "'" else 2


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once where that gives the same ids.

    Many pre-tokenizers drop white space, split letters and digits from marks, and ignore
    the case of letters. Then a lower-cased text can be cut at ASCII white space and
    between ASCII letters or digits and ASCII marks (apostrophes aside, which contractions
    begin with), and its ids are those of its pieces in order. Whether a tokenizer is of
    this kind is tried on probe texts when it is loaded; texts go to any other whole, as
    do texts that hold the string of an added token.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.by_pieces = Tokenizer.from_file(path), end_id, True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()
        probes = [p.encode() for p in PROBES]
        (ids, at), (whole_ids, whole_at) = self.encode(probes), self._encode_whole(probes)
        self.by_pieces = np.array_equal(ids, whole_ids) and np.array_equal(at, whole_at)

    def _encode_whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum([len(f) + 1 for f in found], dtype=np.int64)])
        return np.fromiter((i for f in found for i in (*f, self.end_id)), np.int32, int(at[-1])), at

    def forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = [np.array([self.end_id], np.int32)]
        self.total = 1

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        found = []
        for s in range(0, len(pieces), 2000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[s : s + 2000]], add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.place = np.insert(self.place, at, len(self.count) + np.arange(len(hashes)))
        self.begin = np.concatenate([self.begin, self.total + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids.append(np.fromiter((i for f in found for i in f), np.int32, int(count.sum())))
        self.total += int(count.sum())

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and where each text's begin (one more than texts)."""
        if not self.by_pieces or any(x in t for t in texts for x in self.special):
            return self._encode_whole(texts)
        data = b" ".join(texts).lower()
        raw = np.frombuffer(data, np.uint8)
        kind = np.concatenate([[0], _CLASS[raw], [0]])
        here, before = kind[1:], kind[:-1]
        cut = (here != before) & ((here == 0) | (before == 0) | ((here == 1) & (before == 2)) | ((here == 2) & (before == 1)))
        edge = np.flatnonzero(cut)
        solid = kind[1:][edge] != 0
        starts, ends = edge[solid], edge[1:][solid[:-1]]
        hashes = hash_pieces(raw, starts, ends)
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            new = first[~known]
            self._learn(distinct[~known], [data[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        upto = np.searchsorted(starts, begins[1:])
        place = np.insert(self.place[at][where] if len(distinct) else where, upto, 0)  # place 0: the end id
        count = self.count[place]
        to = np.cumsum(count)
        ids = self.ids[0][np.repeat(self.begin[place] - (to - count), count) + np.arange(to[-1] if len(to) else 0)]
        ends_at = upto + np.arange(len(texts))
        return ids, np.concatenate([[0], to[ends_at]])


#: The encoder of this worker process, kept from task to task.
_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def _encode_part(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = PieceEncoder(path, end_id)
    encoder, start, part = _ENCODERS[path, end_id], 0, TaskContext.get().partitionId()
    for batch in batches_of(batches, "text", ROWS, BYTES):
        ids, at = encoder.encode(text_bytes(batch.column("text")))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(start + at[:-1]),
            pa.array(np.diff(at).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
        ], names=["doc_id", "part", "start_in_part", "n_tokens", "token_ids"])
        start += int(at[-1])


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1, options: dict[str, str] | None = None) -> str:
    """Writes the ids of all documents in ascending order of doc_id; returns the folder.

    ``options`` change those of the writer: sizes of row groups, pages and dictionaries.

    Null and empty texts give the end id alone. Null ids come first; rows with one id
    stay together, in order of their texts. Other columns of docs are ignored. The
    tokenizer's file must be at the same path on every machine.
    """
    bound_batches(docs.sparkSession)
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(lambda it: _encode_part(it, tokenizer_path, end_id), FILE_SCHEMA)
    encoded.write.options(**(WRITE_OPTIONS | (options or {}))).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The files' rows with start, the number of ids of all documents before.

    With bounds only the rows with low <= doc_id <= high. They are pushed down to the
    files, whose rows are in order of doc_id: row groups are left out by their statistics,
    and within the others only the pages that the page index names are read. Null ids
    are in no such range. Selecting doc_id, n_tokens or start alone reads no token ids; the
    files' totals, which start needs, come from two columns of numbers.
    """
    bound_batches(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = files if low is None else files.where(F.col("doc_id") >= low)
    rows = rows if high is None else rows.where(F.col("doc_id") <= high)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(starts), F.col("part") == F.col("_part"))  # one row for each file
    return joined.withColumn("start", (F.col("_before") + F.col("start_in_part")).cast("long")).drop("_part", "_before")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("token_ids")
        offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().astype("<u4", copy=False)
        crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(tokens))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc)],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids as read from the files."""
    return tokens.select("doc_id", "start", "token_ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
