"""Removal of word sequences that an earlier document has, by FM-indexes of shards.

1. Of each run of ``window`` words the least hash of its short word sequences is an
   anchor. Equal windows have equal anchors, so only the surroundings of anchors that two
   documents share need to be searched, and these are all.
2. A surrounding is a segment: the words of the windows that the anchor is the least of.
   Equal segments are kept once, under their least document; so copies, however many,
   are one segment.
3. Segments whose anchor has more than one are dealt into shards by anchor. Each shard
   builds a compressed FM-index over its segments and streams them through it: backward
   search over the wavelet tree gives the stretches in which every window occurs in a
   document with a smaller id. An anchor with very many segments is cut in blocks, and
   each pair of an indexed and a streamed block is a shard of its own, so that no task
   holds a whole anchor. A segment of a document other than the segment's least occurs
   there from end to end.
4. Stretches return to their documents, whose covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .fm_index import FMIndex, matched_windows
from .words import batches_of, hash_words, mix, runs, sequence_hashes, text_bytes

#: Words of a sequence whose hash can be an anchor.
ANCHOR = 8
#: Words of an index over the segments of many anchors.
SHARD_WORDS = 1_000_000
#: Words of the segments of one anchor above which they are cut in blocks of about so many.
BLOCK_WORDS = 1_000_000
SEGMENTS = "anchor long, h1 long, h2 long, doc_id long, text_hash long, start int, length int, words binary"
#: What names a row: places in one text mean nothing in another, though both have one doc_id.
ROW = ("doc_id", "text_hash")
STRETCHES = "anchor long, h1 long, h2 long, starts array<int>, ends array<int>"


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    size, want = 1, len(x) - width + 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:want], x[width - size : width - size + want])


def window_minima(words: np.ndarray, at: np.ndarray, window: int, n: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of an n-word sequence in each window (0 where it would leave its document), and all these hashes."""
    grams = sequence_hashes(words, n)
    width = window - n + 1
    if len(grams) < width:
        return np.zeros(0, np.uint64), grams
    least = _sliding(np.minimum, grams, width)
    end = np.repeat(at[1:], np.diff(at))[: len(least)]
    least[np.arange(len(least)) + window > end] = 0
    return least, grams


def anchors_of(words: np.ndarray, at: np.ndarray, window: int, n: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in words) of anchors, and the hashes of all n-word sequences."""
    least, grams = window_minima(words, at, window, n)
    if not len(least):
        return np.zeros(0, np.int64), grams
    pad = np.zeros(window - n, np.uint64)
    most = _sliding(np.maximum, np.concatenate([pad, least, pad]), window - n + 1)
    return np.flatnonzero(most == grams), grams


def segments_of(least: np.ndarray, grams: np.ndarray, anchors: np.ndarray, window: int, n: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """First word of the windows that each anchor is the least of, and the word after them; they are a stretch."""
    first, last = np.full(len(anchors), np.iinfo(np.int64).max), np.full(len(anchors), -1)
    for back in range(window - n + 1):
        start = anchors - back
        own = (start >= 0) & (start < len(least))
        own[own] = least[start[own]] == grams[anchors[own]]
        first[own] = np.minimum(first[own], start[own])
        last[own] = np.maximum(last[own], start[own])
    return first, last + window


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "text"):
        words, at = hash_words(text_bytes(batch.column("text")))
        pos, grams = anchors_of(words, at, window)
        doc = np.searchsorted(at, pos, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams[pos].view(np.int64)), *(batch.column(c).take(pa.array(doc)) for c in ROW), pa.array((pos - at[doc]).astype(np.int32))],
            names=["anchor", *ROW, "pos"],
        )


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "text", rows=500, size=2 << 20):
        texts = text_bytes(batch.column("text"))
        words, at = hash_words(texts)
        least, grams = window_minima(words, at, window)
        places = batch.column("places")
        count = np.diff(places.offsets.to_numpy())
        anchors = places.flatten().to_numpy().astype(np.int64) + np.repeat(at[:-1], count)
        first, last = segments_of(least, grams, anchors, window)
        # sums over words give each stretch a hash: its own part, brought to the front
        scale = np.cumprod(np.full(len(words) + 1, 0x9E3779B97F4A7C15, np.uint64))
        unscale = np.cumprod(np.full(len(words) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * scale[: len(words)])]) for x in (words, mix(words))]
        h1, h2 = (mix((x[last] - x[first]) * unscale[first]).view(np.int64) for x in sums)
        keys = grams[anchors].view(np.int64)
        fresh = np.zeros(len(anchors), bool)
        fresh[np.unique(np.stack([keys, h1, h2]), axis=1, return_index=True)[1]] = True
        base = np.repeat(at[:-1], count)
        own = np.repeat(np.arange(len(texts)), count)
        parts, split, held = [], [], -1
        for k, a, b, new in zip(own.tolist(), (first - base).tolist(), (last - base).tolist(), fresh.tolist(), strict=True):
            if new and k != held:
                split, held = texts[k].split(), k
            parts.append(b" ".join(split[a:b]) if new else None)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys), pa.array(h1), pa.array(h2), *(batch.column(c).take(pa.array(own)) for c in ROW),
            pa.array((first - base).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(parts, pa.binary()),
        ], names=["anchor", "h1", "h2", *ROW, "start", "length", "words"])


def _search(indexed: pa.Table, streamed: pa.Table, window: int) -> pa.RecordBatch:
    """Stretches of the streamed segments whose windows all occur in an indexed one of a smaller owner."""
    tables = (indexed,) if streamed is indexed else (indexed, streamed)
    hashed = [hash_words(text_bytes(t.column("words").combine_chunks())) for t in tables]
    owners = [indexed.column("owner").to_numpy(), streamed.column("owner").to_numpy()]
    number = np.unique(np.concatenate(owners), return_inverse=True)[1]
    distinct, symbols = np.unique(hashed[0][0], return_inverse=True)
    ends = hashed[0][1][1:]
    lengths = np.diff(hashed[0][1])
    index = FMIndex(np.insert(symbols + 1, ends, 0), ends + np.arange(len(ends)), len(distinct), np.repeat(number[: len(ends)], lengths + 1))
    words, at = hashed[-1]
    place = np.minimum(np.searchsorted(distinct, words), len(distinct) - 1)
    patterns = np.where(distinct[place] == words, place + 1, 0)  # 0: a word that the index lacks
    seg, a, b = matched_windows(index, patterns, at[:-1], np.diff(at), number[len(ends) :], window)
    order = np.argsort(seg, kind="stable")
    seg, a, b = seg[order], a[order].astype(np.int32), b[order].astype(np.int32)
    rows, counts = np.unique(seg, return_counts=True)
    offsets, take = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [*(streamed.column(c).combine_chunks().take(take) for c in ("anchor", "h1", "h2")), pa.ListArray.from_arrays(offsets, pa.array(a)), pa.ListArray.from_arrays(offsets, pa.array(b))],
        names=["anchor", "h1", "h2", "starts", "ends"],
    )


def _stretches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard: anchor, indexed block, streamed block. Anchors of one block share indexes."""
    held: list[pa.Table] = []
    size = 0
    for t in runs(batches, ["anchor", "indexed", "streamed"]):
        anchors, indexed, streamed, block, lengths = (t.column(c).to_numpy() for c in ("anchor", "indexed", "streamed", "block", "length"))
        key = np.stack([anchors, indexed, streamed])
        border = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        sizes = np.add.reduceat(lengths, border)
        blocks = t.column("blocks").to_numpy()[border]
        for s, e, n, cut in zip(border, [*border[1:], len(anchors)], sizes.tolist(), blocks.tolist(), strict=True):
            if e - s < 2:  # an anchor that one segment alone has: its owner has nothing to be found in
                continue
            part = t.slice(s, e - s)
            if cut > 1:
                index_rows, stream_rows = np.flatnonzero(block[s:e] == indexed[s]), np.flatnonzero(block[s:e] == streamed[s])
                if len(index_rows) and len(stream_rows):
                    yield _search(part.take(pa.array(index_rows)), part.take(pa.array(stream_rows)), window)
                continue
            held.append(part)
            size += n
            if size >= SHARD_WORDS:
                whole = pa.concat_tables(held).combine_chunks()
                yield _search(whole, whole, window)
                held, size = [], 0
    if held:
        whole = pa.concat_tables(held).combine_chunks()
        yield _search(whole, whole, window)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "text"):
        total, gone, kept = [], [], []
        for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            total.append(len(words))
            if spans:
                change = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    change[s["a"]] += 1
                    change[s["b"]] -= 1
                stay = np.cumsum(change[:-1]) == 0
                words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _removed(batches):
        sums = [hashlib.sha256(k).hexdigest() for k in text_bytes(batch.column("kept"))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, text_hash and spans (a, b) of words to remove, for the rows of doc_id, text_hash and text that have some."""
    docs = docs.where(F.col("doc_id").isNotNull())
    anchors = store(docs.mapInArrow(lambda it: _anchors(it, window), "anchor long, doc_id long, text_hash long, pos int"), "anchors")
    shared = store(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "shared-anchors")
    places = anchors.join(shared, "anchor").groupBy(*ROW).agg(F.collect_set("pos").alias("places"))
    segments = store(docs.join(places, list(ROW)).select(*ROW, "text", "places").mapInArrow(lambda it: _segments(it, window), SEGMENTS), "segments")
    distinct = segments.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("owner"), F.first("length").alias("length"), F.max("words").alias("words"))
    owners = store(distinct, "owners")

    hot = owners.groupBy("anchor").agg(F.ceil(F.sum("length") / BLOCK_WORDS).cast("int").alias("blocks")).where("blocks > 1")
    dealt = owners.join(store(hot, "hot-anchors"), "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    shards = F.transform(other, lambda o: F.struct(F.col("block").alias("indexed"), o.alias("streamed")))
    shards = F.array_distinct(F.concat(shards, F.transform(other, lambda o: F.struct(o.alias("indexed"), F.col("block").alias("streamed")))))
    dealt = dealt.select("anchor", "h1", "h2", "owner", "length", "words", "blocks", "block", F.explode(shards).alias("shard")).select("*", "shard.*").drop("shard")
    keys = ["anchor", "indexed", "streamed"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys, "owner").mapInArrow(lambda it: _stretches(it, window), STRETCHES)
    stretches = found.groupBy("anchor", "h1", "h2").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    own = store(owners.select("anchor", "h1", "h2", "owner").join(stretches, ["anchor", "h1", "h2"], "left"), "stretches")

    # both sides of this join are read from tables, so that Spark can split a segment that very many documents have
    placed = segments.select("anchor", "h1", "h2", *ROW, "start", "length").join(own, ["anchor", "h1", "h2"])
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b")))
    parts = F.transform(F.arrays_zip("starts", "ends"), lambda z: F.struct((F.col("start") + z["starts"]).alias("a"), (F.col("start") + z["ends"]).alias("b")))
    spans = placed.select(*ROW, F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(parts).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy(*ROW).agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (or their SHA-256).

    A word goes if one of the windows of ``window`` consecutive words that cover it also
    starts in a document with a smaller doc_id; windows are those of the input. Null
    texts have no words. A null doc_id is smaller than none and greater than none: such
    rows keep all words. Rows of one doc_id, with one text or with several, are judged
    each by its own text and are not each other's smaller documents; repeated rows come
    back as often as they are there. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    joined = rows.join(repeated_spans(rows, window), list(ROW), "left").select("doc_id", "text", "spans")
    if digest:
        return joined.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept string")
