"""Hashes of words and word sequences of whole texts, in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; longer texts are cut between words.
CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK + 1024), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their order is as good as random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a chunk."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], hash_pieces(raw, edge[::2], edge[1::2])


def hash_pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces of an array of bytes; equal pieces have equal hashes wherever they stand."""
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space."""
    at = 0
    while len(text) - at > CHUNK:
        end = max(text.rfind(w, at, at + CHUNK) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= at:
            rest = [p for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(w, at + CHUNK)) > 0]
            if not rest:
                break
            end = min(rest)
        yield text[at:end]
        at = end
    yield text[at:]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin (one more than texts)."""
    hashes, counts, k = [], np.zeros(len(texts), np.int64), 0
    while k < len(texts):
        if len(texts[k]) > CHUNK:
            for piece in _cut(texts[k]):
                hashes.append(_hash_chunk(piece)[1])
                counts[k] += len(hashes[-1])
            k += 1
            continue
        first, size = k, 0
        while k < len(texts) and size + len(texts[k]) + 1 <= CHUNK + 1:
            size += len(texts[k]) + 1
            k += 1
        starts, h = _hash_chunk(b" ".join(texts[first:k]))
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[first:k]])])
        counts[first:k] = np.diff(np.searchsorted(starts, begins))
        hashes.append(h)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(_ODD) + words[j : j + m]
    return mix(acc)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; with fewer words, the whole sequence as one."""
    words, at = hash_words(texts)
    grams = sequence_hashes(words, n)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(sequence_hashes(words[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def batches_of(batches: Iterator[pa.RecordBatch], text: str, rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded number and bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(batch.num_rows, at + rows, max(at + 1, int(np.searchsorted(ends, before + size))))
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that cut no run of equal keys."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k) for k in keys]
        head, tail = ([c[i].as_py() for c in cols] for i in (0, -1))
        if held and head == last == tail:
            held.append(t)
            continue
        n = t.num_rows
        differs = np.zeros(n, bool)
        for c, v in zip(cols, tail, strict=True):
            differs |= c.combine_chunks().to_numpy(zero_copy_only=False) != v
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut or (held and head != last):
            yield pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks()
            held = []
        held.append(t.slice(cut))
        last = tail
    if held:
        yield pa.concat_tables(held).combine_chunks()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as fewer links that join the same nodes: each node with the least of its component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
