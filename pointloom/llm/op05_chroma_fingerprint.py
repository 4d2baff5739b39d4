"""Chroma fingerprints of audio in a binary media column, and alignment of recordings.

Samples (16-bit, mono) become overlapping frames; the energy of each of twelve pitch classes makes a chroma frame, scaled to
length one. Filters of rectangles over `SPAN` frames, summed by integral images, give two bits each (four levels in Gray
code), packed to one 32-bit integer for every frame a span begins at. A recording is aligned to a query by the
histogram of offsets at which their integers are equal; of all these offsets the one with the most agreeing bits beyond
half of those that overlap counts, among those that match. It is a match where at least `LEAST_OVERLAP` integers overlap and at most
`MOST_ERROR` of their bits differ.

Queries are read in blocks of bounded size, each searched in all recordings. Equal fingerprints are one class, searched once,
and every query but the class's own that matches is given; rows of one class_id are copies of each other.
Null, empty and too short audio: an empty fingerprint, its class, and no match. Repeated rows fall into one class. Ties: the
least offset. A very long recording is held whole by one task. An empty table gives an empty result. Other columns are ignored, whatever their names. `match_recordings` gives the best query alone, the class's own too,
by the bit error of the `TOP_OFFSETS` fullest offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialize

RATE, FRAME, HOP, SPAN = 4000, 512, 128, 12
LEVEL = 0.15  # of a filter's difference, relative to the rectangle's sum, between levels
BLOCK = 2048  # queries at once
TOP_OFFSETS = 3
LEAST_OVERLAP = 2 * SPAN  # integers: two spans without a common frame
MOST_ERROR = 0.25  # share of differing bits
PIECE = 1 << 22  # integers compared at once


def chroma_map(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Pitch class of each frequency of a frame, -1 outside 55 to 1760 Hz."""
    f = np.arange(frame // 2 + 1) * rate / frame
    with np.errstate(divide="ignore"):
        pitch = np.round(12 * np.log2(f / 440.0))
    return np.where((f >= 55) & (f <= 1760), np.mod(np.nan_to_num(pitch, neginf=0), 12), -1).astype(int)


def filters() -> list[tuple]:
    """Sixteen filters (kind, first class, classes, first frame, frames) by rule: each kind of division at several places and sizes."""
    out = []
    for k in range(16):
        kind = k % 4
        height = (4, 6, 8, 12)[(k // 4) % 4]
        width = (4, 8, 12, 12)[(k // 2) % 4]
        out.append((kind, (5 * k) % (13 - height), height, (3 * k) % (SPAN + 1 - width), width))
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, each of length one (or zero, in silence)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    classes = chroma_map()
    out = np.stack([power[:, classes == c].sum(1) for c in range(12)], 1)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0.0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers, one for each place where SPAN frames begin."""
    frames = chroma(samples)
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)
    box = lambda c0, c1, t0, t1: image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]
    out = np.zeros(n, np.uint32)
    for kind, c, h, t, w in filters():
        whole = box(c, c + h, t, t + w)
        if kind == 0:
            part = box(c, c + h // 2, t, t + w)
        elif kind == 1:
            part = box(c, c + h, t, t + w // 2)
        elif kind == 2:
            part = box(c, c + h // 2, t, t + w // 2) + box(c + h // 2, c + h, t + w // 2, t + w)
        else:
            part = box(c, c + h, t + w // 4, t + w - w // 4)
        x = (2 * part - whole) / np.maximum(whole, 1e-9)
        level = (x > -LEVEL).astype(np.uint32) + (x > 0) + (x > LEVEL)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(np.frombuffer((x or b"")[: len(x or b"") // 2 * 2], "<i2").astype(np.float32)) for x in b.column("audio").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array([len(x) for x in fp], pa.int64())], names=["id", "fp", "n_ints"])


_BITS_SET = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def bit_error(a: np.ndarray, b: np.ndarray) -> float:
    x = a ^ b
    return float((_BITS_SET[x & 0xFFFF].astype(int) + _BITS_SET[x >> 16]).sum()) / (32 * max(1, len(x)))


def offsets(fp: np.ndarray, postings: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, offset, hits) of each query and offset at which an integer is equal."""
    value, owner, place = postings
    lo, hi = np.searchsorted(value, fp, "left"), np.searchsorted(value, fp, "right")
    n = hi - lo
    at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
    offset = np.repeat(np.arange(len(fp)), n) - place[at]
    key, hits = np.unique(owner[at] * (1 << 32) + offset + (1 << 31), return_counts=True)
    return key >> 32, (key & 0xFFFFFFFF) - (1 << 31), hits


def align(fp: np.ndarray, ids: np.ndarray, queries: list[np.ndarray], postings: tuple) -> tuple | None:
    """(bit error, query id, offset, hits) of the best query: offset is the recording's place less the query's."""
    q, off, hits = offsets(fp, postings)
    if not len(q):
        return None
    order = np.lexsort((off, -hits, q))
    rank = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
    best = None
    for i in order[rank < TOP_OFFSETS]:
        a, o = queries[q[i]], int(off[i])
        x0, x1 = max(0, o), min(len(fp), o + len(a))
        found = (bit_error(fp[x0:x1], a[x0 - o : x1 - o]), int(ids[q[i]]), o, int(hits[i]))
        if best is None or found[:3] < best[:3]:
            best = found
    return best


def align_all(fp: np.ndarray, own: int | None, ids: np.ndarray, postings: tuple, spelled: np.ndarray, first: np.ndarray) -> list[tuple]:
    """(query id, offset, overlap, hits, bit error) of each query but `own` that matches; `spelled` holds the queries in a row, query i from first[i] on."""
    q, off, hits = offsets(fp, postings)
    x0, x1 = np.maximum(0, off), np.minimum(len(fp), off + first[q + 1] - first[q])
    keep = (x1 - x0 >= LEAST_OVERLAP) & (own is None or ids[q] != own)
    q, off, hits, x0, size = q[keep], off[keep], hits[keep], x0[keep], (x1 - x0)[keep]
    differ = np.zeros(len(q), np.int64)
    piece = np.cumsum(size) // PIECE
    for k in np.unique(piece):
        i = np.flatnonzero(piece == k)
        n, ends = size[i], np.cumsum(size[i])
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        a, b = np.repeat(x0[i], n) + step, np.repeat(first[q[i]] + x0[i] - off[i], n) + step
        differ[i] = np.add.reduceat(np.bitwise_count(fp[a] ^ spelled[b]).astype(np.int64), ends - n)
    i = np.flatnonzero(differ <= MOST_ERROR * 32 * size)
    i = i[np.lexsort((off[i], differ[i] - 16 * size[i], q[i]))]
    i = i[np.unique(q[i], return_index=True)[1]]
    return list(zip(ids[q[i]].tolist(), off[i].tolist(), size[i].tolist(), hits[i].tolist(), (differ[i] / (32 * size[i])).tolist(), strict=True))


def _postings(queries: list[np.ndarray]) -> tuple:
    """(value, query, place) of all integers of the queries, sorted by value."""
    size = np.array([len(x) for x in queries])
    value = np.concatenate(queries)
    owner, place = np.repeat(np.arange(len(queries)), size), np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(value, kind="stable")
    return value[order], owner[order].astype(np.int64), place[order]


PAIRS = pa.schema([("class_id", pa.int64()), ("query_id", pa.int64()), ("offset", pa.int64()), ("overlap", pa.int64()), ("hits", pa.int64()), ("bit_error", pa.float64())])


def search_all(block_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = block_of()
        queries = [np.frombuffer(x, np.uint32) for x in raw]
        postings, spelled, first = _postings(queries), np.concatenate(queries), np.cumsum([0, *map(len, queries)])
        for b in batches:
            for c, own, x in zip(b.column("class_id").to_pylist(), b.column("query").to_pylist(), b.column("fp").to_pylist(), strict=True):
                found = align_all(np.frombuffer(x, np.uint32), own, ids, postings, spelled, first)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([c] * len(found), *zip(*found, strict=True)), PAIRS.types, strict=True)], schema=PAIRS)

    return run


def search(block_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = block_of()
        queries = [np.frombuffer(x, np.uint32) for x in raw]
        postings = _postings(queries)
        for b in batches:
            out = [align(np.frombuffer(x, np.uint32), ids, queries, postings) for x in b.column("fp").to_pylist()]
            keep = [i for i, x in enumerate(out) if x is not None]
            if keep:
                e, q, o, h = zip(*(out[i] for i in keep), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("class_id").take(pa.array(keep)), pa.array(e, pa.float64()), pa.array(q, pa.int64()), pa.array(o, pa.int64()), pa.array(h, pa.int64())], names=["class_id", "bit_error", "query_id", "offset", "hits"])

    return run


def _classes(media: DataFrame, id_: str, audio: str, is_query: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp, n_ints of each row; fp, class_id, query of each class: the least id and the least query's)."""
    prints = materialize(media.select(F.col(id_).cast("long").alias("id"), F.col(audio).alias("audio")).mapInArrow(fingerprints, "id long, fp binary, n_ints long"))
    return prints, materialize(prints.groupBy("fp").agg(F.min("id").alias("class_id"), F.min(F.when(F.expr(is_query), F.col("id"))).alias("query")))


def _searched(classes: DataFrame, run, schema: str) -> DataFrame:
    """Union of the rows that run(block of queries) gives of the classes, for each block."""
    queries = classes.where("query IS NOT NULL AND length(fp) > 0").select("query", "fp").orderBy("query")
    found, block = None, []

    def searched(rows):
        shared = classes.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), [bytes(r[1]) for r in rows]))
        return classes.select("class_id", "query", "fp").mapInArrow(run(lambda: shared.value), schema)

    for row in queries.toLocalIterator():  # a block at a time
        block.append(row)
        if len(block) == BLOCK:
            found = searched(block) if found is None else found.union(searched(block))
            block = []
    if block:
        found = searched(block) if found is None else found.union(searched(block))
    return classes.sparkSession.createDataFrame([], schema) if found is None else found


def match_recordings(media: DataFrame, id_: str = "id", audio: str = "audio", is_query: str = "id % 100 = 0") -> DataFrame:
    """id, n_ints, class_id (least id with the same fingerprint), and of the best query: query_id, offset, hits, bit_error (null without one).

    Queries (is_query, over id) are represented by the least of their ids in each class.
    """
    prints, classes = _classes(media, id_, audio, is_query)
    found = _searched(classes, search, "class_id long, bit_error double, query_id long, offset long, hits long")
    best = found.groupBy("class_id").agg(F.min(F.struct("bit_error", "query_id", "offset", "hits")).alias("b"))
    return prints.join(classes.select("fp", "class_id"), "fp").join(best, "class_id", "left").select("id", "n_ints", "class_id", "b.query_id", "b.offset", "b.hits", "b.bit_error")


def match_pairs(media: DataFrame, id_: str = "id", audio: str = "audio", is_query: str = "id % 100 = 0") -> DataFrame:
    """id, n_ints, class_id (least id with the same fingerprint), query_id, offset, overlap, hits, bit_error: a row for each query
    of another class that the recording matches, or one with nulls.

    Queries (is_query, over id) are represented by the least of their ids in each class.
    """
    prints, classes = _classes(media, id_, audio, is_query)
    found = _searched(classes, search_all, "class_id long, query_id long, offset long, overlap long, hits long, bit_error double")
    return prints.join(classes.select("fp", "class_id"), "fp").join(found, "class_id", "left").select("id", "n_ints", "class_id", "query_id", "offset", "overlap", "hits", "bit_error")


def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recordings of vectors: each number is a note, its pitch by the number's place between the vector's least and largest."""
    t = np.arange(HOP) / RATE
    for b in batches:
        audio = []
        for x in b.column("embedding").to_pylist():
            v = np.array([0.0 if y is None else y for y in x or []], float)
            if not len(v):
                audio.append(b"")
                continue
            spread = v.max() - v.min()
            pitch = np.round((v - v.min()) / (spread if spread > 0 else 1) * 24)
            freq = 220 * 2 ** (pitch / 12)
            phase = np.cumsum(np.concatenate([[0], freq[:-1]])) * HOP / RATE
            audio.append((8000 * np.sin(2 * np.pi * (freq[:, None] * t + phase[:, None]))).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(audio, pa.binary())], names=["vec_id", "audio"])


def recordings(embeddings: DataFrame) -> DataFrame:
    """vec_id, audio: the media column that the query fingerprints."""
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(render, "vec_id long, audio binary")
