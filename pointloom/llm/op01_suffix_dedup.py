"""Exact removal of long repeated byte strings by suffix arrays.

A window of `length` bytes is repeated if the same bytes also start anywhere else in the corpus. Every window
contains one anchor: the leftmost smallest hash among its 64-byte grams. Windows with the same anchor are
neighbours, so a text falls into segments; equal windows lie in segments with the same anchor gram. Then:

1. Equal texts are grouped; each distinct text is read once, with its number of copies.
2. Segments whose anchor occurs once in the corpus go no further. The others are counted by content (partial
   sums before the exchange). One seen twice is covered whole.
3. Only segments that share an anchor but differ go on, once each. They are dealt to shards by anchor, an
   anchor with more bytes than a shard holds is split over several.
4. Each shard builds a suffix array (Larsson-Sadakane refinement of unsorted groups) and common prefixes
   (Kasai's order, in lanes); neighbours with `length` common bytes are repeated windows.
5. Split anchors are merged: each shard sends the sorted fingerprints of its windows, and the sorted runs are
   searched in each other by binary search.

Hot anchors and contents (copies of one passage) never meet in one task: rows are counted before any join, and the few
keys with more than a thousandth of the rows are salted.

Null and empty texts: no spans (an empty list). Texts shorter than `length` have none. Repeated rows are copies of each other, the id
included. Ties do not arise: every covered byte goes. Very long texts are read in overlapping pieces. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import CHUNK_BYTES, RollingHash, hot_keys, materialize, mix, release, salted_join, text_chunks

LENGTH, GRAM = 400, 64
SHARD_BYTES = 1 << 20  # aimed at
SPLIT_BYTES = 4 << 20  # an anchor with more is split
_PLACE = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.uint64(2**64 - 1))
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(batches: Iterator[pa.RecordBatch], length: int = LENGTH, gram: int = GRAM) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, cnt, s, slen, akey, h): the windows that begin in s..s+slen-length share an anchor.

    Long texts are read in pieces that overlap by length - 1 bytes, so that every window begins in one piece.
    """
    one = RollingHash(11)
    for rows, row, offset, raw in pieces(batches, length - 1):
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lens)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        if len(buf) < length:
            continue
        p1 = one.prefix(buf)
        at = np.arange(len(buf) - gram + 1)
        grams = one.ranges(p1, at, at + gram)
        anchor = (sliding_min((grams & ~_PLACE) | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        doc = np.repeat(np.arange(len(raw)), lens)[: len(anchor)]
        good = at[: len(anchor)] + length <= ends[doc]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        new |= ~good
        first = np.flatnonzero(new & good)
        if not len(first):
            continue
        stops = np.append(np.flatnonzero(new), len(anchor))
        last = stops[np.searchsorted(stops, first, "right")]
        end = last - 1 + length
        d = doc[first]
        pick = pa.array(row[d])
        yield pa.RecordBatch.from_arrays(
            [rows.column("k1").take(pick), rows.column("k2").take(pick), rows.column("cnt").take(pick), pa.array((first - (ends - lens)[d] + offset[d]).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(grams[anchor[first]].view(np.int64)), pa.array(one.ranges(p1, first, end).view(np.int64))],
            names=["k1", "k2", "cnt", "s", "slen", "akey", "h"],
        )


def pieces(batches: Iterator[pa.RecordBatch], overlap: int, limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(rows, row of each piece, its first byte, its bytes): about `limit` bytes at a time, long texts in overlapping pieces."""
    for rows, raw in text_chunks(batches, limit):
        if sum(map(len, raw)) <= 2 * limit:
            yield rows, np.arange(len(raw)), np.zeros(len(raw), np.int64), raw
            continue
        for i, text in enumerate(raw):
            for lo in range(0, max(1, len(text) - overlap), limit):
                yield rows, np.array([i]), np.array([lo]), [text[lo : lo + limit + overlap]]


SEGMENTS = "k1 long, k2 long, cnt long, s int, slen int, akey long, h long"  # akey and h are 128 bits of a segment's content


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """The suffixes in full order (a zero ends the buffer): groups that are not yet sorted are refined by the rank of what follows, with doubled steps, until none is left."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.ones(n + 1, bool)
    head[1:n] = key[1:] != key[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    rank[n] = -1
    h = 8
    while True:
        open_ = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(open_):
            break
        suffixes = sa[open_]
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + h, n)] + 1
        order = np.argsort(key, kind="stable")
        key, sa[open_] = key[order], suffixes[order]
        head[open_[1:]] |= key[1:] != key[:-1]
        rank[sa[open_]] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        h *= 2
    return sa


def common_prefixes(buf: np.ndarray, sa: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """lcp[r]: bytes, at most cap, that suffix sa[r] shares with sa[r-1], sa being in full order. Kasai's order of text places, where the value falls by one at most, in lanes of consecutive places that advance together."""
    n = len(buf)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    padded = np.concatenate([buf, np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    plcp = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for t in range(lane):
        at = starts + t
        at = at[at < n]
        h = np.maximum(h[: len(at)] - 1, 0)
        other = before[at]
        h[other < 0] = 0
        live = np.flatnonzero(other >= 0)
        while len(live):
            i, j, k = at[live], other[live], h[live]
            same = words[i + k] == words[j + k]
            equal = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            h[live] = np.minimum(k + equal, np.minimum(cap, n - np.maximum(i, j)))
            live = live[(equal == 8) & (h[live] < np.minimum(cap, n - np.maximum(i, j)))]
        plcp[at] = h
    return plcp[sa]


def shard_windows(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, class, size): the windows of the parts laid end to end, with a class for each content and the class's size."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    buf = np.frombuffer(b"".join(parts), np.uint8)
    sa = suffix_array(buf)
    lcp = common_prefixes(buf, sa, length)
    ends = np.repeat(np.cumsum(lens), lens)
    kind = np.cumsum(lcp < length)
    whole = sa + length <= ends[sa]
    size = np.bincount(kind[whole], minlength=kind[-1] + 1)
    return sa[whole], kind[whole], size[kind[whole]]


def _runs(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last): maximal runs of places within a part."""
    places = np.sort(places)
    if not len(places):
        return places, places, places
    part = np.searchsorted(starts, places, "right") - 1
    cut = np.ones(len(places), bool)
    cut[1:] = (np.diff(places) != 1) | (part[1:] != part[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(places)) - 1
    return part[first], places[first] - starts[part[first]], places[last] - starts[part[first]]


FOUND = "akey long, h long, lo int, hi int, shard long, f1 long, f2 long"


def search_shard(group: pa.Table) -> pa.Table:
    """Windows of one shard that repeat in it (f1 null), and of split anchors the others and one of each class with their fingerprints."""
    g = group.to_pydict()
    parts, akey, h = g["bytes"], np.array(g["akey"], np.int64), np.array(g["h"], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[:-1]
    place, kind, size = shard_windows(parts)
    part, lo, hi = _runs(place[size > 1], starts)
    f1, f2 = np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64)
    known = len(part)
    if g["split"][0]:
        one, two = RollingHash(11), RollingHash(23)
        buf = np.frombuffer(b"".join(parts), np.uint8)
        q = np.sort(place)
        o = np.searchsorted(starts, q, "right") - 1
        part, lo, hi = np.concatenate([part, o]), np.concatenate([lo, q - starts[o]]), np.concatenate([hi, q - starts[o]])
        f1 = np.concatenate([f1, one.ranges(one.prefix(buf), q, q + LENGTH)])
        f2 = np.concatenate([f2, two.ranges(two.prefix(buf), q, q + LENGTH)])
    own = np.arange(len(part)) < known
    return pa.table(
        [pa.array(akey[part]), pa.array(h[part]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.full(len(part), g["shard"][0], np.int64)), pa.array(f1.view(np.int64), mask=own), pa.array(f2.view(np.int64), mask=own)],
        names=["akey", "h", "lo", "hi", "shard", "f1", "f2"],
    )


def merge_runs(group: pa.Table) -> pa.Table:
    """Of the sorted fingerprints of several shards, the windows found in another shard by binary search."""
    f = group.column("f1").to_numpy().view(np.uint64) ^ mix(group.column("f2").to_numpy().view(np.uint64))
    shard = group.column("shard").to_numpy()
    found = np.zeros(len(f), bool)
    runs = {k: np.unique(f[shard == k]) for k in np.unique(shard)}
    for k, run in runs.items():
        mine = np.flatnonzero(shard == k)
        for other, sorted_run in runs.items():
            if other != k and len(sorted_run):
                at = np.minimum(np.searchsorted(sorted_run, f[mine]), len(sorted_run) - 1)
                found[mine] |= sorted_run[at] == f[mine]
    return group.filter(pa.array(found)).select(["akey", "h", "lo", "hi"])


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each text's spans and take them out: (k1, k2, n_removed, n_spans, kept_sha256, spans)."""
    for batch in batches:
        out: list[tuple] = []
        for text, lo, hi in zip(batch.column("text").cast("binary").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
            order = np.argsort(np.array(lo), kind="stable")
            a, b = np.array(lo, np.int64)[order], np.maximum.accumulate(np.array(hi, np.int64)[order])
            new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
            first, last = a[new], b[np.append(new[1:], len(a)) - 1]
            kept = hashlib.sha256()
            at = 0
            for x, y in zip(first.tolist(), last.tolist(), strict=True):
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            out.append((int((last - first).sum()), len(first), kept.hexdigest(), np.stack([first, last], 1).ravel().tolist()))
        n, k, sha, spans = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end, start, end ... in bytes) of each document."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    long = keyed.where(F.col("n_bytes") >= LENGTH)
    texts = materialize(long.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("cnt")))
    every = materialize(texts.mapInArrow(segments, SEGMENTS))
    # anchors that occur again; the hot ones are few by their share of the rows, and no row of theirs is exchanged by its anchor
    anchors = materialize(every.groupBy("akey").agg(F.sum("cnt").alias("n"), F.count("*").alias("rows")).where("n > 1"))
    hot = hot_keys(anchors, "rows", ["akey"])
    cold = every.join(F.broadcast(hot), "akey", "left_anti").join(anchors.select("akey"), "akey", "left_semi")
    segs = materialize(every.join(F.broadcast(hot), "akey", "left_semi").unionByName(cold))
    release(every, anchors)
    kinds = materialize(segs.groupBy("akey", "h").agg(F.sum("cnt").alias("c"), F.count("*").alias("rows"), F.min(F.struct("k1", "k2", "s", "slen")).alias("at")))
    # one segment of a group of copies stands for all of them
    groups = materialize(kinds.groupBy("akey").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum(F.col("at.slen").cast("long")).alias("bytes")).where("n > 1 AND least = 1"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, int(total // SHARD_BYTES))
    ways = F.when(F.col("bytes") > SPLIT_BYTES, F.ceil(F.col("bytes") / F.lit(SPLIT_BYTES / 2))).otherwise(F.lit(1))
    dealt = salted_join(kinds, groups.select("akey", ways.cast("long").alias("ways"), "n"), ["akey"], hot_keys(groups, "n", ["akey"]), "h")
    open_ = dealt.select("akey", "h", "at.*", (F.col("ways") > 1).alias("split"), F.when(F.col("ways") > 1, F.xxhash64("akey", F.pmod("h", "ways"))).otherwise(F.pmod("akey", F.lit(shards))).alias("shard"))
    wanted = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "slen", "akey", "h", "split", "shard")).alias("w"))
    raw = wanted.join(texts.select("k1", "k2", "text"), ["k1", "k2"]).select(F.col("text").cast("binary").alias("raw"), "w")
    parts = raw.select("raw", F.explode("w").alias("w")).select("w.shard", "w.split", "w.akey", "w.h", F.expr("substring(raw, w.s + 1, w.slen)").alias("bytes"))
    found = materialize(parts.groupBy("shard", "split").applyInArrow(search_shard, FOUND))
    merged = found.where("f1 IS NOT NULL").groupBy("akey", F.pmod("f1", F.lit(64)).alias("part")).applyInArrow(merge_runs, "akey long, h long, lo int, hi int")
    partial = found.where("f1 IS NULL").select("akey", "h", "lo", "hi").union(merged)
    answers = materialize(kinds.where("c > 1").select("akey", "h", F.lit(0).alias("lo"), F.expr(f"at.slen - {LENGTH}").alias("hi")).union(partial))
    hot = hot_keys(kinds, "rows", ["akey", "h"])
    spans = salted_join(segs, answers, ["akey", "h"], hot, "k1").select("k1", "k2", F.expr("s + lo").alias("lo"), F.expr(f"s + hi + {LENGTH}").alias("hi"))
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")))
    release(kinds, groups, found, segs, answers)
    cut = materialize(spans.join(texts.select("k1", "k2", "text"), ["k1", "k2"]).mapInArrow(cut_texts, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"))
    release(texts, spans)
    rest = keyed.select("doc_id", "n_bytes", "k1", "k2", F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    out = rest.join(cut.withColumnsRenamed({"k1": "c1", "k2": "c2"}), F.expr("k1 = c1 AND k2 = c2"), "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
