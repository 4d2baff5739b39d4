"""Stupid-backoff scores of documents, computed relationally.

Words are runs without blanks, A-Z in lower case. score(w | context) = c(context w) / c(context) if c(context w) >= MIN_COUNT,
else BACKOFF * the score with one word less of context; score(w) = c(w) / N. A document's own n-grams are counted, so one that
occurs nowhere else has count 1: with MIN_COUNT = 2 only n-grams that occur again count as seen.

Documents are dealt to batches once, in a table bucketed by batch, which no later step exchanges. For each group of orders
(words and pairs, then each longer order by itself) two relational steps follow:

1. Every batch explodes its texts into n-grams and sends each distinct one with its count to the n-gram's hash partition.
   There the counts of all batches add up to the partition's count table, the batches' n-grams are joined to it, and
   the sums go back to the batch. Rows are packed: one holds the n-grams of one batch and one partition, sorted, as differences.
2. An n-gram of three or more words can only reach MIN_COUNT if its first and its last words but one do, so only those are sent.

At last every batch joins the sums to the n-grams of its texts and adds up the logarithms per document. A batch has about
BATCH_BYTES; texts of more than GIANT bytes are cut at blanks into pieces that are dealt like texts of their own, each led by the
words of context before it, and their sums are added up. Only the number of words comes to the driver.

Null and empty texts: no words, log_score 0, mean null. Repeated rows, ids included, count as often as they occur, and all get a score;
equal texts get equal scores. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import RollingHash, WordBatch, bucketed, materialize, ngram_hashes, row_chunks

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
BATCH_BYTES, BUCKET_BYTES = 12 << 20, 24 << 20
PIECE_BYTES, GIANT = 2 << 20, 8 << 20
_BLANK, _BLANKS = re.compile(rb"[\x20\x09-\x0D]"), bytes.maketrans(b"\t\n\v\f\r", b"     ")
_LOW = np.uint64((1 << 40) - 1)


def cut_at_blanks(text: bytes, limit: int, order: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of about `limit` bytes that end before a blank, each led by the order - 1 words before it; and how many words lead."""
    lo, lead = 0, b""
    while lo < len(text):
        end = _BLANK.search(text, lo + limit)
        hi = end.start() if end else len(text)
        yield lead + b" " + text[lo:hi], len(lead.split(maxsplit=order))
        lead = b" ".join((lead + b" " + text[lo:hi]).translate(_BLANKS).rsplit(maxsplit=order - 1)[-(order - 1) :]) if order > 1 else b""
        lo = hi


def cut_giants(limit: int, order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, k, lead): giant texts in pieces. k names the row that they come from: by partition, content and how many equal rows came before, so a task that runs again, in whatever order, gives the same names."""
        seen: Counter = Counter()
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for rows in batches:
            for i, (doc, text) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True)):
                name = hashlib.sha256(f"{doc!r}:{text}".encode()).hexdigest()
                k = f"{part}:{name}:{seen[name]}"
                seen[name] += 1
                for piece, lead in cut_at_blanks(text.encode(), limit, order):
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(i, 1), pa.array([piece.decode()]), pa.array([k]), pa.array([lead], pa.int32())], names=["doc_id", "text", "k", "lead"])

    return run


class Grams:
    """The words of some texts, for each order the hashes of the n-grams that end in each word (within its text), and whether a word leads a piece only (its n-grams are counted in the piece before)."""

    def __init__(self, raw: list[bytes], lead: np.ndarray, order: int):
        self.hash, self.has = [], []
        found, count, rolling = [], np.zeros(len(raw), np.int64), RollingHash(83)
        for lo, hi in row_chunks(np.fromiter(map(len, raw), np.int64, len(raw)), PIECE_BYTES):
            w = WordBatch(raw[lo:hi], "space")
            found.append(w.hashes(rolling))
            count[lo:hi] = w.count
        words = np.concatenate([*found, np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(raw)), count)
        place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
        self.own = place >= lead[self.doc]
        self.text_words = count - lead
        for n in range(1, order + 1):
            h = np.zeros(len(words), np.uint64)
            h[n - 1 :] = ngram_hashes(words, n)
            self.hash.append(h)
            self.has.append(place >= n - 1)


def sort_order(h: np.ndarray) -> np.ndarray:
    """argsort of random 64-bit values: their high bits are sorted together with the place in the low bits, which is several times faster; where high bits tie, plainly."""
    bits = np.uint64(max(1, len(h) - 1).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((h & ~mask) | np.arange(len(h), dtype=np.uint64)) & mask).astype(np.int64)
    s = h[order]
    return order if (s[1:] >= s[:-1]).all() else np.argsort(h)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, index of each row's value)."""
    order = sort_order(h)
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return s[new], at


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: 40 low bits each, and the differences of the high bits in a byte each (255: the difference follows)."""
    high = (keys >> np.uint64(40)).astype(np.int64)
    low = (keys & _LOW).view(np.uint8).reshape(-1, 8)[:, :5]
    return pack_counts(np.diff(high, prepend=0)) + low.T.tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    step, used = unpack_counts(b)
    n = len(step)
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8, 5 * n, used).reshape(5, n).T
    return out.view(np.uint64).ravel() | (np.cumsum(step).astype(np.uint64) << np.uint64(40))


def pack_counts(x: np.ndarray) -> bytes:
    """The number of values, a byte for each, 255 marking a larger one, and the larger ones."""
    big = x[x >= 255]
    return np.array([len(x), len(big)], np.int64).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + big.astype(np.int64).tobytes()


def unpack_counts(b: bytes, offset: int = 0) -> tuple[np.ndarray, int]:
    """(values, offset behind them)."""
    n, k = np.frombuffer(b, np.int64, 2, offset).tolist()
    x = np.frombuffer(b, np.uint8, n, offset + 16).astype(np.int64)
    x[x == 255] = np.frombuffer(b[offset + 16 + n : offset + 16 + n + 8 * k], np.int64)
    return x, offset + 16 + n + 8 * k


def orders_of(group: int) -> list[int]:
    """Group 0 holds words and pairs, group g the n-grams of g + 2 words."""
    return [1, 2] if group == 0 else [group + 2]


def _grams(table: pa.Table, order: int) -> Grams:
    return Grams([x for c in table.column("text").chunks for x in c.cast(pa.binary()).to_pylist()], table.column("lead").to_numpy(), order)


class Counts:
    """Totals of the n-grams of a batch: for each order one number per word."""

    def __init__(self, grams: Grams, found: pa.Table | None):
        self.grams, self.found, self.known = grams, found, {}

    def of(self, n: int) -> np.ndarray:
        """c(n-gram that ends in each word), 0 for n-grams that were not sent, 1 standing for any count below MIN_COUNT of three words or more."""
        if n not in self.known:
            rows = self.found.filter(pa.compute.equal(self.found.column("n"), n)).sort_by("bucket")
            totals = [unpack_counts(x)[0] for x in rows.column("totals").to_pylist()]
            totals = np.concatenate([*totals, np.empty(0, np.int64)])
            ask = self.asked(n)
            out = np.zeros(len(ask), np.int64)
            _, at = distinct(self.grams.hash[n - 1][ask])
            out[ask] = totals[at]
            self.known[n] = out
        return self.known[n]

    def asked(self, n: int) -> np.ndarray:
        """The words whose n-gram is sent: all up to pairs; of the longer ones those with both parts seen."""
        ok = self.grams.has[n - 1]
        if n > 2:
            seen = self.of(n - 1) >= MIN_COUNT
            ok = ok & seen & np.append(False, seen[:-1])[: len(seen)]
        return ok


ASKED = "bucket long, batch long, n int, words long, keys binary, counts binary"
FOUND = "batch long, n int, bucket long, words long, totals binary"


def send(group: int, buckets: int) -> Callable:
    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        """(bucket, batch, n, words, keys, counts): the batch's distinct n-grams of the group's orders, in packed form."""
        batch = key[0].as_py()
        g = _grams(texts, orders_of(group)[-1])
        counts = Counts(g, found)
        bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        rows = []
        for n in orders_of(group):
            asked = counts.asked(n)
            keys, at = distinct(g.hash[n - 1][asked])
            c = np.bincount(at[g.own[asked]], minlength=len(keys))
            cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if hi > lo:
                    rows.append((b, batch, n, int(c[lo:hi].sum()) if n == 1 else 0, pack_keys(keys[lo:hi]), pack_counts(c[lo:hi])))
        cols = zip(*rows, strict=True) if rows else [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "batch", "n", "words", "keys", "counts"])

    return run


def first_send(buckets: int) -> Callable:
    """send() for group 0, which has no counts to read."""
    run = send(0, buckets)
    return lambda key, texts: run(key, texts, None)


def join_bucket(group: pa.Table) -> pa.Table:
    """The count table of a bucket and an order, joined to the n-grams of each batch: (batch, n, bucket, words, totals in the order of the batch's keys)."""
    keys = [unpack_keys(x) for x in group.column("keys").to_pylist()]
    counts = [unpack_counts(x)[0] for x in group.column("counts").to_pylist()]
    _, at = distinct(np.concatenate(keys))
    table = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    totals = np.split(table[at], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table([group.column("batch"), group.column("n"), group.column("bucket"), group.column("words"), pa.array([pack_counts(t) for t in totals], pa.binary())], names=["batch", "n", "bucket", "words", "totals"])


def score(total_words: int, order: int) -> Callable:
    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        """(doc_id, k, n_words, log_score) of the batch's documents and pieces."""
        g = _grams(texts, order)
        counts = Counts(g, found)
        value = np.log(counts.of(1) / max(1, total_words))
        for n in range(2, order + 1):
            c, context = counts.of(n), np.append(1, counts.of(n - 1)[:-1])[: len(g.doc)]
            seen = c >= MIN_COUNT
            value = np.where(seen, np.log(np.where(seen, c, 1) / np.where(seen, context, 1)), np.where(g.has[n - 1], value + np.log(BACKOFF), value))
        logs = np.bincount(g.doc[g.own], value[g.own], len(g.text_words)).astype(np.float64)
        return pa.table([texts.column("doc_id"), texts.column("k"), pa.array(g.text_words), pa.array(logs)], names=["doc_id", "k", "n_words", "log_score"])

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms), mean_log_score of each document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches, buckets = int(total // BATCH_BYTES) + 1, int(total // BUCKET_BYTES) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    giant = F.octet_length("text") > GIANT
    pieces = texts.where(giant).mapInArrow(cut_giants(GIANT, order), f"doc_id {kind}, text string, k string, lead int")
    rows = texts.where(~giant).select("doc_id", "text", F.lit(None).cast("string").alias("k"), F.lit(0).alias("lead")).union(pieces)
    # by the text, so that rows without an id are spread as well
    dealt, drop = bucketed(rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))), "batch", batches)
    found = None
    for group in range(max(1, order - 1)):
        if found is None:
            asked = dealt.groupBy("batch").applyInArrow(first_send(buckets), ASKED)
        else:
            asked = dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(send(group, buckets), ASKED)
        more = materialize(asked.groupBy("bucket", "n").applyInArrow(join_bucket, FOUND))
        if found is None:
            words = more.agg(F.sum("words")).first()[0] or 0
        found = more if found is None else found.union(more)
    scored = materialize(dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(score(words, order), f"doc_id {kind}, k string, n_words long, log_score double"))
    drop()
    whole = scored.where("k IS NOT NULL").groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    out = scored.where("k IS NULL").drop("k").unionByName(whole.drop("k"))
    return out.withColumn("mean_log_score", F.expr("if(n_words > 0, log_score / n_words, null)"))


ORACLE = """
WITH t AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
),
b AS (SELECT doc_id, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM b WHERE u IS NOT NULL GROUP BY u, v, w),
n AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT b.doc_id, CASE
      WHEN c3.c >= 2 THEN ln(c3.c / y.c)
      ELSE CASE WHEN b.u IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN c2.c >= 2 THEN ln(c2.c / x.c) ELSE CASE WHEN b.v IS NULL THEN 0 ELSE ln(0.4) END + ln(o.c / n) END
    END AS s
  FROM b CROSS JOIN n JOIN c1 o ON o.w = b.w LEFT JOIN c1 x ON x.w = b.v LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w
    LEFT JOIN c2 y ON y.v = b.u AND y.w = b.v LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w
)
SELECT d.doc_id, count(s.s) AS n_words, round(coalesce(sum(s.s), 0), 4) AS log_score, round(avg(s.s), 6) AS mean_log_score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
