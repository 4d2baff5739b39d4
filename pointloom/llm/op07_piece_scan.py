"""SentencePiece encoding and decoding by best-scoring segmentation (max-plus), for texts of any length.

A text's pieces are those of the largest sum of piece scores in the given vocabulary; where several sums are equal, the longest first
piece wins, from the left. White space before the text, escaped blanks and byte fallback are SentencePiece's own, so decoding restores every
text. No piece of the vocabulary holds a blank after another character, so the best path passes between words: the
words of a batch are segmented once each, side by side.

Giant texts are cut into chunks at fixed places, wherever they fall. A chunk's transfer matrix gives the best score from each
state at its left boundary (bytes of it that a piece from before takes) to each at its right. Matrices are combined in the
max-plus algebra, which is associative: two by two to one matrix for each block of chunks, from these to the best score from every state at a block's end to
the text's end, and from that to every boundary within a block. With these scores each chunk is traced back on its own, for
every state it may be entered in, and the states are then followed from chunk to chunk.

The vocabulary's path is a parameter. Null and empty texts: no pieces. Repeated rows get equal results. An empty table gives an empty result. Other
columns are ignored, or carried where they are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import RollingHash, materialize, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 1 << 16  # bytes from which a text is cut
CHUNK = 1 << 14
BLOCK = 64  # chunks whose matrices one task combines
LONG_WORD = 64  # bytes from which a word is segmented alone
_BITS = 20
NONE = -np.inf


@dataclass
class Vocabulary:
    pieces: list[bytes]  # by id, blanks as 0x20
    scores: np.ndarray
    byte_ids: np.ndarray
    normal: list[int]
    lookup: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [b""] * n
        byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                byte_ids[value] = i
                pieces[i] = bytes([value])
        for i in normal:
            pieces[i] = sp.id_to_piece(i).replace("▁", " ").encode()
        return Vocabulary(pieces, np.array([sp.get_score(i) for i in range(n)]), byte_ids, normal).ready()

    def ready(self) -> Vocabulary:
        self.lookup = {self.pieces[i]: i for i in self.normal}
        self.longest = max(map(len, self.lookup))
        self.unknown = float(self.scores[self.normal].min()) - 10  # of a character without a piece
        self.splits = not any(b" " in p.lstrip(b" ") for p in self.lookup)
        assert self.splits and min(self.byte_ids) >= 0, "the vocabulary needs byte pieces, and no blank inside a piece"
        self.rolling = RollingHash(61)
        buf = np.frombuffer(b"".join(self.pieces[i] for i in self.normal), np.uint8)
        size = np.array([len(self.pieces[i]) for i in self.normal])
        end = np.cumsum(size)
        h = self.rolling.ranges(self.rolling.prefix(buf), end - size, end)
        self.order = np.argsort(h)
        self.keys, self.ids = h[self.order], np.array(self.normal, np.int32)[self.order]
        slot = (self.keys >> np.uint64(64 - _BITS)).astype(np.int64)
        self.table = np.full(1 << _BITS, -1, np.int32)  # a slot's only piece; -2: several
        count = np.bincount(slot, minlength=1 << _BITS)
        self.table[slot] = np.arange(len(slot))
        self.table[count > 1] = -2
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -1 for none."""
        at = self.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        several = np.flatnonzero(at == -2)
        if len(several):
            at[several] = np.minimum(np.searchsorted(self.keys, h[several]), len(self.keys) - 1)
        return np.where((at >= 0) & (self.keys[np.maximum(at, 0)] == h), self.ids[np.maximum(at, 0)], -1)

    # ---- one text, from a given value at each place behind it ----

    def edges(self, buf: bytes, i: int):
        """(length, id or -1 for a character in bytes, score) of the pieces that begin at i."""
        size = _char_size(buf[i])
        single = False
        for n in range(1, min(self.longest, len(buf) - i) + 1):
            k = self.lookup.get(buf[i : i + n])
            if k is not None:
                single |= n == size
                yield n, k, self.scores[k]
        if not single and size:
            yield size, -1, self.unknown

    def values(self, buf: bytes, n: int, behind: np.ndarray) -> tuple[np.ndarray, list]:
        """Best value (and the edge to it) from each place below n; behind[b]: the value at n + b, any trailing axes."""
        v = np.full((n + len(behind), *behind.shape[1:]), NONE)
        v[n:] = behind
        how: list = [None] * n
        for i in range(n - 1, -1, -1):
            for size, k, s in self.edges(buf, i):
                if i + size < len(v):
                    w = s + v[i + size]
                    if behind.ndim == 1:
                        if w >= v[i] and w > NONE:
                            v[i], how[i] = w, (size, k)
                    else:
                        v[i] = np.maximum(v[i], w)
        return v, how

    def path(self, buf: bytes, how: list, at: int, stop: int) -> tuple[list[int], int]:
        """Ids from a place to the first at or behind stop, and that place."""
        out: list[int] = []
        while at < stop:
            size, k = how[at]
            out.extend([k] if k >= 0 else self.byte_ids[list(buf[at : at + size])].tolist())
            at += size
        return out, at

    def encode_one(self, buf: bytes) -> list[int]:
        _, how = self.values(buf, len(buf), np.zeros(1))
        return self.path(buf, how, 0, len(buf))[0]

    # ---- the words of many texts ----

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids laid end to end, number of ids of each text, total score of each text). The texts have their leading blank."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        buf = np.frombuffer(b"".join(texts), np.uint8)
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        blank = buf == 32
        begin = np.zeros(len(buf), bool)
        begin[1:] = blank[1:] & ~blank[:-1]
        text_start = np.cumsum(lens) - lens
        begin[text_start[lens > 0]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(buf))
        prefix = self.rolling.prefix(buf)
        h = self.rolling.ranges(prefix, start, end)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        ids, count, score = self._words(buf, prefix, start[first], end[first])
        at = np.cumsum(count) - count
        n = count[which]
        take = np.arange(int(n.sum())) + np.repeat(at[which] - (np.cumsum(n) - n), n)
        doc = np.searchsorted(text_start + lens, start, "right")
        return ids[take], np.bincount(doc, n, len(texts)).astype(np.int64), np.bincount(doc, score[which], len(texts))

    def _words(self, buf, prefix, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids, score) of distinct words: best values from every word's end backwards, words side by side."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        long = int((size > LONG_WORD).sum())
        s, e, n = start[order[long:]], end[order[long:]], size[order[long:]]
        most = int(n[0]) if len(n) else 0
        value = np.full((most + 1, len(n)), NONE)
        value[0] = 0
        step, piece = np.zeros((most + 1, len(n)), np.int32), np.full((most + 1, len(n)), -1, np.int32)
        sizes = _CHAR_SIZE[buf]
        for d in range(1, most + 1):
            m = int(np.searchsorted(-n, -d, "right"))
            at = e[:m] - d
            char = sizes[at]
            single = np.zeros(m, bool)
            head = np.flatnonzero(char > 0)  # pieces begin at characters only
            for k in range(1, min(d, self.longest) + 1):
                ids = self.find(self.rolling.ranges(prefix, at[head], at[head] + k))
                hit = ids >= 0
                if not hit.any():
                    continue
                who, ids = head[hit], ids[hit]
                single[who] |= char[who] == k
                v = self.scores[ids] + value[d - k, who]
                better = (v >= value[d, who]) & (v > NONE)
                who = who[better]
                value[d, who], step[d, who], piece[d, who] = v[better], k, ids[better]
            rest = np.flatnonzero((char > 0) & ~single & (char <= d))
            v = self.unknown + value[d - char[rest], rest]
            better = (v > value[d, rest]) | ((v == value[d, rest]) & (char[rest] > step[d, rest]) & (v > NONE))
            rest = rest[better]
            value[d, rest], step[d, rest], piece[d, rest] = v[better], char[rest], -1
        total = np.empty(len(size))
        words: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        rank: list[np.ndarray] = []
        if len(n):
            d, live, turn = n.copy(), np.arange(len(n)), 0
            while len(live):
                k = piece[d[live], live]
                known = k >= 0
                words.append(k[known])
                owner.append(order[long:][live[known]])
                rank.append(np.full(int(known.sum()), turn))
                turn += 1
                raw = live[~known]
                for b in range(4):
                    more = raw[step[d[raw], raw] > b]
                    words.append(self.byte_ids[buf[e[more] - d[more] + b]])
                    owner.append(order[long:][more])
                    rank.append(np.full(len(more), turn + b))
                turn += 4
                d[live] -= step[d[live], live]
                live = live[d[live] > 0]
            total[order[long:]] = value[n, np.arange(len(n))]
        for i in order[:long]:
            body = buf[start[i] : end[i]].tobytes()
            v, how = self.values(body, len(body), np.zeros(1))
            got = np.array(self.path(body, how, 0, len(body))[0], np.int32)
            total[i] = v[0]
            words.append(got)
            owner.append(np.full(len(got), i))
            rank.append(np.arange(len(got)))
        ids, owner_, rank_ = np.concatenate(words), np.concatenate(owner), np.concatenate(rank)
        place = np.lexsort((rank_, owner_))
        return ids[place].astype(np.int32), np.bincount(owner_, minlength=len(size)), total

    def decode(self, ids) -> bytes:
        """The text of the ids, without the blank that encoding puts before it."""
        out = b"".join([self.pieces[i] for i in ids])
        return out[1:] if out[:1] == b" " else out


_CHAR_SIZE = np.zeros(256, np.int64)
_CHAR_SIZE[:128], _CHAR_SIZE[192:224], _CHAR_SIZE[224:240], _CHAR_SIZE[240:248] = 1, 2, 3, 4


def _char_size(byte: int) -> int:
    return int(_CHAR_SIZE[byte])


def escaped(raw: bytes) -> bytes:
    return b" " + raw if raw else raw


# ---- chunks of giant texts ----


def parts(body: bytes, n: int, states: int) -> tuple[int, int] | None:
    """The first and last place in states..n where the best path must pass; None where there is none."""
    cuts = [i for i in range(max(1, states), n) if body[i] == 32 and body[i - 1] != 32]
    return (cuts[0], cuts[-1]) if cuts else None


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def chunk_matrix(v: Vocabulary, body: bytes, n: int) -> np.ndarray:
    """Best scores from each state at the left (pieces begin at 0..longest-1) to each at the right. body: n bytes and some that follow."""
    states = v.longest
    behind = np.where(np.eye(states, dtype=bool), 0.0, NONE)
    cut = parts(body, n, states)
    if cut is None:
        # whole chunk, for all states at the right at once
        out = v.values(body, n, behind)[0]
        full = np.full((states, states), NONE)
        full[: min(states, len(out))] = out[:states]
        return full
    a, b = cut
    head, _ = v.values(body[:a], a, np.zeros(1))
    tail, _ = v.values(body[b:], n - b, behind)
    return head[:states, None] + v.encode_batch([body[a:b]])[2][0] + tail[0][None, :]


def chunk_trace(v: Vocabulary, body: bytes, n: int, behind: np.ndarray) -> tuple[list[list[int]], list[int], list[int]]:
    """(ids up to where the paths from each left state meet, ids behind that, right state of each). behind: best score from each right state to the text's end."""
    states = v.longest
    cut = parts(body, n, states)
    if cut is None:
        val, how = v.values(body, n, behind)
        got = [v.path(body, how, s, n) if s >= n or (s < n and how[s] is not None) else ([], n) for s in range(states)]
        return [g[0] for g in got], [], [g[1] - n for g in got]
    a, b = cut
    _, how = v.values(body[:a], a, np.zeros(1))
    heads = [v.path(body[:a], how, s, a)[0] if how[s] is not None else [] for s in range(states)]
    _, end = v.values(body[b:], n - b, behind)
    last, at = v.path(body[b:], end, 0, n - b)
    return heads, v.encode_batch([body[a:b]])[0].tolist() + last, [at - (n - b)] * states


def encode_giant(v: Vocabulary, buf: bytes, chunk: int = CHUNK) -> list[int]:
    """All steps for one text in one place (the distributed form is giant_documents)."""
    pieces = [(buf[i : i + chunk + v.longest], min(chunk, len(buf) - i)) for i in range(0, len(buf), chunk)]
    behind = boundary_values([chunk_matrix(v, b, n) for b, n in pieces])
    return follow([chunk_trace(v, b, n, r) for (b, n), r in zip(pieces, behind, strict=True)])


def product_of(matrices: list[np.ndarray]) -> np.ndarray:
    """One matrix for a run of chunks: neighbors combined two by two until one is left."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def boundary_values(matrices: list[np.ndarray], end: np.ndarray | None = None) -> list[np.ndarray]:
    """For each chunk, the best score from each state at its right to the end of the text: a suffix scan of max-plus products. end: the scores behind the last one."""
    states = matrices[0].shape[0]
    r = np.full((states, 1), NONE)
    r[0] = 0
    if end is not None:
        r = end[:, None]
    out = []
    for m in reversed(matrices):
        out.append(r[:, 0])
        r = combine(m, r)
    return out[::-1]


def follow(traces) -> list[int]:
    out: list[int] = []
    state = 0
    for heads, rest, right in traces:
        out.extend(heads[state])
        out.extend(rest)
        state = right[state]
    return out


DIGEST = "n_tokens long, ids_sha256 string, round_trip boolean"


def _digest(v: Vocabulary, ids: np.ndarray, raw: bytes) -> tuple[int, str, bool]:
    return len(ids), hashlib.sha256(np.asarray(ids, "<i4").tobytes()).hexdigest(), v.decode(ids.tolist()) == raw


def encode_rows(vocab_of, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab_of()
        for rows, raw in text_chunks(batches):
            ids, count, _ = v.encode_batch([escaped(x) for x in raw])
            at = np.concatenate([[0], np.cumsum(count)])
            if ids_too:
                cols, names = [pa.ListArray.from_arrays(at.astype(np.int32), ids)], ["ids"]
            else:
                done = [_digest(v, ids[a:b], x) for a, b, x in zip(at[:-1], at[1:], raw, strict=True)]
                cols, names = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)], ["n_tokens", "ids_sha256", "round_trip"]
            yield pa.RecordBatch.from_arrays([rows.column("row"), *cols], names=["row", *names])

    return run


def _cut_chunks(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in text_chunks(batches):
            for i, x in enumerate(raw):
                b = escaped(x)
                starts = range(0, len(b), CHUNK)
                yield pa.RecordBatch.from_arrays([rows.column("row").take(pa.array([i] * len(starts))), rows.column("k").take(pa.array([i] * len(starts))), pa.array(range(len(starts)), pa.int32()), pa.array([b[j : j + CHUNK + longest] for j in starts], pa.binary()), pa.array([min(CHUNK, len(b) - j) for j in starts], pa.int32())], names=["row", "k", "c", "body", "n"])

    return run


def giant_documents(rows: DataFrame, shared, ids_too: bool, kind: str) -> DataFrame:
    """The chunks of giant texts as rows: matrices, the scan per text, and the traces, each over all executors."""
    vocab, longest = shared, shared.value.longest
    # equal texts are one: k is the text's hash
    chunks = rows.dropDuplicates(["k"]).mapInArrow(_cut_chunks(longest), f"row {kind}, k string, c int, body binary, n int").drop("row")

    def matrices(batches):
        for b in batches:
            m = [chunk_matrix(vocab.value, x, n).ravel().tolist() for x, n in zip(b.column("body").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("c"), pa.array(m, pa.list_(pa.float64()))], names=["k", "c", "m"])

    def square(m: pd.Series) -> list[np.ndarray]:
        return [np.array(x).reshape(longest, longest) for x in m]

    def block_product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "b": pdf["b"].iloc[:1], "m": [product_of(square(pdf["m"])).ravel()]})

    def block_scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        return pd.DataFrame({"k": pdf["k"], "b": pdf["b"], "end": boundary_values(square(pdf["m"]))})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        return pd.DataFrame({"k": pdf["k"], "c": pdf["c"], "behind": boundary_values(square(pdf["m"]), np.array(pdf["end"].iloc[0]))})

    def trace(batches):
        for b in batches:
            got = [chunk_trace(vocab.value, x, n, np.array(r)) for x, n, r in zip(b.column("body").to_pylist(), b.column("n").to_pylist(), b.column("behind").to_pylist(), strict=True)]
            heads, rest, right = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("c"), b.column("body"), b.column("n"), pa.array(heads, pa.list_(pa.list_(pa.int32()))), pa.array(rest, pa.list_(pa.int32())), pa.array(right, pa.list_(pa.int32()))], names=["k", "c", "body", "n", "heads", "rest", "right"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        ids = follow(zip(pdf["heads"], pdf["rest"], pdf["right"], strict=True))
        if ids_too:
            return pd.DataFrame({"k": [pdf["k"].iloc[0]], "ids": [ids]})
        raw = b"".join(x[:n] for x, n in zip(pdf["body"], pdf["n"], strict=True))[1:]
        done = _digest(vocab.value, np.array(ids), raw)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n_tokens": [done[0]], "ids_sha256": [done[1]], "round_trip": [done[2]]})

    # a text's chunks in blocks: products of blocks, the scan over these, then over the chunks of each block by itself
    m = materialize(chunks.mapInArrow(matrices, "k string, c int, m array<double>").withColumn("b", F.floor(F.col("c") / BLOCK).cast("int")))
    blocks = m.groupBy("k", "b").applyInPandas(block_product, "k string, b int, m array<double>")
    ends = blocks.groupBy("k").applyInPandas(block_scan, "k string, b int, end array<double>")
    behind = m.join(ends, ["k", "b"]).groupBy("k", "b").applyInPandas(scan, "k string, c int, behind array<double>")
    traced = chunks.join(behind, ["k", "c"]).mapInArrow(trace, "k string, c int, body binary, n int, heads array<array<int>>, rest array<int>, right array<int>")
    done = traced.groupBy("k").applyInPandas(joined, "k string, " + ("ids array<int>" if ids_too else DIGEST))
    return rows.select("row", "k").join(done, "k").drop("k")


def encode_documents(docs: DataFrame, columns: list[str], model: str = MODEL, ids_too: bool = False) -> DataFrame:
    """The named columns with ids, or with n_tokens, ids_sha256 (of little-endian 32-bit ids) and round_trip (decoding gives the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    big = F.octet_length("text") >= GIANT
    extra = "ids array<int>" if ids_too else DIGEST
    small = rows.where(~big).mapInArrow(encode_rows(lambda: shared.value, ids_too), f"row {kind}, {extra}")
    giants = giant_documents(rows.where(big).withColumn("k", F.sha2(F.col("text").cast("binary"), 256)), shared, ids_too, kind)
    names = [x.split()[0] for x in extra.split(", ")]
    return materialize(small.select("row", *names).union(giants.select("row", *names))).select("row.*", *names)


def decode_ids(df: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """df with the text of its ids."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else shared.value.decode(v).decode(errors="replace"))

    return df.withColumn(text, run(F.col(ids)))
