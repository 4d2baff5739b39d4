"""Secrets in whole texts: an Aho-Corasick keyword prefilter, anchored patterns near its hits, then embedded checksums.

1. One automaton over the lower-cased bytes holds the keywords of all detectors (`password`, `akia`, `ghp_`, `age-secret-key-1` and so on); a second
   one, over the text with each of the bytes 0-9 and a-f written as one class byte, holds the class keyword of a long hexadecimal run, so a run is a
   keyword hit like the others. Texts without a hit, nearly all, are done with that.
2. Each hit names its detectors. A detector's pattern is anchored where the keyword begins (for a run: where the run begins) and is tried there alone. Matches of a
   detector do not overlap: after a match the next hit that counts begins at or behind its end, also if the match fails a later test.
3. Detectors of tokens with an embedded checksum keep only those whose checksum is right: CRC-32 in base 62 at the token's
   end, the double SHA-256 of base 58 key strings, or the six last symbols of bech32 strings.

The three base detectors (assign, access, hex) have no checksum and keep every match of theirs; the others add spans, also inside base
spans. Spans are code points, end exclusive, of the whole match, by start, then in the detectors' order. Patterns are of ASCII bytes only, so the search runs on bytes;
offsets become code points by counting the characters up to each span.

Null and empty texts have no spans. Repeated rows, and rows that share an id, each give a row; null ids are kept. Ties: spans of
several detectors may begin at one place and are all given. A very long text is read whole by one task, with memory of a few times
its size. Empty tables give an empty result. Other columns are ignored by find_secrets, whatever their names, and carried untouched by redact_secrets.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import docs_of, text_chunks

# Alphabets and constants of public checksum formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_base62(token: bytes) -> bool:
    """The last six characters are the CRC-32 of those between the prefix and them, in base 62 with leading zeros."""
    body, want = token[4:-6], token[-6:].decode()
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == want


def base58_check(token: bytes) -> bool:
    """The last four of the decoded bytes begin the double SHA-256 of the others."""
    value = 0
    for c in token.decode():
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(token: bytes) -> bool:
    """The polynomial of the human-readable part and the data has remainder 1."""
    text = token.decode().lower()
    name, _, data = text.rpartition("1")
    if not name or any(c not in BECH32 for c in data):
        return False
    rest = 1
    for v in [*(ord(c) >> 5 for c in name), 0, *(ord(c) & 31 for c in name), *map(BECH32.index, data)]:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            rest ^= step * (top >> i & 1)
    return rest == 1


@dataclass(frozen=True)
class Detector:
    """A kind of secret: keywords (lower case) that every match begins with, the pattern anchored there, a least length of a group, a checksum."""

    kind: str
    keywords: tuple[str, ...]
    pattern: bytes
    group: int = 0
    least: int = 1
    check: Callable[[bytes], bool] | None = None
    run: int = 0  # instead of keywords: the least length of a run of hexadecimal digits that counts as one


BASE_DETECTORS = (
    Detector("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), rb"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", group=2, least=6),
    Detector("access", ("akia",), rb"AKIA[A-Z0-9]+", least=20),
    Detector("hex", (), rb"[0-9a-f]+", least=24, run=24),
)
CHECKED_DETECTORS = (
    Detector("forge_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", check=crc_base62),
    Detector("package_token", ("npm_",), rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", check=crc_base62),
    Detector("wallet_key", ("xprv",), rb"xprv[1-9A-HJ-NP-Za-km-z]{100,112}(?![A-Za-z0-9])", check=base58_check),
    Detector("age_key", ("age-secret-key-1",), rb"AGE-SECRET-KEY-1[0-9A-Z]{58}(?![A-Za-z0-9])", check=bech32_check),
    Detector("note_key", ("nsec1",), rb"nsec1[0-9a-z]{58}(?![A-Za-z0-9])", check=bech32_check),
)
DETECTORS = BASE_DETECTORS + CHECKED_DETECTORS

_CLASS = bytes(1 if b in b"0123456789abcdef" else 0 for b in range(256))  # hexadecimal digits as one class byte
SPAN = "struct<kind:string,start:long,end:long>"


class Scanner:
    """The automata and compiled patterns of a tuple of detectors; one in a process."""

    def __init__(self, detectors: tuple[Detector, ...]):
        self.detectors = detectors
        self.patterns = [re.compile(d.pattern) for d in detectors]
        self.kinds = [d.kind for d in detectors]
        self.words = self.automaton([(k, i) for i, d in enumerate(detectors) for k in d.keywords])
        self.runs = self.automaton([("\1" * d.run, i) for i, d in enumerate(detectors) if d.run])

    @staticmethod
    def automaton(keywords: list[tuple[str, int]]):
        of: dict[str, list[int]] = {}
        for word, i in keywords:
            of.setdefault(word, []).append(i)
        if not of:
            return None
        a = ahocorasick.Automaton()
        for word, which in of.items():
            a.add_word(word, (len(word), which))
        a.make_automaton()
        return a

    def hits(self, raw: bytes) -> list[list[int]]:
        """Where each detector's keywords begin, ascending; of a run only its first place."""
        out: list[list[int]] = [[] for _ in self.detectors]
        if self.words is not None:
            for end, (size, which) in self.words.iter(raw.lower().decode("latin-1")):
                for i in which:
                    out[i].append(end + 1 - size)
        if self.runs is not None:
            before: dict[int, int] = {}
            for end, (size, which) in self.runs.iter(raw.translate(_CLASS).decode("latin-1")):
                for i in which:
                    if before.get(i) != end - 1:
                        out[i].append(end + 1 - size)
                    before[i] = end
        for places in out:
            places.sort()  # keywords of different lengths may end in another order than they begin
        return out

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, detector, end) in bytes, sorted."""
        out = []
        for i, (d, places) in enumerate(zip(self.detectors, self.hits(raw), strict=True)):
            free, at = 0, 0
            while at < len(places):
                m = self.patterns[i].match(raw, places[at])
                if m is None:
                    at += 1
                    continue
                free = m.end()
                if len(m.group(d.group)) >= d.least and (d.check is None or d.check(m.group())):
                    out.append((m.start(), i, free))
                at = bisect_left(places, free, at + 1)
        return sorted(out)


@functools.cache
def scanner(detectors: tuple[Detector, ...]) -> Scanner:
    return Scanner(detectors)


def code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte offset; the text is decoded once, from place to place."""
    out, chars, at = {}, 0, 0
    for p in sorted(set(places)):
        chars += len(raw[at:p].decode("utf-8"))
        out[p], at = chars, p
    return out


def scan(detectors: tuple[Detector, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(detectors)
        for rows, raw in text_chunks(batches):
            spans = []
            for text in raw:
                mine = found.spans(text) if text else []
                at = code_points(text, [p for s, _, e in mine for p in (s, e)])
                spans.append([{"kind": found.kinds[i], "start": at[s], "end": at[e]} for s, i, e in mine])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names if c != "text"), pa.array(spans, kind)], names=[*(c for c in rows.schema.names if c != "text"), "secrets"])

    return run


def find_secrets(docs: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end), of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs_of(docs).mapInArrow(scan(detectors), f"doc_id {kind}, secrets array<{SPAN}>")


def redact_secrets(docs: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """docs with each stretch that spans cover replaced in text by [SECRET]; stretches that meet or overlap are one. Null texts stay null."""
    columns = docs.columns
    at = columns.index("text")
    kept = [f for i, f in enumerate(docs.schema.fields) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(detectors)
        for rows, raw in text_chunks(batches):
            null, out = rows.column("text").is_null().to_pylist(), []
            for text, gone in zip(raw, null, strict=True):
                pieces, end = [], 0
                for s, _, e in found.spans(text) if text else []:
                    if s > end or not pieces:
                        pieces += [text[end:s], b"[SECRET]"]
                    end = max(end, e)
                out.append(None if gone else b"".join([*pieces, text[end:]]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    rows = docs.select(F.struct(*(F.col(f.name).alias(f"c{i}") for i, f in enumerate(kept))).alias("row") if kept else F.struct(F.lit(0).alias("c")).alias("row"), "text")
    out = rows.mapInArrow(run, rows.schema)
    names = iter([F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(kept)])
    return out.select(*(F.col("text") if c == "text" else next(names) for c in columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (all of them) of every document."""
    base = [d.kind for d in BASE_DETECTORS]
    count = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base]
    return find_secrets(docs).select("doc_id", *count, F.sha2(_joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
