"""Exact Jaccard join of word-shingle sets with token-combination prefixes, and the classes it links.

Tokens are hashes of `SHINGLE` consecutive words. One global order holds for all documents: rare tokens before
frequent ones (heavy hitters found over the whole corpus), rare ones by hash, frequent ones by their count, the
least frequent first, so that a passage many documents share fills a prefix only if little else is left. Two sets with
100 |x & y| >= 75 |x | y| share at least k of their first n - ceil(3n/4) + k tokens. The index holds
- the rare tokens of that prefix (k = 1) as single tokens;
- if frequent tokens are needed to fill the prefix, and few: the prefix extended to k = 3, and each combination of
  three of its frequent tokens, for documents of this kind among each other; single frequent tokens only for
  meeting documents of the next kind;
- if many: single frequent tokens.

1. Every row gets a key of its own. Equal sets are one member, named by the least key of its rows.
2. Rare tokens are dealt to hash buckets, seven bytes an entry. There the lists of a token with up to SMALL members become
   pairs, longer ones go on as rows (each different list once).
3. Pairs are verified in two steps: bit maps of two bits or more for each token give an upper bound of the common tokens, and what passes
   is compared by the whole sets. Longer lists are not expanded: each member is verified against a centre. What is linked forms a class.
   The first round takes the FIRST least frequent of a document's frequent tokens, which joins up groups of copies;
   later rounds take every list, but only members of one list in different classes, and the last one, which comes at once where they are few,
   every such pair, so no link between classes is lost.
4. Entries of frequent tokens and of combinations also bound what a set can share if this token (for a combination: these three)
   comes first among the common ones: no more than what follows in the global order. Two entries whose lesser bound falls short of a
   link are not compared, since the pair's first common tokens are another entry of both.

Null and empty texts, and texts of blanks: empty set, linked with nothing, named by their own id. Each row is a document of its own:
repeated rows fall into one class, and of rows that share an id but not a text each links by its own text. A null
doc_id links like any other, but never names a class that holds an id (a class without ids has a null one). Ids may be of any type
that has an order. Ties do not arise: a class is named by its least id. A text is read whole by one task, its words as eight bytes each.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import RollingHash, WordBatch, _G, bucketed, figure, key_join, materialize, mix, ngram_hashes, release, rows_of, sent, step_settings, text_chunks
from pointloom.operators.graph import linked_ids

SHINGLE, K = 5, 3
FREQUENT = 12  # documents, from which a token is of the frequent class
MOST_FREQUENT = 500_000  # at most so many tokens are of that class: 6 MB to each executor; the class only orders tokens
DEFICIT = 2  # at most so many frequent tokens beyond k in an extended prefix that is indexed by combinations
SMALL = 4  # lists up to this length are expanded into pairs at once
FIRST = 3  # frequent tokens of a document that the first round takes
FEW_PAIRS = 100_000  # so few pairs of one list and different classes are compared at once, without the rounds that would make them fewer
GONE = 1_000_000  # at most so many keys of repeated sets, 32 MB, are broadcast
PART = 128  # members of a centre that are verified together, about
BASE = 1.08  # set sizes are kept as powers of this in one byte


def shingle_sets(raw: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = WordBatch(raw, "space")
    h = words.hashes(RollingHash(5))
    grams = ngram_hashes(h, SHINGLE)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            out.append(np.unique(grams[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            out.append(ngram_hashes(h[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(h[:0])
    return out


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(tokens + _G).sum(dtype=np.uint64), mix(tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def bit_map(tokens: np.ndarray) -> bytes:
    """A bit for each token, by its low bits; twice as many bits as tokens, rounded up to a power of two (64 at least)."""
    size = 2 << max(5, (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(bool)).tobytes()


def at_most(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """An upper bound of the common tokens of two sets: the larger map is folded to the smaller."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b, nx, ny = b, a, ny, nx
    b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    both = int(np.bitwise_count(a & b).sum())
    return both + min(nx - int(np.bitwise_count(a).sum()), ny - int(np.bitwise_count(b).sum()))


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bound allows a link."""
    for rows in batches:
        g = [rows.column(c).to_pylist() for c in ("x", "y", "nx", "ny")]
        keep = []
        for i, (x, y, nx, ny) in enumerate(zip(*g, strict=True)):
            most = at_most(x, y, nx, ny)
            if 100 * most >= 75 * (nx + ny - most):
                keep.append(i)
        yield rows.select([c for c in rows.schema.names if c not in ("x", "y", "nx", "ny")]).take(pa.array(keep, pa.int64()))


def heavy(batches: Iterator[pa.RecordBatch], flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(token, cnt) for tokens of two or more different sets among each few million tokens."""

    def counted(sets):
        tokens, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep])], names=["token", "cnt"])

    sets, seen, size = [], set(), 0
    for _, raw in text_chunks(batches):
        for s in shingle_sets(raw):
            if len(s) and (k := set_hash(s)) not in seen:
                seen.add(k)
                sets.append(s)
                size += len(s)
        if size > flush:
            yield counted(sets)
            sets, seen, size = [], set(), 0
    if sets:
        yield counted(sets)


PREFIXES = "u long, k1 long, k2 long, n long, s1 long, s2 long, rare binary, single array<long>, combined array<long>, rest array<int>, mode int, bits binary"


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64), pa.int64()).cast(kind))


def prefixes(frequent_of):
    """A row's key u, its set's size and hashes, and its index entries: rare tokens, single frequent ones, combinations with their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = frequent_of()
        u = TaskContext.get().partitionId() << 40
        for rows, raw in text_chunks(batches):
            cols: list[list] = [[], [], [], [], [], [], [], [], []]
            for s in shingle_sets(raw):
                n = len(s)
                p = n - (3 * n + 3) // 4 + 1 if n else 0
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    often = frequent[at] == s
                    rare, common = s[~often], s[often][np.argsort(rank[at[often]])]
                else:
                    rare, common = s, s[:0]
                single, mode = common[: max(0, p - len(rare))], 0
                combined, rest = s[:0], []
                if len(single):
                    f = p - 1 + K - len(rare)
                    mode = 2 if f - K <= DEFICIT and f <= len(common) else 1
                    if mode == 2:
                        few, triples = common[:f], list(combinations(range(f), K))
                        combined = np.array([mix(mix(mix(few[[a]]) + few[b]) + few[c])[0] for a, b, c in triples], np.uint64)
                        rest = [n - len(rare) - c + K - 1 for _, _, c in triples]
                for col, v in zip(cols, (n, *set_hash(s), rare[:p].tobytes(), single.view(np.int64), combined.view(np.int64), np.array(rest, np.int64), mode, bit_map(s)), strict=True):
                    col.append(v)
            k = len(raw)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.arange(u, u + k)), rows.column("k1"), rows.column("k2"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), _lists(cols[4], pa.int64()), _lists(cols[5], pa.int64()), _lists(cols[6], pa.int32()), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.binary())],
                names=["doc_id", "u", "k1", "k2", "n", "s1", "s2", "rare", "single", "combined", "rest", "mode", "bits"],
            )
            u += k

    return run


def deal(buckets: int, flush: int = 1_500_000):
    """Pack (token, member, size) by bucket of the token: 32 bits of the token beyond its bucket, the member's key as a distance of 16 bits from `base`, the size's power of BASE.

    Two tokens that agree in these bits only add pairs to verify.
    """

    def packed(base: int, held: list[tuple]):
        token, member, n = (np.concatenate(x) for x in zip(*held, strict=True))
        token = mix(token)
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        cols = ((token // np.uint64(buckets)).astype(np.uint32)[order], (member - base).astype(np.uint16)[order], np.minimum(255, np.log(n) / np.log(BASE)).astype(np.uint8)[order])
        out = [(k, base, *(x[lo:hi].tobytes() for x in cols)) for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "base", "token", "member", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, lo, hi = [], 0, 0, 0
        for b in batches:
            u, n = b.column("u").to_numpy(), b.column("n").to_numpy()
            raw = b.column("rare").to_pylist()
            count = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
            token = np.frombuffer(b"".join(raw), np.uint64)
            at = 0
            while at < len(u):  # rows whose keys lie within 16 bits of each other
                first = u[at] if not held else lo
                fits = (u[at:] >= first) & (u[at:] < first + 65536)
                take = len(fits) if fits.all() else int(fits.argmin())
                if take and count[at : at + take].sum():
                    c = count[at : at + take]
                    skip = int(count[:at].sum())
                    if not held:
                        lo = int(first)
                    held.append((token[skip : skip + int(c.sum())], np.repeat(u[at : at + take], c), np.repeat(n[at : at + take], c)))
                    size += int(c.sum())
                at += take
                if held and (size > flush or at < len(u)):
                    yield packed(lo, held)
                    held, size = [], 0
        if held:
            yield packed(lo, held)

    return run


def gather(group: pa.Table) -> pa.Table:
    """Pairs of the short lists of a bucket (list null); members of the long ones with bounds of their sizes, each different list once."""
    token, size = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("token", np.uint32), ("size", np.uint8)))
    member = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int64) + base for x, base in zip(group.column("member").to_pylist(), group.column("base").to_pylist(), strict=True)])
    order = np.lexsort((member, token))
    token, member, size = token[order], member[order], size[order]
    low, high = np.floor(BASE ** size.astype(float)).astype(np.int64), np.ceil(BASE ** (size + 1.0)).astype(np.int64)
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(start, len(token)))
    a, b = [], []
    for many in range(2, SMALL + 1):
        s = start[length == many]
        for i, j in combinations(range(many), 2):
            fits = 7 * np.minimum(high[s + i], high[s + j]) >= 3 * (low[s + i] + low[s + j])
            a.append(member[s + i][fits])
            b.append(member[s + j][fits])
    big = length > SMALL
    sums = np.add.reduceat(mix(member.view(np.uint64) + _G), start)
    _, first = np.unique(sums[big], return_index=True)
    which = np.flatnonzero(big)[first]
    rows = np.concatenate([np.arange(start[i], start[i] + length[i]) for i in which] or [np.empty(0, np.int64)]).astype(np.int64)
    pairs = np.unique(np.stack([np.concatenate([*a, member[:0]]), np.concatenate([*b, member[:0]])], 1), axis=0)
    listed, k = np.repeat(sums[which].view(np.int64), length[which]), len(pairs)
    none = np.zeros(k, np.int64)
    return pa.table([pa.array(np.concatenate([listed, none]), mask=np.arange(len(rows) + k) >= len(rows)), pa.array(np.concatenate([member[rows], pairs[:, 0]])), pa.array(np.concatenate([member[rows], pairs[:, 1]])), pa.array(np.concatenate([low[rows], none])), pa.array(np.concatenate([high[rows], none]))], names=["list", "a", "b", "n", "rest"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked (a, b) of rows sorted by (a, part), the row of a itself first in each part."""
    key, centre = None, None
    for rows, raw in text_chunks(batches):
        a, b = [], []
        for x, part, y, s in zip(rows.column("a").to_pylist(), rows.column("part").to_pylist(), rows.column("b").to_pylist(), shingle_sets(raw), strict=True):
            if y == x:
                key, centre = (x, part), s
                continue
            assert key == (x, part)
            at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
            common = int((centre[at] == s).sum())
            if 100 * common >= 75 * (len(s) + len(centre) - common):
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked(pairs: DataFrame, maps: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; ways: into how many parts the members b of the centre a are dealt.

    The pairs alone are exchanged to meet the maps. A text that is needed is exchanged twice: once to take one of its copies, once to its pairs.
    """
    names = ["a", "b", "ways", "a1", "a2", "b1", "b2"]
    one = pairs.repartition(buckets, "a").groupBy("a", "b").agg(F.max("ways").alias("ways"))
    near = one.join(maps.select(F.col("u").alias("a"), F.col("n").alias("nx"), F.col("bits").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2")), "a")
    near = near.join(maps.select(F.col("u").alias("b"), F.col("n").alias("ny"), F.col("bits").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2")), "b")
    near = materialize(near.select(*names, "nx", "ny", "x", "y").mapInArrow(bounded, "a long, b long, ways long, a1 long, a2 long, b1 long, b2 long"))
    keys = near.select(F.explode(F.array(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")))).alias("k")).select("k.*")
    keys._pointloom_figures = {"rows": 2 * rows_of(near)}
    part = F.pmod(F.xxhash64("b"), "ways").alias("part")
    wanted = near.select("a", part, F.col("b").alias("u"), F.col("b1").alias("k1"), F.col("b2").alias("k2")).union(near.select("a", part, F.col("a").alias("u"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).distinct())
    wanted._pointloom_figures = keys._pointloom_figures
    one_text = key_join(texts, keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    rows = one_text.join(sent(wanted), ["k1", "k2"]).select("a", "part", F.col("u").alias("b"), "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
    out = materialize(rows.mapInArrow(verify, "a long, b long"))
    release(near)
    return out


def hidden_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the 128 bits k1, k2 of the text."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))


def _fits(n: str = "n", rest: str = "rest") -> str:
    return f"7 * least({rest}, cr) >= 3 * ({n} + cn)"


def link_sets(sets: DataFrame, texts: DataFrame, rare_bytes: int) -> DataFrame:
    """(id, comp) of the sets (u, n, k1, k2, rare, single, combined, rest, mode, bits) that link: comp is the least key of a class. rare_bytes: a bound of the bytes of all `rare`."""
    buckets = min(50_000, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    maps, drop_maps = bucketed(sets.select("u", "n", "bits", "k1", "k2", "mode", "single", "combined", "rest"), "u", buckets)
    packed = sets.select("u", "n", "rare").mapInArrow(deal(max(1, rare_bytes // 2_400_000)), "bucket long, base long, token binary, member binary, size binary")
    lists = materialize(packed.groupBy("bucket").applyInArrow(gather, "list long, a long, b long, n long, rest long"))
    often = maps.where("mode > 0").select("u", "n", "mode", "single", F.size("single").alias("k"), "combined", "rest")
    rare = lists.where("list IS NOT NULL").select("list", F.col("a").alias("member"), "n", "rest", F.lit(0).alias("mode")).distinct()
    triples = often.where("mode = 2").select(F.explode(F.arrays_zip("combined", "rest")).alias("e"), "u", "n").select(F.col("e.combined").alias("list"), F.col("u").alias("member"), "n", F.col("e.rest").cast("long").alias("rest"), F.lit(0).alias("mode"))
    fixed = materialize(rare.union(triples))

    def singles(rows: DataFrame) -> DataFrame:
        # the single tokens of a set end its prefix: what follows the last one is three quarters of the set, itself included
        e = rows.select("u", "n", "mode", "k", F.posexplode("single").alias("at", "list"))
        return e.select("list", F.col("u").alias("member"), "n", F.expr("(3 * n + 3) div 4 + k - 1 - at").alias("rest"), "mode")

    def centre(*least) -> Column:
        """The member of a list that its others are verified against, least by `least`."""
        names = [f"_{i}" for i in range(len(least))]
        return F.min(F.struct(*(F.lit(x).alias(k) if not isinstance(x, Column) else x.alias(k) for k, x in zip(names, least, strict=True)), F.col("member").alias("centre"), F.col("n").alias("cn"), F.col("rest").alias("cr"))).alias("c")

    def parts(size: str) -> Column:
        return F.ceil(F.col(size) / PART).cast("long").alias("ways")

    some = fixed.union(singles(often.withColumn("single", F.slice("single", 1, FIRST))))
    behind = (F.col("n") - F.col("rest")) / F.col("n")
    # a list of frequent tokens whose members are all indexed by combinations is not needed
    first = some.groupBy("list").agg(F.count("*").alias("size"), F.min("mode").alias("kind"), centre(F.col("mode"), behind, F.xxhash64(F.lit(0), "member"))).where("size > 1 AND kind < 2")
    first = materialize(first.select("list", "size", "c.centre", "c.cn", "c.cr"))
    pairs = some.join(sent(first), "list").where(f"member <> centre AND {_fits()}").select(F.col("centre").alias("a"), F.col("member").alias("b"), parts("size"))
    edges = linked(lists.where("list IS NULL").select("a", "b", F.lit(1).cast("long").alias("ways")).union(pairs), maps, texts, buckets)
    release(first)
    comp, step, entries = None, 0, None
    while True:
        # the classes so far are as good as the links that made them
        known = edges.toDF("q", "r") if comp is None else edges.toDF("q", "r").union(comp.toDF("q", "r"))
        comp = linked_ids(known, materialize, rows_of(edges) + (rows_of(comp) if comp is not None else 0))
        release(edges)
        if step == 3:
            break
        # first all lists, then those whose members were in several classes, with the class of each member
        named = fixed.union(singles(often)) if entries is None else entries.select("list", "member", "n", "rest", "mode")
        named = named.join(sent(comp), F.col("member") == F.col("id"), "left").select("list", "member", "n", "rest", "mode", F.coalesce("comp", "member").alias("comp"))
        each = named.groupBy("list", "comp").agg(F.count("*").alias("size"), F.min("mode").alias("kind"), centre(F.col("mode"), F.xxhash64(F.lit(step + 1), "member")))
        each = each.groupBy("list").agg(F.max(F.struct("size", F.col("comp").alias("main"))).alias("m"), F.sum("size").alias("all"), F.min("kind").alias("kind"), F.count("*").alias("classes"), F.min(F.struct("c", "comp")).alias("c"))
        open_ = each.where("classes > 1 AND kind < 2").select("list", "all", "m.main", "m.size", F.col("c.c.centre"), F.col("c.c.cn"), F.col("c.c.cr"), F.col("c.comp").alias("cc"))
        open_ = materialize(open_, pairs=F.sum((F.col("all") - F.col("size")) * F.col("all")))
        left = figure(open_, "pairs")
        if not left:
            release(open_)
            break
        step = 3 if left <= FEW_PAIRS else step + 1
        before = entries
        entries = materialize(named.join(sent(open_), "list"))
        release(*([before] if before is not None else []), open_)
        if step < 3:
            # verify against another centre, across classes only
            pairs = entries.where(f"member <> centre AND comp <> cc AND {_fits()}").select(F.col("centre").alias("a"), F.col("member").alias("b"), parts("all"))
        else:
            outside = entries.where("comp <> main").select("list", F.col("member").alias("a"), F.col("n").alias("cn"), F.col("rest").alias("cr"), F.col("mode").alias("am"), F.col("comp").alias("ac"))
            met = outside.join(entries.select("list", "main", "member", "n", "rest", "mode", "comp", "all"), "list")
            pairs = met.where(f"comp <> ac AND (comp = main OR a < member) AND {_fits()} AND NOT (am = 2 AND mode = 2)").select("a", F.col("member").alias("b"), parts("all"))
        edges = linked(pairs, maps, texts, buckets)
    drop_maps()
    release(lists, fixed, *([entries] if entries is not None else []))
    return comp


def jaccard_rows(docs: DataFrame) -> DataFrame:
    """For each row doc_id, k1, k2 (of its text), n_shingles, component_id and kept: whether it is the one of its class that stays (the least by id, then by text; its equals stay too).

    Only rows whose set occurs again, or links, meet a table by key. Such tables are broadcast while they are small; beyond, Spark joins by exchange and
    splits the partitions of keys that many rows share.
    """
    spark = docs.sparkSession
    base = hidden_rows(docs)
    top = base.select("text").mapInArrow(heavy, "token long, cnt long").groupBy("token").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= FREQUENT).orderBy(F.desc("cnt"), "token").limit(MOST_FREQUENT)
    with step_settings(spark):
        # the least frequent first; of equal counts the greatest
        found = top.select("token").toArrow().column(0).to_numpy().view(np.uint64)[::-1]
    order = np.argsort(found)
    shared = spark.sparkContext.broadcast((found[order], order.astype(np.int32)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    members = materialize(base.mapInArrow(prefixes(lambda: shared.value), f"doc_id {kind}, {PREFIXES}"), rare=F.sum(F.octet_length("rare").cast("long")))
    shared.destroy()
    again = materialize(members.where("n > 0").groupBy("s1", "s2").agg(F.min("u").alias("rep"), F.count("*").alias("rows")).where("rows > 1").select("s1", "s2", "rep"))
    few = rows_of(again) <= GONE
    joined = members.join(F.broadcast(again) if few else again, ["s1", "s2"], "left")
    sets = joined.where("n > 0 AND (rep IS NULL OR rep = u)")
    sets = sets if few else materialize(sets)
    comp = link_sets(sets, base.select("k1", "k2", "text"), figure(members, "rare") or 0)
    if not few:
        release(sets)
    slim = joined.select("doc_id", "u", "k1", "k2", "n", F.coalesce("rep", "u").alias("set"), F.col("rep").isNotNull().alias("grouped"))
    slim = slim.join(sent(comp), F.col("set") == F.col("id"), "left")
    slim = slim.select("doc_id", "k1", "k2", "n", F.coalesce("comp", "set").alias("comp"), (F.col("grouped") | F.col("comp").isNotNull()).alias("grouped"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    least = materialize(slim.where("grouped").groupBy("comp").agg(F.min(first).alias("first")))
    named = slim.join(sent(least), "comp", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    alone = F.col("first").isNull()
    out = materialize(named.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | kept).alias("kept")))
    release(members, again, comp, least)
    return out


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    return jaccard_rows(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept, and with equal rows (by id and text) once. Texts are not exchanged for it while the keys of what goes fit a broadcast; beyond, few but those that go are."""
    rows = jaccard_rows(docs)
    keys = materialize(rows.groupBy(F.col("doc_id").alias("id"), "k1", "k2").agg(F.count("*").alias("times"), F.max("kept").alias("kept")).where("times > 1 OR NOT kept"))
    again = materialize(keys.where("kept"))
    release(rows)
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"), docs["doc_id"].alias("id"))
    row = row.select("row", "id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    # most rows are in neither group
    once = key_join(row, keys, ["id", "k1", "k2"], "left_anti").select("row.*")
    if not rows_of(again):
        return once
    return once.union(key_join(row, again, ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"]).select("row.*"))
