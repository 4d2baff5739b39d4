"""Brute-force versions, exact round trips, held-out accuracy, and the edge cases that every operator defines."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import common
from pointloom.llm import op01_suffix_dedup as op1
from pointloom.llm import op02_backoff_scoring as op2
from pointloom.llm import op03_pii_boosting as op3
from pointloom.llm import op04_ngram_jaccard as op4
from pointloom.llm import op05_chroma_fingerprint as op5
from pointloom.llm import op06_toxicity_gru as op6
from pointloom.llm import op07_piece_scan as op7
from pointloom.llm import op08_histogram_sort as op8
from pointloom.llm import op09_language_crf as op9
from pointloom.llm import op10_decontamination as op10

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing extra columns."""
    long = prose(1, 12000)
    rows = [(0, None), (1, ""), (2, " \n "), (3, prose(2, 200)), (4, prose(2, 200)), (5, prose(2, 190)), (5, prose(2, 190)), (6, long), (7, "mail a.b@c.de or 4111 1111 1111 1111 at 1.2.3.4, +1 (555) 123-4567"), (8, "é" * 500), (None, "x y"), (9, long[:5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"), F.lit(1).alias("score"), F.lit("q").alias("k"), F.lit(2).alias("batch"), F.lit(0).alias("shard")).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_windows(spark, odd, none):
    docs = odd.collect()
    raw = [(r.doc_id, (r.text or "").encode()) for r in docs]
    seen = Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    want = []
    for d, b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                hit[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, h in zip(b, hit) if not h)
        want.append((str(d), len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1.suffix_dedup(odd).collect()]
    assert sorted(got) == sorted(want)
    assert op1.suffix_dedup(none).count() == 0


def test_split_anchors_are_merged(spark, monkeypatch):
    base = prose(3, 300)
    docs = spark.createDataFrame([(i, prose(100 + i, 5) + " " + base[: 900 + i] + " " + prose(200 + i, 60)) for i in range(12)], "doc_id long, text string")
    key = lambda df: sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in df.collect())
    whole = key(op1.suffix_dedup(docs))
    monkeypatch.setattr(op1, "SPLIT_BYTES", 1000)
    assert key(op1.suffix_dedup(docs)) == whole


def test_passages_longer_than_the_first_refinements():
    """Parts that share 520 to 700 bytes, with no window of 400 more than brute force finds."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        base = rng.integers(97, 100, 700).astype(np.uint8).tobytes()
        parts = [rng.integers(97, 100, rng.integers(0, 300)).astype(np.uint8).tobytes() + base[: rng.integers(520, 700)] + rng.integers(97, 100, rng.integers(0, 500)).astype(np.uint8).tobytes() for _ in range(4)]
        place, _, size = op1.shard_windows(parts)
        buf, ends = b"".join(parts), np.cumsum([len(x) for x in parts])
        whole = [i for i in range(len(buf) - 399) if np.searchsorted(ends, i, "right") == np.searchsorted(ends, i + 399, "right")]
        seen = Counter(buf[i : i + 400] for i in whole)
        assert sorted(place[size > 1].tolist()) == [i for i in whole if seen[buf[i : i + 400]] > 1]


def test_passages_over_fifty_words_in_many_documents(spark, monkeypatch):
    """A passage that most documents share, one that two share, and texts read in pieces: all of it goes, clean texts stay whole."""
    from pointloom.llm import common

    words = lambda seed, n: " ".join("".join(chr(97 + c) for c in w) for w in np.random.default_rng(seed).integers(0, 26, (n, 8)))
    shared, pair = words(1, 60), words(2, 70)
    texts = [words(100 + i, 300) + " " + shared + " " + words(500 + i, 200) for i in range(60)] + [words(10 + i, 30) + pair + words(20 + i, 5000) for i in range(2)] + [words(900 + i, 200) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def removed():
        return {r.doc_id: (r.n_removed, r.n_spans, r.spans) for r in op1.suffix_dedup(docs).collect()}

    got = removed()
    for i, text in enumerate(texts):
        n, spans, places = got[i]
        inside = shared if i < 60 else pair
        if i < 62:
            at = text.index(inside)
            assert n >= len(inside) and spans == 1 and places[0] <= at and places[1] >= at + len(inside)
        else:
            assert (n, spans, places) == (0, 0, [])
    monkeypatch.setattr(common, "HOT", 20)
    assert removed() == got
    monkeypatch.setattr(op1.pieces, "__defaults__", (3000,))
    raw = [texts[60].encode()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k1": [1], "k2": [2], "cnt": [1], "text": [texts[60]]})
    starts = sorted(x for b in op1.segments(iter([batch])) for s, n in zip(b.column("s").to_pylist(), b.column("slen").to_pylist()) for x in range(s, s + n - 399))
    assert starts == list(range(len(raw[0]) - 399))


def test_suffix_array_and_prefixes():
    buf = np.frombuffer((prose(4, 60) * 3).encode(), np.uint8)
    sa = op1.suffix_array(buf)
    raw = buf.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = op1.common_prefixes(buf, sa, 50, lane=7)
    for r in range(1, len(raw)):
        a, b = raw[sa[r] :], raw[sa[r - 1] :]
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[r] == min(k, 50)


@pytest.mark.parametrize(("order", "small"), [(1, False), (2, True), (3, False), (3, True), (4, True)])
def test_backoff(spark, odd, none, monkeypatch, order, small):
    """Against plain counts; small: with several batches, several hash partitions and long texts in pieces."""
    if small:
        monkeypatch.setattr(op2, "BATCH_BYTES", 12_000)
        monkeypatch.setattr(op2, "BUCKET_BYTES", 15_000)
        monkeypatch.setattr(op2, "GIANT", 7_000)
    words = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] for r in odd.collect()]
    c = Counter(tuple(x[i : i + n]) for x in words for n in range(1, order + 1) for i in range(len(x) - n + 1))
    total = sum(map(len, words))

    def score(g):
        if len(g) == 1:
            return np.log(c[g] / total)
        return np.log(c[g] / c[g[:-1]]) if c[g] >= op2.MIN_COUNT else np.log(op2.BACKOFF) + score(g[1:])

    want = [(len(x), sum(score(tuple(x[max(0, i - order + 1) : i + 1])) for i in range(len(x)))) for x in words]
    got = op2.backoff_scores(odd, order).collect()
    assert np.allclose(sorted((r.n_words, r.log_score) for r in got), sorted(want), atol=1e-6)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    if small:
        assert op2.backoff_scores(none, order).count() == 0


def test_packed_keys_and_counts():
    rng = np.random.default_rng(31)
    for n in (0, 1, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        assert np.array_equal(op2.unpack_keys(op2.pack_keys(keys)), keys)
        x = rng.integers(0, 400, n)
        assert np.array_equal(op2.unpack_counts(b"ab" + op2.pack_counts(x), 2)[0], x)


def test_personal_data(spark, odd, none):
    got = {r.doc_id: r for r in op3.personal_data(odd).collect()}
    r = got[7]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.startswith("email:5:13,ip:40:47,card:17:36,phone:49:66")
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    assert op3.personal_data(none).count() == 0
    text = {x.doc_id: x.text for x in op3.redact(odd).collect()}
    assert text[7] == "mail [EMAIL] or [CARD] at [IP], [PHONE]" and text[0] is None


def plain_base_spans(text):
    """The base spans of one text, by Python's own patterns."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda m: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits(m)))) % 10 == 0
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(m)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_equal_plain_patterns(spark):
    tricky = ["a@b..c@d.ef a@b-.c", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.256 01.02.003.0004", "4111-1111 1111 1111 4111111111111111 5", "++1 (2) 3..4- 5678901 +49 (0)30 1234567", "x@y +1 22", "é" * 70 + " a@é.b a.b@c.de😀+44 20 7946 0958"]
    docs = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, "text"))
    got = {r.doc_id: r for r in op3.personal_data(docs).collect()}
    for r in docs.collect():
        want = plain_base_spans(r.text or "")
        mine = got[r.doc_id]
        assert mine.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), r.text[:200]
        assert (mine.n_email, mine.n_ip, mine.n_card, mine.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in op3.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(mine.spans.split(",")) | {""}


def test_redaction_keeps_other_columns(spark):
    names = ["_t", "_all", "base_email", "added_phone", "cand_ip", "_m", "_e", "_c", "_b", "_p", "row", "a b"]
    docs = spark.createDataFrame([(1, "to a@b.cd, or 1.2.3.4", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    out = op3.redact(docs)
    assert out.columns == docs.columns
    assert tuple(out.first()) == (1, "to [EMAIL], or [IP]", *range(len(names)))


def test_what_base_patterns_miss_is_added(spark):
    hidden = {
        0: ("write to jane (at) example (dot) org today", "jane (at) example (dot) org"),
        1: ("or joe.b [at] mail.example.com, he said", "joe.b [at] mail.example.com"),
        2: ("call (555) 123-4567 now", "(555) 123-4567"),
        3: ("the people there said 555-123-4567, twice", "555-123-4567"),
        4: ("paid by 4111111111111111 12345 then", "4111111111111111"),
    }
    plain = {10: "we meet (at) noon. Then we go", 11: "it was 2024-01-02 10 and dated 02.01.2024", 12: "version 10.20.30 of the code", 13: "from 43.21.141.162 on", 14: "paid by 4111111111111112 12345 then", 15: "order no. 1234-5678-9012"}
    noise = [(100 + i, prose(500 + i, 40)) for i in range(20)]
    base = [(200 + i, f"{prose(600 + i, 10)} a{i}.b@c{i}.com +1 (555) 555-{1000 + i} 10.0.0.{i} {prose(700 + i, 10)}") for i in range(40)]
    for more in (noise, noise + base):  # with and without spans to learn from
        docs = spark.createDataFrame([*((i, t) for i, (t, _) in hidden.items()), *plain.items(), *more], "doc_id long, text string")
        text = {r.doc_id: r.text for r in docs.collect()}
        got = {r.doc_id: r for r in op3.personal_data(docs).collect()}
        spans = {i: [text[i][int(s) : int(e)] for _, s, e in (x.split(":") for x in r.spans.split(",") if x)] for i, r in got.items()}
        assert {i: spans[i] for i in hidden} == {i: [m] for i, (_, m) in hidden.items()}
        assert all(got[i].n_added == 1 for i in hidden) and all(r.n_added == 0 for i, r in got.items() if i not in hidden)


def test_many_matches_keep_their_places(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(1000))
    df = op3.base_spans(spark.createDataFrame([(text,)], "text string"))
    spans = df.select("base_email").first()[0]
    assert [(s.s, s.e) for s in spans] == [m.span() for m in re.finditer(r"\S+", text)]


def brute_classes(rows):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    comp = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return sorted((d, len(s), comp[d]) for d, s in sets)


def test_jaccard(spark, odd, none):
    rng = np.random.default_rng(5)
    base, rows = prose(6, 120).split(), []
    for i in range(40):  # chains of near copies: not all linked with each other
        base = list(base)
        base[rng.integers(120)] = f"w{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, prose(7, 60) + " " + prose(300 + i, 200)) for i in range(12)] + [(200, None), (201, ""), (202, "two words"), (203, "Two  words")]
    got = op4.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_classes(rows)
    assert op4.jaccard_classes(odd).count() == 12 and op4.jaccard_classes(none).count() == 0


@pytest.mark.parametrize("most", [op4.MOST_FREQUENT, 40])
def test_jaccard_with_frequent_tokens(spark, monkeypatch, most):
    """Every token that repeats is of the frequent class, or only the 40 most frequent ones; keys of repeated sets are joined and not broadcast; every key with more than one row in twenty counts as hot."""
    from pointloom.llm import common

    monkeypatch.setattr(op4, "FREQUENT", 2)
    monkeypatch.setattr(op4, "MOST_FREQUENT", most)
    monkeypatch.setattr(op4, "GONE", 0)
    monkeypatch.setattr(common, "HOT", 20)
    rows = [(i, " ".join(w if (j * 7 + i * 13) % 41 else f"v{i}" for j, w in enumerate(prose(8, 150).split()))) for i in range(20)]
    rows += [(50 + i, prose(9, 30) + " " + prose(400 + i, 20)) for i in range(20)]
    got = op4.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_classes(rows)


@pytest.mark.parametrize("few", [op4.FEW_PAIRS, 0])
def test_jaccard_in_one_round_or_many(spark, monkeypatch, few):
    """Where few pairs are left after the first round, the last one comes at once: each round's jobs cost the driver memory."""
    rounds = []
    linked = op4.linked
    monkeypatch.setattr(op4, "linked", lambda *a: rounds.append(1) or linked(*a))
    monkeypatch.setattr(op4, "FEW_PAIRS", few)
    monkeypatch.setattr(op4, "FREQUENT", 2)
    rows = [(i, " ".join(w if (j * 7 + i * 13) % 41 else f"v{i}" for j, w in enumerate(prose(8, 150).split()))) for i in range(20)]
    rows += [(50 + i, prose(9, 30) + " " + prose(400 + i, 20)) for i in range(20)]
    got = op4.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_classes(rows)
    assert len(rounds) == (2 if few else 4)


def test_jaccard_of_rows_that_share_an_id(spark):
    a, b = prose(50, 80), prose(51, 80)
    rows = [(5, a), (5, b), (6, b + " alpha"), (7, a + " beta"), (8, b), (9, b), (9, b), (None, a), (None, "x y")]
    got = op4.jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("5", "5"), ("5", "5"), ("6", "5"), ("7", "5"), ("8", "5"), ("9", "5"), ("9", "5"), ("None", "5"), ("None", "None")])
    named = spark.createDataFrame([("d" + str(i), t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in op4.jaccard_classes(named).collect()}["d6"] == "d5"
    wide = spark.createDataFrame([(i, t, 1, 2, "q") for i, t in rows + [(5, a)]], "doc_id long, text string, k1 long, kept int, id string")
    left = op4.one_of_each_class(wide)
    assert left.columns == wide.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("5", a), ("5", b), ("None", "x y")])


def test_recordings(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.random(64).tolist()) for i in range(1, 230)] + [(300, None), (301, [])]
    rows.append((302, rows[99][1]))
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    media = op5.recordings(e)
    got = {r.id: r for r in op5.match_recordings(media, "vec_id").collect()}
    prints = {r.vec_id: op5.fingerprint(np.frombuffer(bytes(r.audio), "<i2").astype(np.float32)) for r in media.collect()}
    queries = [i for i in prints if i % 100 == 0 and len(prints[i]) and got[i].class_id == i]
    for i, fp in prints.items():
        best = None
        for q in queries:
            a = prints[q]
            hits = Counter(int(x - y) for x, v in enumerate(fp) for y, w in enumerate(a) if v == w)
            for o, h in sorted(hits.items(), key=lambda z: (-z[1], z[0]))[: op5.TOP_OFFSETS]:
                x0, x1 = max(0, o), min(len(fp), o + len(a))
                now = (op5.bit_error(fp[x0:x1], a[x0 - o : x1 - o]), q, o, h)
                best = now if best is None or now[:3] < best[:3] else best
        r = got[i]
        assert (r.bit_error, r.query_id, r.offset, r.hits) == (best or (None,) * 4)
    assert got[302].class_id == 100 and got[302].bit_error == 0 and got[300].n_ints == 0
    # a shifted recording aligns at its shift
    a = np.frombuffer(bytes(media.where("vec_id = 100").first().audio), "<i2")
    shifted = spark.createDataFrame([(100, bytearray(a.tobytes())), (101, bytearray(a[op5.HOP * 5 :].tobytes()))], "id long, audio binary")
    assert {r.id: r.offset for r in op5.match_recordings(shifted).collect()} == {100: 0, 101: -5}


def clip(seed, notes=64):
    """Samples of random notes."""
    rng = np.random.default_rng(seed)
    t = np.arange(notes * op5.HOP) / op5.RATE
    return 4000 * np.sin(2 * np.pi * np.repeat(220 * 2 ** (rng.integers(0, 25, notes) / 12), op5.HOP) * t)


def media_of(spark, clips):
    return spark.createDataFrame([(i, bytearray(x.astype("<i2").tobytes())) for i, x in clips.items()], "id long, audio binary")


def test_recordings_give_every_query_that_matches(spark, monkeypatch):
    noise = lambda seed, n: np.random.default_rng(seed).normal(0, 250, n)
    base, other = clip(1), clip(2)
    n = len(base)
    clips = {100: base, 200: base + noise(3, n), 300: other, 400: clip(4), 7: base.copy(), 8: np.concatenate([base + noise(5, n), other + noise(6, n)]), 9: clip(7), 10: np.zeros(3)}
    prints = {i: op5.fingerprint(x.astype("<i2").astype(np.float32)) for i, x in clips.items()}
    want = {100: {200}, 200: {100}, 7: {200}, 8: {100, 200, 300}, 300: set(), 400: set(), 9: set(), 10: set()}
    for block in (op5.BLOCK, 1):
        monkeypatch.setattr(op5, "BLOCK", block)
        got = op5.match_pairs(media_of(spark, clips)).collect()
        assert {i: {r.query_id for r in got if r.id == i} - {None} for i in clips} == want
        assert {r.class_id for r in got if r.id in (7, 100)} == {7}
        for r in got:
            if r.query_id is not None:
                a, x0 = prints[r.query_id], max(0, r.offset)
                x1 = min(len(prints[r.id]), r.offset + len(a))
                assert x1 - x0 == r.overlap >= op5.LEAST_OVERLAP
                assert r.bit_error == op5.bit_error(prints[r.id][x0:x1], a[x0 - r.offset : x1 - r.offset]) <= op5.MOST_ERROR


def test_every_offset_is_scored():
    rng = np.random.default_rng(8)
    q = rng.integers(0, 1 << 32, 100, dtype=np.uint32)
    flip = lambda x, n: x ^ np.bitwise_or.reduce([np.uint32(1) << rng.integers(0, 32, len(x)).astype(np.uint32) for _ in range(n)])
    fp = flip(q, 3)  # noisy over the whole length, equal in one place
    fp[50] = q[50]
    # more hits at five wrong offsets, and an equal integer at the edge
    for k, o in enumerate((7, -9, 13, -17, 21)):
        for i in range(3):
            fp[30 + 3 * k + i + 20 * (30 + 3 * k + i >= 50)] = q[30 + 3 * k + i + 20 * (30 + 3 * k + i >= 50) - o]
    fp[99] = q[0]
    ids, first = np.array([100]), np.array([0, 100])
    q_, off, hits = op5.offsets(fp, op5._postings([q]))
    rank = {o: sorted(zip(-hits, off)).index((-h, o)) for h, o in zip(hits, off)}
    assert rank[0] >= op5.TOP_OFFSETS and 99 in rank
    want = []
    for o, h in zip(off.tolist(), hits.tolist()):
        x0, x1 = max(0, o), min(100, o + 100)
        e = op5.bit_error(fp[x0:x1], q[x0 - o : x1 - o])
        if x1 - x0 >= op5.LEAST_OVERLAP and e <= op5.MOST_ERROR:
            want.append((100, o, x1 - x0, h, e))
    got = op5.align_all(fp, None, ids, op5._postings([q]), q, first)
    assert got == want and [g[1] for g in got] == [0]
    assert op5.align_all(fp, 100, ids, op5._postings([q]), q, first) == []


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        w = rng.choice(WORDS, 80).tolist()
        if i % 4 == 0:
            w[rng.integers(80)] = rng.choice(["vile", "awful"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = op6.toxicity_of_documents(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    for labels in (docs.select("doc_id", "toxic"), docs.select("doc_id", "toxic").where("false")):
        scores = op6.toxicity_of_documents(odd, labels).collect()
        assert len(scores) == 12 and all(0 <= r.score <= 1 for r in scores)
    assert op6.toxicity_of_documents(none, docs.select("doc_id", "toxic")).count() == 0


def test_windows_of_the_network_one_by_one():
    """Scores of batches against a plain recurrence over each window's words, and long texts in pieces against the whole."""
    rng = np.random.default_rng(51)
    net = op6.Net()
    net.odds = rng.normal(size=net.odds.shape).astype(np.float32)
    texts = [prose(60 + i, n).encode() for i, n in enumerate((0, 1, 7, 31, 32, 33, 100, 333))] + [b"12 34", b"ab"]
    sig = lambda v: 1 / (1 + np.exp(-v))
    want = []
    for t in texts:
        w, h, tri, first = op6.inputs([t])
        n, best = len(h), -np.inf
        e = net.embed(h, tri, first) if n else None
        for start in range(0, max(1, -(-(n - op6.WINDOW) // op6.STRIDE) * op6.STRIDE + 1), op6.STRIDE) if n else ():
            x = e[start : start + op6.WINDOW] @ net.p["wx"] + net.p["bx"]
            states = np.zeros((len(x), 2 * op6.H))
            for d, u in ((0, net.p["uf"]), (1, net.p["ub"])):
                s = np.zeros(op6.H)
                for i in range(len(x)) if d == 0 else reversed(range(len(x))):
                    own, hu = x[i, 3 * op6.H * d : 3 * op6.H * (d + 1)], s @ u
                    z, r = sig(own[: op6.H] + hu[: op6.H]), sig(own[op6.H : 2 * op6.H] + hu[op6.H : 2 * op6.H])
                    s = z * s + (1 - z) * np.tanh(own[2 * op6.H :] + r * hu[2 * op6.H :])
                    states[i, op6.H * d : op6.H * (d + 1)] = s
            a = np.exp(states @ net.p["att"])
            best = max(best, float((a / a.sum()) @ states @ net.p["out"] + net.p["bias"][0]))
        want.append(best if n else float(net.p["bias"][0]))
    assert np.allclose(net.documents(texts), want, atol=1e-4)
    for size in (300, 1000):
        got = [max((float(net.logits(*p).max()) for p in op6.long_windows(t, size)), default=float(net.p["bias"][0])) for t in texts]
        assert np.allclose(got, want, atol=1e-4)


def test_gradients_of_the_network():
    net = op6.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = op6.inputs([prose(12, 40).encode(), b"one two"])
    _, start, length = op6.windows(words[0].first[:-1], words[0].count)
    y = np.array([1.0, 0.0, 1.0])[: len(start)]
    sub = (None, *words[1:])
    g, _ = net.gradients(sub, start, length, y)
    loss = lambda: np.mean(np.logaddexp(0, net.gradients(sub, start, length, y)[1]) - y * net.gradients(sub, start, length, y)[1])
    for k in ("uf", "ub", "wx", "att", "out"):
        at = tuple(0 for _ in net.p[k].shape)
        keep, h = net.p[k][at], 1e-3
        net.p[k][at] = keep + h
        a = loss()
        net.p[k][at] = keep - h
        b = loss()
        net.p[k][at] = keep
        assert g[k][at] == pytest.approx((a - b) / (2 * h), abs=2e-4)


def test_pieces(spark, odd, none, monkeypatch):
    v = op7.Vocabulary.load()
    texts = ["", " ", "a▁b  c\n", "naïve 日本語 🙂", prose(13, 100), "ab" * 300]
    ids, n, _ = v.encode_batch([op7.escaped(t.encode()) for t in texts])
    at = np.concatenate([[0], np.cumsum(n)])
    for t, a, b in zip(texts, at[:-1], at[1:]):
        got = ids[a:b].tolist()
        assert v.decode(got).decode() == t and got == v.encode_one(op7.escaped(t.encode()))
        for chunk in (30, 77):
            assert not t or op7.encode_giant(v, op7.escaped(t.encode()), chunk) == got
    monkeypatch.setattr(op7, "GIANT", 4000)
    monkeypatch.setattr(op7, "CHUNK", 700)
    cut = op7.encode_documents(odd, ["doc_id"])
    monkeypatch.setattr(op7, "GIANT", 1 << 30)
    whole = op7.encode_documents(odd, ["doc_id"])
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.round_trip) for r in df.collect())
    assert key(cut) == key(whole) and all(k[3] for k in key(whole))
    back = op7.decode_ids(op7.encode_documents(odd, ["doc_id"], ids_too=True))
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())
    assert op7.encode_documents(none, ["doc_id"]).count() == 0


def test_pieces_by_blocks_of_chunks(spark, monkeypatch):
    rng = np.random.default_rng(51)
    m = [np.where(rng.random((6, 6)) < 0.3, op7.NONE, -rng.integers(1, 90, (6, 6)).astype(float)) for _ in range(11)]
    plain = op7.boundary_values(m)
    blocks = [m[i : i + 4] for i in range(0, 11, 4)]
    ends = op7.boundary_values([op7.product_of(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(plain, [r for b, e in zip(blocks, ends) for r in op7.boundary_values(b, e)]))
    v = op7.Vocabulary.load()
    texts = [prose(52, 900), "no_blank" * 700, prose(52, 900), "b " * 3000 + "\u65e5" * 900, prose(53, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(op7, "GIANT", 2000)
    monkeypatch.setattr(op7, "CHUNK", 300)
    monkeypatch.setattr(op7, "BLOCK", 4)
    got = {r.doc_id: r.ids for r in op7.encode_documents(docs, ["doc_id"], ids_too=True).collect()}
    assert all(got[i] == v.encode_one(op7.escaped(t.encode())) for i, t in enumerate(texts))


def test_shards(spark, odd, none):
    docs = spark.createDataFrame([(i * i, prose(i, 5 + i % 90)) for i in range(2000)], "doc_id long, text string")
    got = op8.shard_documents(docs).toPandas().sort_values("doc_id")
    # by one sort: shards follow the order of ids, each border lies where its share of the bytes ends, and slots count up
    size, shard = got["size"].to_numpy(), got["shard"].to_numpy()
    assert (np.diff(shard) >= 0).all() and set(shard) == set(range(16))
    border = np.cumsum(np.bincount(shard, size))[:-1]
    assert (np.abs(border - size.sum() * np.arange(1, 16) / 16) <= max(op8.TOLERANCE * size.sum() / 16, size.max())).all()
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in got.groupby("shard"))
    import zlib

    text = {r.doc_id: r.text for r in docs.collect()}
    assert [zlib.crc32(text[i].encode()) for i in got.doc_id] == got.text_crc32.tolist() and [len(text[i]) + 1 for i in got.doc_id] == size.tolist()
    assert op8.shard_documents(odd).count() == 12 and op8.shard_documents(none).count() == 0
    named = op8.shard_documents(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).toPandas()
    assert named.groupby("shard")["size"].sum().max() <= 1.1 * size.sum() / 16 and len(named) == 2000
    wide = docs.selectExpr("doc_id", "length(text) as n", "'x' as shard", "7 as slot", "1 as _key", "2 as row")
    out = op8.shard_by_bytes(wide, "doc_id", "n", 4)
    assert out.columns == ["doc_id", "n", "shard_in", "slot_in", "_key", "row", "shard", "slot"] and out.where("shard_in <> 'x' or slot_in <> 7").count() == 0


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op9.language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    got = {r.doc_id: r for r in op9.language_of_documents(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0 and got[3].lang_pred == "en"
    assert op9.language_of_documents(none).count() == 0


def test_marginals_equal_all_paths(monkeypatch):
    """Against every path of a short chain; and long chains in parts against the chain as a whole."""
    from itertools import product

    rng = np.random.default_rng(41)
    model = op9.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=3).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    emit = rng.normal(size=(5, 3)).astype(np.float32)
    want = np.zeros((5, 3))
    for path in product(range(3), repeat=5):
        p = np.exp(model.start[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(model.trans[x, y] for x, y in zip(path, path[1:])))
        want[range(5), path] += p
    assert np.allclose(model.marginals(emit, np.array([0]), np.array([5])), want / want.sum(1, keepdims=True), atol=1e-5)
    length = np.array([700, 3, 128, 129, 1, 400])
    first, emit = np.cumsum(length) - length, rng.normal(size=(length.sum(), 3)).astype(np.float32)
    monkeypatch.setattr(op9, "PART", 10**6)
    whole = model.marginals(emit, first, length)
    for part in (7, 128):
        monkeypatch.setattr(op9, "PART", part)
        assert np.allclose(model.marginals(emit, first, length), whole, atol=1e-4)


def test_rare_languages_are_learned(spark):
    rows = [(i, prose(i, 20), "xx") for i in range(1200)] + [(5000 + i, " ".join(f"zqo{c}v" for c in "abcdefgh"), "yy") for i in range(6)] + [(6000 + i, f"zqoav zqobv zqocv {c}{c}", "yy") for i, c in enumerate("klmnoprst")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in op9.language_of_documents(docs).collect()}
    assert all(got[i] == "yy" for i in range(5000, 5006)) and got[7] == "xx"


@pytest.mark.parametrize("small", [False, True])
def test_containment_equals_plain_sets(spark, monkeypatch, small):
    """small: items and candidate pairs are joined without a broadcast."""
    if small:
        monkeypatch.setattr(op10, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(op10, "PAIRS", 0)
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    part = items.select("item_id", F.expr("substring(text, 1, cast(length(text) * 0.8 as int))").alias("text"))
    docs = docs.select("doc_id", "text").union(part.select(F.col("item_id") + 10_000, "text"))
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    sets = {r.item_id: words(r.text) for r in items.collect()}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for r in docs.collect():
        w = words(r.text)
        held = {n: grams(w, n) for n in range(1, 6)}
        for i, x in sets.items():
            n = min(5, len(x))
            if n and len(g := grams(x, n)) * 0.75 <= len(g & held[n]):
                want.add((r.doc_id, i, len(g), len(g & held[n])))
    got = {(r.doc_id, r.item_id, r.n_item, r.n_found) for r in op10.contained_items(docs, items).collect()}
    assert got == want and len(want) > 20


def test_containment(spark, odd, none):
    bench = spark.createDataFrame([(0, prose(20, 40)), (1, "tiny item"), (2, None), (3, prose(21, 6)), (4, prose(20, 40))], "item_id long, text string")
    part = " ".join(prose(20, 40).split()[:33])
    docs = spark.createDataFrame([(0, prose(22, 300) + " " + prose(20, 40).upper() + "!"), (1, "a Tiny, ITEM here"), (2, part), (3, " ".join(prose(20, 40).split()[:20])), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in op10.contained_items(docs, bench).collect())
    assert got == [(0, 0), (0, 4), (1, 1), (2, 0), (2, 4)]
    assert op10.contained_items(none, bench).count() == 0 and op10.contained_items(odd, bench.where("false")).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_rows_with_and_without_a_key(spark, monkeypatch, limit):
    """limit: keys up to which they are sent to the rows; beyond, rows pass a map of the keys first, here a small one."""
    monkeypatch.setattr(common, "SMALL_ROWS", limit)
    monkeypatch.setattr(common, "MAP_WORDS", 4)
    rows = spark.createDataFrame([(i % 400 if i % 7 else None, i % 3) for i in range(900)], "id long, k long")
    keys = common.materialize(spark.createDataFrame([(i, i % 2) for i in range(0, 60, 5)] + [(None, 1)], "id long, k long"))
    wanted = {tuple(r) for r in keys.collect()}
    for how, held in (("left_semi", True), ("left_anti", False)):
        got = sorted(map(str, common.key_join(rows, keys, ["id", "k"], how).collect()))
        assert got == sorted(str(r) for r in rows.collect() if (tuple(r) in wanted) == held)


def test_texts_are_not_exchanged_to_take_rows_out(spark):
    """Nor with keys that Spark by itself would not broadcast."""
    import corpus_pipeline as p

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for stage in (p.near_duplicates, p.decontamination):
            plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, stage
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_decontamination_judges_each_row_by_its_text(spark, tmp_path):
    """Rows that share an id, and rows without one."""
    import corpus_pipeline as p

    item, clean = prose(20, 40), prose(23, 60)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "so " + item), (1, clean), (None, item + " end"), (None, clean), (2, None)], "doc_id long, text string")
    assert sorted(map(str, p.decontamination(spark, docs, str(tmp_path)).collect())) == sorted(str(r) for r in docs.collect() if not r.text or item not in r.text)


def test_pipeline(spark, odd, none):
    """Each stage against what it must do with its own input, decided by brute force, and the edge cases."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, inputs = docs, {}
    for name, stage in p.STAGES[:-1]:
        inputs[name] = {r.doc_id: r.text for r in kept.collect()}
        kept = p.materialize(stage(spark, kept, SF))
        assert kept.columns == docs.columns, name
    inputs["tokens"] = {r.doc_id: r.text for r in kept.collect()}
    # language: clean prose stays, texts without letters go
    lang = {r.doc_id: (r.lang_pred, r.score) for r in op9.identify(docs, ["doc_id"]).collect()}
    assert set(inputs["near_duplicates"]) == {d for d, (x, score) in lang.items() if x != "und" and score >= p.SURE}
    # near duplicates: the least id of each class
    classes = brute_classes(list(inputs["near_duplicates"].items()))
    assert set(inputs["decontamination"]) == {c for _, _, c in classes}
    # decontamination: documents that hold three quarters of an item's shingles go
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))] for i in range(len(w) - 4)}
    sets = [s for s in map(shingles, items) if s]
    hit = {d for d, t in inputs["decontamination"].items() if any(len(s & shingles(t)) >= 0.75 * len(s) for s in sets)}
    assert set(inputs["personal_data"]) == set(inputs["decontamination"]) - hit
    # personal data: no base span is left, and what is around spans is unchanged
    found = {r.doc_id: r.spans for r in op3.personal_data(spark.createDataFrame(list(inputs["personal_data"].items()), "doc_id long, text string")).collect()}
    for d, text in inputs["tokens"].items():
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in found[d].split(",") if x))
        want, at = "", 0
        for a, b, k in spans:
            if a >= at:
                want += inputs["personal_data"][d][at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert text == want + inputs["personal_data"][d][at:]
    out = p.STAGES[-1][1](spark, kept, SF).collect()
    v = op7.Vocabulary.load()
    assert {r.doc_id: v.decode(r.ids).decode() for r in out} == inputs["tokens"]
    for _, stage in p.STAGES[:-1]:
        odd_out = stage(spark, odd, SF)
        assert odd_out.columns == odd.columns
        odd_out.count()
        assert stage(spark, none, SF).count() == 0
    assert p.STAGES[-1][1](spark, none, SF).count() == 0
