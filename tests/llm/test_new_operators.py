"""Operators 11 to 13 against brute-force versions, exact round trips and the edge cases they define."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import op11_fill_in_middle as op11
from pointloom.llm import op12_va_negatives as op12
from pointloom.llm import op13_secret_scan as op13
from tests.llm.test_llm import none, odd  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 ---------------------------------------------------------------------


def plain_fim(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def broken_lines(spark):
    rng = np.random.default_rng(5)
    pick = ["\n", "\n\n", "é", "a b", "<", "P>", "<S", ">", "M", "<M> "[:2], "\r", "😀", " "]
    rows = [(i, "".join(rng.choice(pick, rng.integers(0, 60)))) for i in range(400)]
    rows += [(400, "<P>"), (401, "x<M>y\n"), (402, "\n" * 5000), (403, "z" * 300_000), (404, "ab\n" * 100_000), (405, "tail without break\nx")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_fill_in_middle(spark, odd, none):  # noqa: F811
    for docs in (odd, broken_lines(spark)):
        want = [(str(r.doc_id), *plain_fim(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect()]
        got = [(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in op11.fill_in_middle(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        texts = sorted(sha(r.text or "") for r in docs.select("text").collect())
        rows = op11.digests(docs).collect()
        assert sorted(r.restored_sha256 for r in rows) == texts
        assert sorted((str(r.doc_id), r.output_sha256) for r in rows) == sorted((w[0], sha(w[-1])) for w in want)
    assert op11.digests(none).count() == 0


def test_restored_from_output_and_form_alone(spark):
    docs = broken_lines(spark)
    out = op11.fill_in_middle(docs).select("doc_id", "output", "form").withColumn("text_", op11.restored())
    assert out.join(docs, "doc_id").where("NOT text_ <=> text").count() == 0
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_other_units_and_rates(spark):
    docs = spark.createDataFrame([(i, "one two  three, four five " * (i % 7)) for i in range(200)], "doc_id long, text string")
    how = op11.Transformation(units=r"\S+\s*", seed="x", rate=30, spm_share=100)
    got = op11.fill_in_middle(docs, how).withColumn("text_", op11.restored()).join(docs, "doc_id").collect()
    assert all(r.text_ == r.text and r.n == len(r.text.split()) for r in got)
    forms = [r.form for r in got if r.text]
    assert set(forms) == {"plain", "spm"} and 0.15 < forms.count("spm") / len(forms) < 0.45


def test_the_matcher_stores_no_units(monkeypatch):
    """The second pass reads no further than the second rank, and no match outlives the next one."""
    import weakref

    alive, most = weakref.WeakSet(), 0

    class Match:
        def __init__(self, m):
            self.m = m

        def end(self):
            return self.m.end()

    class Pattern:
        read = 0

        def finditer(self, text):
            nonlocal most
            for m in re.finditer(op11.LINES, text):
                held = Match(m)
                alive.add(held)
                most = max(most, len(alive))
                Pattern.read += 1
                yield held
                del held

    text = "line\n" * 50_000
    assert op11.count_units(Pattern(), text) == 50_000
    Pattern.read = 0
    assert op11.cuts(Pattern(), text, 1000, 20_000) == (5000, 100_000)
    assert Pattern.read == 20_000 and most <= 3
    assert op11.cuts(Pattern(), text, 0, 0) == (0, 0)


# ---- 12 ---------------------------------------------------------------------


def plain_negatives(rows, most=5):
    """rows: (vec_id, label, ints) that take part."""
    out = []
    for a, la, x in rows:
        if a % 100:
            continue
        score = [(-sum(p * q for p, q in zip(x, y)), b, lb) for b, lb, y in rows if b != a]
        for s, p, _ in sorted(t for t in score if t[2] == la)[:most]:
            inside = sorted(t for t in score if t[2] != la and 80 * -s <= 100 * -t[0] <= 100 * -s)[:most]
            out += [(a, p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(inside)]
    return sorted(out)


def taking_part(raw):
    seen = {}
    for i, label, v in raw:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        row = (int((label + 1) % 10 if i % 7 == 0 else label), [int(np.floor(256 * float(np.float32(c)))) for c in v])
        seen[i] = min(seen.get(i, row), row)
    return [(i, label, x) for i, (label, x) in sorted(seen.items())]


def result(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize(("cells", "sample", "rows", "anchor_bytes"), [(256, 4096, 32768, 1 << 25), (4, 10, 50, 1 << 25), (16, 100, 200, 0)])
def test_negatives_equal_brute_force(spark, monkeypatch, cells, sample, rows, anchor_bytes):
    for name, value in (("CELLS", cells), ("SAMPLE", sample), ("ROWS", rows), ("ANCHOR_BYTES", anchor_bytes), ("ANCHORS", 4 if not anchor_bytes else 32768), ("TILE", 4096)):
        monkeypatch.setattr(op12, name, value)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    raw = [(i, int(rng.integers(0, 4)), (centres[i % 6] + 0.6 * rng.standard_normal(12)).tolist()) for i in range(1200)]
    got = result(op12.negatives_of_embeddings(spark.createDataFrame(raw, SCHEMA)))
    assert got and got == plain_negatives(taking_part(raw))


def test_negatives_of_hot_vectors_and_ties(spark):
    """A vector that many rows share, under several labels, and rows of small integers with many equal scores."""
    rng = np.random.default_rng(8)
    raw = [(i, int(i % 3), [0.25, 0.5, -0.125]) for i in range(900)] + [(i, int(i % 5), (rng.integers(-3, 4, 3) / 16).tolist()) for i in range(900, 2000)]
    raw += [(2100, 1, [0.0, 0.0, 0.0]), (2200, 2, [-0.5, -0.5, 0.25])]
    assert result(op12.negatives_of_embeddings(spark.createDataFrame(raw, SCHEMA))) == plain_negatives(taking_part(raw))


def test_negatives_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    raw = [(i, int(rng.integers(0, 3)), rng.standard_normal(5).tolist()) for i in range(300)]
    raw += [(None, 1, [1.0] * 5), (400, None, [1.0] * 5), (500, 1, None), (600, 1, [1.0, None, 0.0]), (700, 1, [nan, 0.0]), (800, 1, [inf, 1.0]), (900, 1, []), (1000, 2, [0.5, 0.25]), (1100, 0, [3e4, -2e4, 1.0])]
    raw += [raw[5], raw[100], (17, 2, [0.5] * 5), (100, 0, [0.1] * 5)]
    df = spark.createDataFrame(raw, SCHEMA).select("*", F.lit(1).alias("x"), F.lit("a").alias("anchor"), F.lit(0).alias("score"))
    assert result(op12.negatives_of_embeddings(df)) == plain_negatives(taking_part(raw))
    for few in (raw[:1], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, 1, []), (1, 1, []), (2, 2, [])]):
        assert result(op12.negatives_of_embeddings(spark.createDataFrame(few, SCHEMA))) == plain_negatives(taking_part(few))
    empty = op12.negatives_of_embeddings(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_integers_beyond_doubles(spark):
    raw = [(i, i % 2, [4e5 + i, -3e5 + 2 * i, 1e5]) for i in range(0, 400, 10)]
    assert result(op12.negatives_of_embeddings(spark.createDataFrame(raw, SCHEMA))) == plain_negatives(taking_part(raw))
    big = [(i, i % 2, [3e6 + 7 * i, 2e6]) for i in range(0, 400, 10)]  # scores above 2 ** 53
    assert result(op12.negatives_of_embeddings(spark.createDataFrame(big, SCHEMA))) == plain_negatives(taking_part(big))


def test_bounds_hold_and_prune(spark):
    """Every score lies within its bounds, and far fewer pairs than all are scored."""
    rows = op12.quantised(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet"), "embedding").orderBy("vec_id")
    x = np.array([r.x for r in rows.collect()])
    dim = x.shape[1]
    for cells, most in ((16, None), (256, 60)):
        edges = op12.cell_edges(rows, dim, cells)
        cell = np.stack([np.searchsorted(e, x[:, d], "right") - 1 for d, e in enumerate(edges)], 1)
        low, high = (np.stack([e[f][cell[:, d]] - f for d, e in enumerate([(e[:-1], e[1:]) for e in edges])], 1) for f in (0, 1))
        assert (low <= x).all() and (x <= high).all()
        anchors = op12.materialize(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor"), "label", "x", F.array(F.lit(-op12.OPEN)).alias("lows"), F.array(F.lit(op12.OPEN)).alias("highs")))
        blocks = op12.materialize(rows.mapInArrow(op12.approximate(dim, edges), "ids binary, labels binary, cells binary"))
        found = op12.candidates(blocks, anchors, dim, edges, 1, 5, True).groupBy("anchor").count().agg(F.max("count")).first()[0]
        assert most is None or found <= most


# ---- 13 ---------------------------------------------------------------------

PLAIN = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), lambda m: len(m.group(2)) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
}


def plain_secrets(text):
    order = list(PLAIN)
    found = sorted((m.start(), order.index(k), m.end()) for k, (p, ok) in PLAIN.items() for m in p.finditer(text or "") if ok(m))
    return [f"{order[k]}:{s}:{e}" for s, k, e in found]


def check_secrets(docs):
    want = sorted((str(r.doc_id), plain_secrets(r.text)) for r in docs.select("doc_id", "text").collect())
    got = op13.secrets_of_documents(docs).collect()
    base = ("assign", "access", "hex")
    assert sorted((str(r.doc_id), [s for s in r.spans.split(",") if s.split(":")[0] in base]) for r in got) == want
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((d, sha(",".join(s))) for d, s in want)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex) for r in got) == sorted((d, *(sum(x.startswith(k) for x in s) for k in base)) for d, s in want)


def test_base_secrets_equal_plain_patterns(spark, odd, none):  # noqa: F811
    check_secrets(odd)
    check_secrets(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = np.random.default_rng(2)
    pick = ["password", "PassWd", "secret", "ToKen", "api_key", "APIkey", "tokentoken", '"', "'", " ", "  ", ":", "=", "abc", "é", "ſecret", "toKen", "😀", "AKIA", "AKIAKIA", "akia", "ABCDEFGH01234567", "Z", "\n", "0123456789abcdef", "f" * 23, "f" * 24, "deadbeef", "-", "/", "x" * 40]
    rows = [(i, "".join(rng.choice(pick, rng.integers(0, 40)))) for i in range(1500)]
    rows += [(2000, "é" * 90_000 + " token = abcdef " + "0" * 100_000 + "😀 AKIA" + "A" * 16), (2001, "token" * 20_000), (2002, "password" + " " * 50_000 + "x"), (2003, "token=" * 9000 + "abcdef")]
    check_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert op13.secrets_of_documents(none).count() == 0


def forge(body, prefix="ghp_"):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = op13.BASE62[d] + digits
    return prefix + body + digits


def bech32(name, data):
    """A string with a right checksum, by the published procedure."""

    def rest(values):
        c = 1
        for v in values:
            top, c = c >> 25, (c & 0x1FFFFFF) << 5 ^ v
            for i, g in enumerate(op13.BECH32_STEPS):
                c ^= g if top >> i & 1 else 0
        return c

    head = [ord(c) >> 5 for c in name] + [0] + [ord(c) & 31 for c in name]
    end = rest(head + data + [0] * 6) ^ 1
    return name + "1" + "".join(op13.BECH32[v] for v in data + [end >> 5 * (5 - i) & 31 for i in range(6)])


def base58(payload):
    value, out = int.from_bytes(payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4], "big"), ""
    while value:
        value, d = divmod(value, 58)
        out = op13.BASE58[d] + out
    return out


def test_embedded_checksums():
    # public test vectors
    assert op13.bech32_check(b"nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5")
    assert op13.base58_check(b"xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi")
    good = [forge("aB3" * 10), forge("Zz9xY" * 6, "npm_"), bech32("nsec", list(range(32)) + [7] * 20)]
    for token, check in zip(good, (op13.crc_base62, op13.crc_base62, op13.bech32_check)):
        assert check(token.encode())
        for at in range(6, len(token)):
            other = "q" if token[at] != "q" else "p"
            assert not check((token[:at] + other + token[at + 1 :]).encode())


def test_checked_tokens_are_added(spark):
    wallet = base58(bytes.fromhex("0488ade4") + bytes(range(74)))
    age = bech32("age-secret-key-", [3, 9, 27] * 17 + [1]).upper()
    good = {"forge_token": forge("q1W2e3R4t5" * 3, "ghs_"), "package_token": forge("A0" * 15, "npm_"), "wallet_key": wallet, "age_key": age, "note_key": bech32("nsec", [5, 0, 17] * 17 + [1])}
    assert wallet.startswith("xprv") and len(age) == 74
    rows = [(i, f"é {t} end") for i, t in enumerate(good.values())] + [(10 + i, f"é {t[:-1] + ('2' if t[-1] != '2' else '3')} end") for i, t in enumerate(good.values())]
    rows += [(20, f"token = {good['forge_token']}"), (21, good["forge_token"] + "x"), (22, good["note_key"] * 2), (23, f"{good['package_token']} {good['package_token']}")]
    got = {r.doc_id: r.spans for r in op13.secrets_of_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kind, t) in enumerate(good.items()):
        assert got[i] == f"{kind}:2:{2 + len(t)}" and got[10 + i] == ""
    assert got[20] == f"assign:0:{8 + 40},forge_token:8:48" and got[21] == "" and got[22] == "note_key:63:126"
    assert got[23] == "package_token:0:40,package_token:41:81"


def test_secrets_are_redacted_and_other_columns_kept(spark, odd):  # noqa: F811
    token = forge("q1W2e3R4t5" * 3)
    docs = spark.createDataFrame([(1, None, "a", 5), (2, "", "b", 6), (3, f"x token = {token} y AKIA{'B' * 16}é", "c", 7), (4, "clean", None, None), (5, "password: abcdef" + "0" * 30, "e", 8)], "doc_id long, text string, row string, secrets int")
    got = {r.doc_id: (r.text, r.row, r.secrets) for r in op13.redact_secrets(docs).collect()}
    assert got == {1: (None, "a", 5), 2: ("", "b", 6), 3: ("x [SECRET] y [SECRET]é", "c", 7), 4: ("clean", None, None), 5: ("[SECRET]", "e", 8)}
    assert op13.redact_secrets(docs).columns == docs.columns
    assert op13.redact_secrets(odd).exceptAll(odd).count() == 0


def test_hits_come_from_the_automaton():
    """Patterns run only where a keyword begins."""
    found = op13.Scanner(op13.DETECTORS)
    tried = []

    class Spy:
        def __init__(self, p):
            self.p = p

        def match(self, raw, at):
            tried.append(at)
            return self.p.match(raw, at)

    found.patterns = [Spy(p) for p in found.patterns]
    text = b"nothing here " * 1000 + b"my Token: abcdefgh " + b"plain words " * 1000 + b"0" * 30
    assert [(s, found.kinds[i]) for s, i, _ in found.spans(text)] == [(13_003, "assign"), (25_019, "hex")]
    assert tried == [13_003, 25_019]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["secret=1234567"]})
    assert next(op13.scan(op13.DETECTORS)(iter([batch]))).column("secrets").to_pylist() == [[{"kind": "assign", "start": 0, "end": 14}]]


# ---- earlier operators ------------------------------------------------------


def test_pieces_of_giant_texts_keep_their_names():
    """The same rows in another order, equal ones included, give the same pieces under the same names."""
    from pointloom.llm import op02_backoff_scoring as op2

    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, "x y z w v u")]

    def names(rows):
        batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
        return sorted(tuple(c.as_py() for c in row) for b in op2.cut_giants(4, 2)(iter([batch])) for row in zip(*b.columns))

    a, b = names(rows), names(rows[::-1])
    assert a == b and len({r[2] for r in a}) == 4


@pytest.mark.parametrize("margin", [4, 1e-4])
def test_least_hashes_whatever_the_share(spark, monkeypatch, margin):
    """One value holds nearly all rows, another few; the range is widened until it holds enough."""
    from pointloom.llm import common

    monkeypatch.setattr(common, "MARGIN", margin)
    rows = [(i, f"text {i % 900}", "many") for i in range(1500)] + [(2000 + i, f"other {i}", "few") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = common.least_hashes(docs, common.hashed(docs), 20, "lang")
    known = {(r.text, r.lang): r.h for r in docs.select("text", "lang", F.xxhash64("text").alias("h")).collect()}
    want = sorted((k for k in known if k[1] == "many"), key=known.get)[:20] + [k for k in known if k[1] == "few"]
    assert sorted(got) == sorted(want)
    assert common.least_hashes(docs.where("false"), common.hashed(docs.where("false")), 20, "lang") == []


def test_jobs_of_near_duplicates(spark):
    """Each job costs the driver memory: the stage takes no more of them than this."""
    import corpus_pipeline as p

    before = int(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs())
    p.near_duplicates(spark, spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), SF).count()
    assert int(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()) - before < 70
