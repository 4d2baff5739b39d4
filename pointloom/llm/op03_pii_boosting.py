"""Personal data in texts: fixed base patterns, and further spans by candidate gradient boosting; DataFrame functions only.

Base spans are pattern matches that pass a check (parts of an address, Luhn sum, number of digits). High-recall
generators propose further, overlapping spans. Boosted trees score each proposal by its format (length,
digits, separators, checks) and context (what stands before and behind it); proposals of a score above a
calibrated threshold are added. Base spans always stay. The trees are fitted on the driver and run as SQL expressions. They
learn from what the base patterns miss: a bounded sample of the input's base spans, each rewritten so that no base pattern
finds it (the '@' and dots spelled, the plus or country code gone, another number beside a card's), and of proposals inside
base spans of another kind, which are none; and a fixed set of made-up examples, so that an input without base
spans has a model too. Addresses (ip) have no such form: all valid ones are base spans, and none is added.

Positions are code points, end exclusive: the pieces between matches and the matches alternate, so starts are sums of their lengths,
built in blocks so that a text with many matches takes time in proportion.

Null and empty texts: no spans. Repeated rows get equal results. Matches of one kind never overlap, the leftmost and longest counts; spans of
different kinds may, and spans that begin together are told apart by kind. Very long texts are read whole, in time in proportion to their
length and matches. An empty table gives an empty result, and trees fitted on the made-up examples alone. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 20_000  # distinct texts, about, in which spans to learn from are sought; those with the least hashes
TRAIN_ROWS = 5000  # spans of these texts that the trees are fitted on, at most
MADE_UP = 600  # examples of each kind besides
TREES, RATE, PRECISION = 20, 0.3, 0.9
BLOCK = 64

# A match begins where its run of characters does, or where the match before ended: as if each start were tried, without trying them.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"\+[0-9]"}
PROPOSED = {
    "email": r"[A-Za-z0-9._%+-]++\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]\x20?(?:dot|DOT)\x20?[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20().-]{1,2}[0-9]{2,4}){2,5}(?![0-9])",
}
PROPOSED_GUARD = {"email": r"[(\[]\x20?(?:at|AT)\x20?[)\]]", "ip": GUARD["ip"], "card": r"[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9][\x20().-]{1,2}[0-9]{2}"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOT = r"[(\[]\x20?(?:dot|DOT)\x20?[)\]]"
IP_OK = rf"^{PART}(?:\.{PART}){{3}}$"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    """Expression: the Luhn sum of the digits of m is a multiple of ten."""
    d = f"reverse({_digits(m)})"
    return f"(aggregate(sequence(1, greatest(1, length({_digits(m)}))), 0, (a, i) -> a + if(i % 2 = 1, int(substring({d}, i, 1)), int(substring('0246813579', int(substring({d}, i, 1)) + 1, 1)))) % 10 = 0)"


CHECK = {
    "email": "true",
    "ip": f"m.m rlike {_quoted(IP_OK)}",
    "card": f"length({_digits('m.m')}) between 13 and 19 and {_luhn('m.m')}",
    "phone": f"length({_digits('m.m')}) between 9 and 15",
}
SPAN = "array<struct<s:int,e:int,m:string>>"


def with_matches(df: DataFrame, text: str, name: str, pattern: str, guard: str) -> DataFrame:
    """Adds `name`: the matches (s, e, m) of a pattern in the text, leftmost and non-overlapping."""
    p, g = _quoted(pattern), _quoted(guard)
    none = f"cast(array() as {SPAN})"
    df = df.withColumn("_m", F.expr(f"if({text} rlike {g}, regexp_extract_all({text}, {p}, 0), cast(array() as array<string>))"))
    df = df.withColumn("_e", F.expr(f"if(size(_m) = 0, cast(array() as array<struct<g:int,l:int,m:string>>), zip_with(slice(split({text}, {p}, -1), 1, size(_m)), _m, (g, m) -> struct(char_length(g) as g, char_length(m) as l, m as m)))"))
    df = df.withColumn("_c", F.expr(f"transform(sequence(0, greatest(0, cast(ceil(size(_e) / {BLOCK}) as int) - 1)), k -> slice(_e, k * {BLOCK} + 1, {BLOCK}))"))
    df = df.withColumn("_b", F.expr("aggregate(transform(_c, c -> aggregate(c, 0, (a, x) -> a + x.g + x.l)), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"))
    block = f"aggregate(c, struct(b as at, {none} as o), (a, x) -> struct(a.at + x.g + x.l as at, concat(a.o, array(struct(a.at + x.g as s, a.at + x.g + x.l as e, x.m as m))) as o), a -> a.o)"
    return df.withColumn(name, F.expr(f"if(size(_e) = 0, {none}, flatten(zip_with(_c, slice(_b, 1, size(_c)), (c, b) -> {block})))")).drop("_m", "_e", "_c", "_b")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds an array base_<kind> of (s, e, m) for each kind."""
    for kind in KINDS:
        df = with_matches(df, text, f"base_{kind}", BASE[kind], GUARD[kind]).withColumn(f"base_{kind}", F.expr(f"filter(base_{kind}, m -> {CHECK[kind]})"))
    return df


# name -> expression over the proposal c (s, e, m) and the text
FEATURES = {
    "length": "length(c.m)",
    "digits": f"length({_digits('c.m')})",
    "separators": "length(regexp_replace(c.m, '[^\\\\x20().-]', ''))",
    "plus": "int(startswith(c.m, '+'))",
    "paren": "int(contains(c.m, '('))",
    "dots": "length(regexp_replace(c.m, '[^.]', ''))",
    "luhn": f"int(length({_digits('c.m')}) > 0 and {_luhn('c.m')})",
    "parts": f"int(c.m rlike {_quoted(IP_OK)})",
    "spelled": f"int(c.m rlike {_quoted(DOT)})",
    "tight": "int(c.m rlike '[A-Za-z0-9-]\\\\.[A-Za-z]')",
    "four_last": "int(c.m rlike '[^0-9][0-9]{4}$')",
    "zero_first": "int(c.m rlike '^[(]?0')",
    "year": "int(c.m rlike '^(?:19|20)[0-9]{2}[^0-9]|[^0-9](?:19|20)[0-9]{2}$')",
    "letters": "length(regexp_replace(c.m, '[^A-Za-z]', ''))",
    "runs_on": "int(substring(t, greatest(c.s, 1), if(c.s = 0, 0, 1)) rlike '[A-Za-z0-9_.,+-]') + int(substring(t, c.e + 1, 1) rlike '[A-Za-z0-9_@+-]')",
    "digit_near": "int(substring(t, greatest(c.s - 2, 1), least(c.s, 3)) rlike '[0-9]') + int(substring(t, c.e + 1, 3) rlike '[0-9]')",
    "named": "int(lower(substring(t, greatest(c.s - 19, 1), least(c.s, 20))) rlike 'phone|tel|call|mobil|fax|card|visa|mail|contact|addr')",
    "quoted": "int(substring(t, greatest(c.s - 11, 1), least(c.s, 12)) rlike '[\"=#]')",
}


@dataclass
class Trees:
    prior: float
    trees: list[tuple]  # (feature, threshold, (feature, threshold, low, high), (...)) of depth two
    threshold: float


def _stump(x: np.ndarray, r: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    best = (0.0, 0, np.inf)
    g0, h0 = r.sum(), h.sum() + 1
    for j in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17))) if len(x) else ():
            low = x[:, j] <= t
            gl, hl = r[low].sum(), h[low].sum() + 1
            gain = gl * gl / hl + (g0 - gl) ** 2 / (h0 - hl + 1) - g0 * g0 / h0
            if gain > best[0] + 1e-9:
                best = (gain, j, float(t))
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of depth two by second-order steps of the logistic loss; a quarter of the rows sets the threshold: the least score, from 0.5, above which PRECISION is kept."""
    if not len(y) or y.min() == y.max():
        return Trees(6.0 if len(y) and y.max() else -6.0, [], 1.0)
    hold = np.arange(len(y)) % 4 == 0
    xt, yt = x[~hold], y[~hold]
    if yt.min() == yt.max():
        return Trees(float(6 if yt.max() else -6), [], 1.0)
    mean = yt.mean()
    prior = float(np.log(mean / (1 - mean)))
    f, trees = np.full(len(yt), prior), []
    leaf = lambda r, h: float(RATE * r.sum() / (h.sum() + 1))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        r, h = yt - p, p * (1 - p)
        _, j, t = _stump(xt, r, h)
        sides = []
        for side in (xt[:, j] <= t, xt[:, j] > t):
            _, k, s = _stump(xt[side], r[side], h[side])
            low = side & (xt[:, k] <= s)
            high = side & ~low
            sides.append((k, s, leaf(r[low], h[low]), leaf(r[high], h[high])))
            f[low] += sides[-1][2]
            f[high] += sides[-1][3]
        trees.append((j, t, *sides))
    model = Trees(prior, trees, 1.0)
    score = np.array([predict(model, row) for row in x[hold]])
    for t in np.unique(np.concatenate([[0.5], score[score >= 0.5]])):
        kept = score >= t
        if kept.any() and y[hold][kept].mean() >= PRECISION:
            return Trees(prior, trees, float(t))
    return model


def predict(model: Trees, row: np.ndarray) -> float:
    f = model.prior
    for j, t, *sides in model.trees:
        k, s, low, high = sides[int(row[j] > t)]
        f += low if row[k] <= s else high
    return 1 / (1 + float(np.exp(-f)))


def _sql(model: Trees) -> str:
    """Expression: the score of the feature struct f."""
    names = list(FEATURES)
    num = lambda v: f"{v!r}D" if np.isfinite(v) else "1e300D"
    side = lambda z: f"if(f.{names[z[0]]} <= {num(z[1])}, {num(z[2])}, {num(z[3])})"
    terms = [f"if(f.{names[j]} <= {num(t)}, {side(a)}, {side(b)})" for j, t, a, b in model.trees]
    return f"1 / (1 + exp(-({' + '.join([num(model.prior), *terms])})))"


def proposals(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds cand_<kind>: proposed spans (s, e, f) of each kind that no base span of the kind overlaps with, f their features, and seen_<kind>: those that one covers."""
    for kind in KINDS:
        df = with_matches(df, text, "_p", PROPOSED[kind], PROPOSED_GUARD[kind])
        struct = ", ".join(f"cast({e.replace('(t,', f'({text},')} as double) as {n}" for n, e in FEATURES.items())
        near = f"exists(base_{kind}, b -> b.s < c.e and c.s < b.e)"
        df = df.withColumn(f"cand_{kind}", F.expr(f"transform(_p, c -> struct(c.s as s, c.e as e, {near} as known, struct({struct}) as f))")).drop("_p")
    return df


def _rewritten(kind: str, m: str, i: int) -> list[tuple[str, str, str, int]]:
    """(before, span, behind, label) of a base span, or of one like it, as the base patterns miss it; i picks the form."""
    if kind == "email":
        user, host = m.rsplit("@", 1)
        at, dot = ((" (at) ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [AT] ", " [DOT] "), ("(at)", "."))[i % 5]
        return [("", user + at + host.replace(".", dot), "", 1)]
    if kind == "phone":
        local = re.sub(r"^\+[0-9]+[ .-]*", "", m)
        return [("", (m[1:], local, "-".join(re.findall("[0-9]+", local)), "00" + m[1:], " ".join(re.findall("[0-9]+", local)))[i % 5], "", 1)]
    if kind == "card":
        wrong = m[:-1] + str((int(m[-1]) + 1 + i % 9) % 10)
        number = str(10 + 7 * i % 900)
        return [(number + " ", x, "", y) if i % 2 else ("", x, " " + number, y) for x, y in ((m, 1), (wrong, 0))]
    return []


def _made_up() -> list[tuple[str, str, str, str, int]]:
    """(kind, before, span, behind, label): spans of each kind as the base patterns miss them, and numbers, codes and sentences that are none."""
    rng = random.Random(0)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    part = lambda: str(rng.randint(10, 99))
    plain = lambda: " ".join(word() for _ in range(rng.randint(0, 4)))
    out = []
    for i in range(MADE_UP):
        cue = lambda words: f"{plain()} {rng.choice(words) if rng.random() < 0.4 else word()}{rng.choice((' ', ': '))}"
        behind = rng.choice(("", ".", ", ", " ")) + rng.choice(("", " " + plain()))
        host = ".".join(word() for _ in range(rng.randint(1, 2))) + "." + rng.choice(("org", "com", "net", "de", "fr", "es", "co.uk", "io"))
        for before, m, after, y in _rewritten("email", rng.choice((word(), f"{word()}.{part()}", f"{word()}.{word()}")) + "@" + host, i):
            out.append(("email", cue(("mail", "contact", "write to")) + before, m, after + behind, y))
        none = rng.choice((f"{word()} (at) {word()}. {word().capitalize()}", f"{word()} (at) {digits(2)}.{part()}", f"{word()} [at] {word()}. {word()}", f"{word()} (at) {word()} {word()}. {word()}"))
        out.append(("email", f"{plain()} ", none, f" {plain()}", 0))
        area, mid, last = digits(3), digits(3), digits(4)
        phone = rng.choice((f"+{rng.randint(1, 99)} ({area}) {mid}-{last}", f"+{rng.randint(1, 99)} {area} {mid} {last}", f"+{rng.randint(1, 99)} {area}-{mid}-{last}", f"+1 {area}.{mid}.{last}", f"+44 0{part()} {digits(4)} {last}"))
        for before, m, after, y in _rewritten("phone", phone, i):
            out.append(("phone", cue(("phone", "call", "tel.", "mobile")) + before, m, after + behind, y))
        day = (rng.choice(("19", "20")) + part(), f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}")
        sep = rng.choice("-.")
        for none in (sep.join(day), sep.join(day[::-1]), f"{'-'.join(day)} {part()}", f"{part()}.{part()}.{part()}", f"{digits(3)}.{digits(3)}.{part()}.{digits(3)}", f"{rng.randint(1, 99)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(3)}-{part()}-{digits(4)}", f"{part()}-{part()}-{part()}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}")[i % 2 :: 2]:
            out.append(("phone", cue(("order no.", "version", "dated", "isbn", "part", "code", "from", "serial")), none, behind, 0))
        body = rng.choice("3456") + digits(14)
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(body))
        card = body + str(-total % 10)
        if i % 4 > 1:
            card = rng.choice(" -").join(card[k : k + 4] for k in range(0, 16, 4))
        for before, m, after, y in _rewritten("card", card, i):
            out.append(("card", cue(("card", "visa", "paid by")) + before, m, after + behind, y))
    return out


def sample_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """The texts whose hashes are least, about TRAIN_DOCS of them, equal ones once; chosen before any pattern runs."""
    n = df.count()
    u = F.xxhash64(F.col(text))
    low = (2 * min(1.0, TRAIN_DOCS / max(1, n)) - 1) * 2.0**63
    return materialize(df.where(u.cast("double") <= F.lit(low)).select(F.col(text).alias(text), u.alias("u")).dropDuplicates(["u"]))


def train(df: DataFrame, text: str = "text") -> dict[str, Trees]:
    """One model for each kind, fitted on at most TRAIN_ROWS spans of the texts that sample_texts() chooses."""
    df = proposals(base_spans(sample_texts(df, text), text), text)
    around = lambda x: f"substring({text}, greatest({x}.s - 19, 1), least({x}.s, 20)) as before, substring({text}, {x}.s + 1, {x}.e - {x}.s) as m, substring({text}, {x}.e + 1, 12) as behind"
    base = [F.expr(f"transform(base_{k}, b -> struct('{k}' as kind, b.s as s, true as own, {around('b')}))") for k in KINDS]
    other = lambda k: "concat(" + ", ".join(f"base_{o}" for o in KINDS if o != k) + ")"
    none = [F.expr(f"transform(filter(cand_{k}, c -> not c.known and exists({other(k)}, b -> b.s <= c.s and c.e <= b.e)), c -> struct('{k}' as kind, c.s as s, false as own, {around('c')}))") for k in KINDS]
    rows = df.select("u", F.explode(F.concat(*base, *none)).alias("c")).orderBy("u", "c.kind", "c.s", "c.own", "c.m").limit(TRAIN_ROWS).select("c.kind", "c.own", "c.before", "c.m", "c.behind").collect()
    made = _made_up()
    for i, (kind, own, before, m, behind) in enumerate(rows):
        made += [(kind, before + b, x, a + behind, y) for b, x, a, y in _rewritten(kind, m, i)] if own else [(kind, before, m, behind, 0)]
    made = [(i, *x) for i, x in enumerate(random.Random(1).sample(made, len(made)))]
    # as a literal: rows of the driver would pass through Python workers
    literal = json.dumps([{"i": i, "kind": k, "s": len(b), "e": len(b) + len(m), "y": y, "t": b + m + a} for i, k, b, m, a, y in made])
    shown = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(literal), "array<struct<i:int,kind:string,s:int,e:int,y:int,t:string>>")))
    shown = proposals(base_spans(shown, "t"), "t")
    hits = F.concat(*(F.expr(f"transform(filter(cand_{k}, c -> kind = '{k}' and not c.known and c.s = s and c.e >= e), c -> c.f)") for k in KINDS))
    found = shown.select("i", "kind", "y", F.explode(hits).alias("f")).collect()
    out = {}
    for kind in KINDS:
        mine = sorted((r[0], r[2], tuple(r[3])) for r in found if r[1] == kind)
        out[kind] = fit(np.array([f for _, _, f in mine], float).reshape(len(mine), len(FEATURES)), np.array([y for _, y, _ in mine]))
    return out


def find_spans(df: DataFrame, text: str = "text", models: dict[str, Trees] | None = None) -> DataFrame:
    """Adds base_<kind> (s, e, m) and added_<kind> (s, e, score) arrays to df."""
    models = models or train(df, text)
    df = proposals(base_spans(df, text), text)
    for kind in KINDS:
        df = df.withColumn(f"added_{kind}", F.expr(f"filter(transform(filter(cand_{kind}, c -> not c.known), c -> struct(c.s as s, c.e as e, aggregate(array(c.f), 0D, (a, f) -> {_sql(models[kind])}) as score)), c -> c.score >= {models[kind].threshold!r}D)")).drop(f"cand_{kind}")
    return df


def all_spans(with_base: bool = True, with_added: bool = True) -> Column:
    """Array of (k, s, e): the kind's place in KINDS, start and end, sorted."""
    parts = [f"transform({src}_{kind}, x -> struct({i} as k, x.s as s, x.e as e))" for i, kind in enumerate(KINDS) for src in ("base",) * with_base + ("added",) * with_added]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.k], x.s, x.e)), ',')"


def personal_data(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    df = find_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", models)
    df = df.withColumn("_base", all_spans(with_added=False)).withColumn("_all", all_spans())
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts, F.expr(f"sha2({_joined('_base')}, 256)").alias("base_sha256"), F.expr(_joined("_all")).alias("spans"), (F.size("_all") - F.size("_base")).cast("long").alias("n_added"))


def redact(docs: DataFrame, text: str = "text", models: dict[str, Trees] | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, named after the first. Null texts stay null.

    All other columns come back as they were, whatever their names: they travel as one struct.
    """
    df = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))
    df = find_spans(df, "text", models)
    df = df.withColumn("_all", F.expr("array_sort(transform(" + "concat(" + ", ".join(f"transform({s}_{k}, x -> struct(x.s as s, x.e as e, {i} as k))" for i, k in enumerate(KINDS) for s in ("base", "added")) + "), x -> x))"))
    # merged: (s, e, k); a span that begins before the last one's end widens it
    merged = "aggregate(_all, cast(array() as array<struct<s:int,e:int,k:int>>), (a, x) -> if(size(a) > 0 and x.s < element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.e) as e, element_at(a, -1).k as k))), concat(a, array(struct(x.s as s, x.e as e, x.k as k)))))"
    df = df.withColumn("_all", F.expr(merged))
    tags = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    body = F.expr(f"concat(array_join(transform(_all, (x, i) -> concat(substring(text, if(i = 0, 0, _all[i - 1].e) + 1, x.s - if(i = 0, 0, _all[i - 1].e)), array({tags})[x.k])), ''), substring(text, element_at(_all, -1).e + 1, char_length(text)))")
    new = F.when(F.size("_all") == 0, F.col("row")[text]).otherwise(body)
    return df.select(*(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
