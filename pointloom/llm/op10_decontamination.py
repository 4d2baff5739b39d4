"""Benchmark items inside documents, by size-partitioned MinHash containment search; DataFrame functions only.

Text is lower-cased and cut into runs of letters and digits; a shingle is the hash of five words. Items are
partitioned by the power of two of their number m of distinct shingles. An item's sketch holds its smallest hashes, as
many as its partition's largest member may miss and one more; a document that contains at least `CONTAINED` of an item's
shingles must hold one of them. Documents are long, so they are not sketched: every shingle of theirs is looked up in the
sketches, which gives the candidate pairs. Only these are verified, by the exact share of the item's distinct shingles that the document holds.

Items or documents of fewer than five words use shingles of all their length: an item of m < 5 words is found where its
words occur in a row. Null, empty and wordless texts, and such items, match nothing. Repeated rows give one pair; of rows
that share an id the text that holds most counts. Null ids are kept. A document that holds several items, or ties, gives every pair. A
very long text stays in the JVM, as an array of eight bytes a word. Empty tables give an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import key_join, materialize

SHINGLE, CONTAINED = 5, 0.75
BROADCAST_ROWS = 1_000_000  # shingles of all items up to which they are sent to every executor (16 to 60 MB)
PAIRS = 500_000  # candidate pairs up to which the keys of their documents are sent (8 to 30 MB)


def words_of(text: str) -> Column:
    return F.expr(f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')")


def _grams(words: str, n: int) -> str:
    """Expression: an array of hashes of n hashed words in a row, from an array of hashes."""
    picks = ", ".join(f"{words}[i + {k}]" for k in range(n))
    return f"if(size({words}) < {n}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {n}), i -> xxhash64({n}, {picks})))"


def item_shingles(bench: DataFrame) -> DataFrame:
    """item_id, n (words of a shingle), m (distinct shingles), part, gram, is_key."""
    w = bench.select("item_id", F.transform(words_of("text"), lambda x: F.xxhash64(x)).alias("w")).where("size(w) > 0").distinct()
    by_size = " ".join(f"when size(w) = {n} then {_grams('w', n)}" for n in range(1, SHINGLE))
    g = w.select("item_id", F.least(F.size("w"), F.lit(SHINGLE)).alias("n"), F.expr(f"array_sort(array_distinct(case {by_size} else {_grams('w', SHINGLE)} end))").alias("g"))
    g = g.withColumn("m", F.size("g")).withColumn("part", F.floor(F.log2("m")).cast("int"))
    most = F.pow(F.lit(2), F.col("part") + 1) - 1  # the largest size of the partition
    g = g.withColumn("keys", F.least("m", (most - F.ceil(most * CONTAINED) + 1).cast("int")))
    return g.select("item_id", "n", "m", "part", "keys", F.posexplode("g").alias("at", "gram")).withColumn("is_key", F.col("at") < F.col("keys")).drop("at", "keys")


def row_bits() -> list[Column]:
    """u and v, 128 bits of a row's id and text."""
    return [F.xxhash64("doc_id", "text").alias("u"), F.xxhash64(F.lit(7), "text").alias("v")]


def found_items(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, u and v (the row's 128 bits), item_id, m, n_found of every row and item with containment of at least CONTAINED."""
    items = item_shingles(bench)
    sizes = {r[0]: r[1] for r in items.groupBy("n").count().collect()}
    if not sizes:
        return items.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), "item_id", "m", F.lit(0).cast("long").alias("n_found")).where("false")
    small = sum(sizes.values()) <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda df: df
    wanted = F.expr("concat(" + ", ".join(_grams("w", n) for n in sorted(sizes)) + ")")
    rows = docs.select("doc_id", *row_bits(), "text")

    def grams(of: DataFrame) -> DataFrame:
        return of.select("doc_id", "u", "v", F.transform(words_of("text"), lambda x: F.xxhash64(x)).alias("w")).select("doc_id", "u", "v", F.explode(wanted).alias("gram"))

    keys = items.where("is_key").select("gram", "item_id")
    pairs = materialize(grams(rows).join(sent(keys), "gram").select("u", "v", "item_id").distinct())
    found = pairs.select("u", "v").distinct()
    held = grams(rows.join(F.broadcast(found) if pairs.limit(PAIRS + 1).count() <= PAIRS else found, ["u", "v"], "left_semi")).distinct()
    hits = held.join(sent(items.select("gram", "item_id", "m")), "gram").join(pairs, ["u", "v", "item_id"], "left_semi")
    return hits.groupBy("doc_id", "u", "v", "item_id", "m").agg(F.count("*").alias("n_found")).where(F.col("n_found") >= F.col("m") * CONTAINED)


def contained_items(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment of every pair with containment of at least CONTAINED."""
    shares = found_items(docs, bench)
    return shares.groupBy("doc_id", "item_id", "m").agg(F.max("n_found").alias("n_found")).select("doc_id", "item_id", F.col("m").cast("long").alias("n_item"), "n_found", (F.col("n_found") / F.col("m")).alias("containment"))


def without_items(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the rows whose text contains an item, whatever rows share their id. Texts are not exchanged for it while the keys of what goes fit a broadcast."""
    keys = materialize(found_items(docs, bench).select("u", "v").distinct())
    return key_join(docs.select(F.struct(*docs.columns).alias("row"), *row_bits()), keys, ["u", "v"], "left_anti").select("row.*")


ORACLE = """
WITH w(kind, id, ws) AS (
  SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')
  FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
),
b AS (SELECT id, least(len(ws), 5) AS n, unnest(list_distinct([ws[i:i + least(len(ws), 5) - 1] FOR i IN range(1, len(ws) - least(len(ws), 5) + 2)])) AS g FROM w WHERE kind = 1 AND len(ws) > 0),
m AS (SELECT id, count(*) AS m FROM b GROUP BY id),
d AS (SELECT DISTINCT id, unnest([ws[i:i + n - 1] FOR i IN range(1, len(ws) - n + 2)]) AS g FROM w, (SELECT DISTINCT n FROM b) WHERE kind = 0 AND len(ws) >= n)
SELECT d.id AS doc_id, b.id AS item_id, any_value(m) AS n_item, count(*) AS n_found, count(*) / any_value(m) AS containment
FROM d JOIN b USING (g) JOIN m ON m.id = b.id GROUP BY 1, 2 HAVING count(*) >= 0.75 * any_value(m)
"""
