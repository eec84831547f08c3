"""Document fingerprints (SimHash) and their Hamming neighbourhoods, with DataFrame functions only.

Every distinct word of a text votes on each of 128 bits with the sign of that
bit of its hash and with a weight of 1 to 4 by its document frequency in the
corpus; a bit is 1 if the votes for it outweigh those against. Two counters
share a long in the sums, so a text is one row of 64 sums however long it is.

Words in at least one of 256 documents are the only ones whose weight is below
4. There are at most 256 times as many of those as a document has distinct
words on average, whatever the size of the corpus, so their table is broadcast.

Neighbours are found in permuted block tables: the bits are cut into
``radius + 2`` blocks, and each table is keyed by one choice of two blocks. Two
fingerprints within the radius differ in at most ``radius`` blocks, so they
agree on the key of a table.

Null text is an empty text; a text without words has a fingerprint of zeros.
Rows are ordered by document id (nulls first) and, where ids repeat, by a hash
of the text, so each row has one next row. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .graph import components

BITS = 128
SEPARATORS = r"[\x20\x09-\x0D]+"
SHARE = 256  # words in fewer than 1 / SHARE of the documents have the full weight
FULL = 4
BUCKET_BYTES = 8 << 20
BOUNDS = 512
LANES = (1 << 32) + 1


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), SEPARATORS), ""))


def common_words(docs: DataFrame) -> DataFrame:
    """``h`` and ``weight`` of the words whose weight is below FULL: 1 in a quarter of the rows or more, 2 in a
    32nd, 3 in a SHAREth."""
    total = docs.count()
    words = docs.select(F.explode(distinct_words(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("h"))
    df = words.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") * SHARE >= total)
    weight = F.when(F.col("df") * 4 >= total, 1).when(F.col("df") * 32 >= total, 2).otherwise(3)
    path = scratch_path(docs.sparkSession, "common")
    df.select("h", weight.cast("long").alias("weight")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _any(bits: list[Column]) -> Column:
    while len(bits) > 1:  # a balanced tree
        bits = [bits[i].bitwiseOR(bits[i + 1]) if i + 1 < len(bits) else bits[i] for i in range(0, len(bits), 2)]
    return bits[0]


def vote(texts: DataFrame, keys: list[str], common: DataFrame) -> DataFrame:
    """``keys`` and the two longs ``f0``, ``f1`` of the fingerprint of each row of ``texts`` (``keys``, ``text``)."""
    h = F.xxhash64("word")
    words = (texts.select(*keys, F.explode_outer(distinct_words(F.col("text"))).alias("word"))
             .select(*keys, F.when(F.col("word").isNotNull(), h).alias("h")))
    weighed = words.join(F.broadcast(common), "h", "left").select(  # bounded: see above
        *keys, "h", F.xxhash64("h").alias("g"),
        F.when(F.col("h").isNull(), F.lit(0)).otherwise(F.coalesce("weight", F.lit(FULL))).cast("long").alias("w"))
    sums = [F.sum(F.shiftright(c, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"s{k}_{i}")
            for k, c in enumerate(("h", "g")) for i in range(32)]
    votes = weighed.groupBy(*keys).agg(F.sum("w").alias("total"), *[F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(
        sums, [f"s{k}_{i}" for k in (0, 1) for i in range(32)])])

    def bit(s: str, i: int) -> list[Column]:
        low, high = F.col(s).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(s), 32)
        top = (1 << (i + 32)) - (1 << 64) if i == 31 else 1 << (i + 32)
        return [F.when(low * 2 > F.col("total"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")),
                F.when(high * 2 > F.col("total"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long"))]

    return votes.select(*keys, *[_any([b for i in range(32) for b in bit(f"s{k}_{i}", i)]).alias(f"f{k}") for k in (0, 1)])


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text`` (of the next row by id, the first after the last) of every row, with
    ``bucket`` and ``place``, which name the row; ``guest`` rows are copies that only stand as someone's next.

    Rows are dealt to buckets of neighbouring ids and ordered inside each, so the texts move once. The first row
    of a bucket is also sent to the bucket before, to follow its last.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(least)).cast("long").alias("key"), "doc_id",
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    facts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("octets"),
                     F.percentile_approx("key", [i / BOUNDS for i in range(1, BOUNDS)]).alias("bounds")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = -(-max(facts["octets"] // BUCKET_BYTES, 4 * partitions) // BOUNDS)  # buckets between two bounds
    bounds = sorted(set(facts["bounds"] or []))
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    span = F.size(F.filter(edges, lambda b: b <= F.col("key")))
    if per > 1:  # equal widths between two bounds; the ends are one bucket each
        low, high = F.get(edges, F.col("_span") - 1).cast("double"), F.get(edges, F.col("_span")).cast("double")
        inner = F.least(F.floor((F.col("key") - low) / (high - low) * per), F.lit(per - 1))
        bucket = F.col("_span").cast("long") * per + F.coalesce(inner, F.lit(0))
    else:
        bucket = F.col("_span").cast("long")
    dealt = docs.withColumn("_span", span).withColumn("bucket", bucket).drop("_span").withColumn("h", F.xxhash64("text"))
    # The first row of each bucket: as many rows as there are buckets, one in some megabytes of text.
    firsts = sorted((r["bucket"], r["first"]["key"], r["first"]["h"]) for r in dealt.groupBy("bucket").agg(
        F.min(F.struct("key", "h")).alias("first")).collect())
    sent = spark.createDataFrame([(*f, firsts[i - 1][0]) for i, f in enumerate(firsts)],
                                 "bucket long, key long, h long, before long")
    homes = dealt.join(F.broadcast(sent), ["bucket", "key", "h"], "left")
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    before = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    rows = homes.select("doc_id", "key", "h", "text", F.explode(F.when(F.col("before").isNull(), F.array(home))
                                                                 .otherwise(F.array(home, before))).alias("at"))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "h")
    return rows.select("doc_id", "key", "h", "text", "at.*").select(
        "doc_id", "text", "bucket", "guest", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def likeness(*pairs: tuple[Column, Column]) -> Column:
    """The share of equal bits."""
    return 1 - reduce(lambda a, b: a + b, [F.bit_count(a.bitwiseXOR(b)) for a, b in pairs]) / F.lit(BITS)


def _text(f0: str, f1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text (its last half replaced by as much of the next text's
    start) and that of the next text, with their likeness."""
    common = common_words(docs)
    rows = with_next(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited))
    versions = F.array_compact(F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("text")),
        F.when(~F.col("guest"), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))))
    keys = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    texts = rows.select("bucket", "place", "guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        F.explode(versions).alias("v")).select(*keys, "v.version", "v.text")
    prints = vote(texts, [*keys, "version"], common)
    wide = prints.groupBy(*keys).agg(*[F.max(F.when(F.col("version") == v, F.col(f))).alias(f"{f}_{v}")
                                       for v in (0, 1) for f in ("f0", "f1")])
    order = Window.partitionBy("bucket").orderBy("place")
    wide = wide.withColumns({f"{f}_next": F.lead(f"{f}_0").over(order) for f in ("f0", "f1")}).where(~F.col("guest"))
    path = scratch_path(docs.sparkSession, "prints")
    wide.write.parquet(path)
    c = F.col
    return docs.sparkSession.read.parquet(path).select(
        "doc_id", "n_chars", "edited_sha256", c("f0_0").alias("f0"), c("f1_0").alias("f1"),
        _text("f0_0", "f1_0").alias("fingerprint"), _text("f0_1", "f1_1").alias("edited_fingerprint"),
        likeness((c("f0_0"), c("f0_1")), (c("f1_0"), c("f1_1"))).alias("near_edited"),
        likeness((c("f0_0"), c("f0_next")), (c("f1_0"), c("f1_next"))).alias("near_next"))


# -- block tables ---------------------------------------------------------------------------------


def _masks(radius: int) -> list[tuple[int, int]]:
    """The bits of each block, as masks of the two longs."""
    blocks = radius + 2
    out = []
    for b in range(blocks):
        bits = range(b * BITS // blocks, (b + 1) * BITS // blocks)
        words = [sum(1 << (i % 64) for i in bits if i // 64 == k) for k in (0, 1)]
        out.append(tuple(w - (1 << 64) if w >= 1 << 63 else w for w in words))
    return out


def block_keys(radius: int) -> Column:
    """One key for each table: its two blocks as bits of a number, and the bits in these blocks."""
    masks = _masks(radius)
    keys = []
    for a, b in combinations(range(len(masks)), 2):
        low, high = masks[a][0] | masks[b][0], masks[a][1] | masks[b][1]
        keys.append(F.struct(F.lit(1 << a | 1 << b).cast("long").alias("table"), F.col("f0").bitwiseAND(F.lit(low).cast("long")).alias("k0"),
                             F.col("f1").bitwiseAND(F.lit(high).cast("long")).alias("k1")))
    return F.explode(F.array(*keys))


def _distance(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.f{k}").bitwiseXOR(F.col(f"{b}.f{k}"))) for k in (0, 1)])


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs of a stated query (``q0``, ``q1``) and a fingerprint (``f0``, ``f1``) within ``radius`` bits, once each."""
    tables = prints.select("f0", "f1").distinct().select("f0", "f1", block_keys(radius).alias("t"))
    asked = queries.select(F.col("q0").alias("f0"), F.col("q1").alias("f1")).distinct()
    asked = asked.select("f0", "f1", block_keys(radius).alias("t"))
    return tables.alias("a").join(asked.alias("b"), (F.col("a.t") == F.col("b.t")) & (_distance("a", "b") <= radius)).select(
        F.col("b.f0").alias("q0"), F.col("b.f1").alias("q1"), F.col("a.f0").alias("f0"), F.col("a.f1").alias("f1")).distinct()


def _first_table(a: str, b: str, radius: int) -> Column:
    """The first of the tables on whose key two fingerprints agree: that of their two lowest equal blocks."""
    unlike = [F.col(f"{a}.f{k}").bitwiseXOR(F.col(f"{b}.f{k}")) for k in (0, 1)]
    equal = reduce(lambda x, y: x + y, [
        F.when(unlike[0].bitwiseAND(F.lit(low).cast("long")).bitwiseOR(unlike[1].bitwiseAND(F.lit(high).cast("long"))) == 0,
               F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (low, high) in enumerate(_masks(radius))])
    rest = equal.bitwiseAND(equal - 1)
    return equal.bitwiseAND(-equal).bitwiseOR(rest.bitwiseAND(-rest))


def with_neighbours(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``prints`` with ``n_links``, the number of other rows whose fingerprint is within ``radius`` bits, ``class``, the
    least fingerprint of those that such links connect with the row's own, and ``has_near``, whether it has a link.

    Equal fingerprints collapse first. The block tables give each pair of different ones once, in the first table on
    whose key they agree; the pairs are added up for each fingerprint before they meet the rows.
    """
    spark = prints.sparkSession
    distinct = prints.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("rows"))
    path = scratch_path(spark, "blocks")
    distinct.write.parquet(path)
    distinct = spark.read.parquet(path)
    keyed = distinct.select("f0", "f1", "rows", block_keys(radius).alias("t")).select("f0", "f1", "rows", "t.*")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("table", "k0", "k1")])
    before = (F.col("a.f0") < F.col("b.f0")) | ((F.col("a.f0") == F.col("b.f0")) & (F.col("a.f1") < F.col("b.f1")))
    once = F.col("a.table") == _first_table("a", "b", radius)
    pair = [F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("f0", "f1", "rows")]).alias(x) for x in ("a", "b")]
    path = scratch_path(spark, "pairs")
    keyed.alias("a").join(keyed.alias("b"), same & before & (_distance("a", "b") <= radius) & once).select(*pair).write.parquet(path)
    pairs = spark.read.parquet(path)
    ends = pairs.select("a.f0", "a.f1", F.col("b.rows").alias("n")).union(pairs.select("b.f0", "b.f1", "a.rows"))
    links = ends.groupBy("f0", "f1").agg(F.sum("n").alias("_links"))
    node = [F.struct(f"{x}.f0", f"{x}.f1").alias(x) for x in ("a", "b")]
    classes = components(pairs.select(*node)).select("node.f0", "node.f1", "component")
    known = distinct.join(links, ["f0", "f1"], "left").join(classes, ["f0", "f1"], "left").select(
        "f0", "f1", (F.col("rows") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
        F.coalesce(_text("component.f0", "component.f1"), _text("f0", "f1")).alias("class"))
    table = scratch_path(spark, "near")
    known.withColumn("has_near", F.col("n_links") > 0).write.parquet(table)
    return prints.join(spark.read.parquet(table), ["f0", "f1"])
