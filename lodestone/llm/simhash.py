"""SimHash fingerprints, and all fingerprints within a Hamming radius of given ones.

The terms of a text are its pairs of neighbouring words (a single word is its own), weighted by how
often they occur. Each votes on 64 signed bits. Votes are counted for four bits at a time, in lanes
of one long. Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.llm.common import aside, without

BITS = 64
RADIUS = 3
# Fingerprints are cut into blocks; within the radius, all but RADIUS blocks agree.
BLOCKS = 6
# Terms counted in one lane, which has 16 bits.
_CHUNK = 60_000
_LANES = 0x0001000100010001
# Bytes of text sorted together when documents are put in order.
SORTED_BYTES = 8 << 20


def terms(text: Column) -> Column:
    """Hashes of the neighbouring words of a text, one for each occurrence."""
    words = F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("_words") - 1), lambda i: F.xxhash64(F.get("_words", i - 1), F.get("_words", i)))
    return words, F.when(F.size("_words") > 1, pairs).otherwise(F.transform("_words", lambda w: F.xxhash64(w)))


def _lane_sum(lane: int):
    return lambda total, a: total + F.shiftrightunsigned(a, lane).bitwiseAND(F.lit(0xFFFF))


def _with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the fingerprint of a text as a long; of a text without words it is 0.

    The steps are columns of their own, so that each is worked out once.
    """
    words, hashes = terms(F.lower(text))
    keep = [F.col(f"`{c}`") for c in df.columns]
    held = df.select(*keep, words.alias("_words")).select(*keep, hashes.alias("_terms"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_terms") - 1, F.lit(0)), F.lit(_CHUNK)), lambda i: F.slice("_terms", i + 1, _CHUNK)
    )
    held = held.select(*keep, F.size("_terms").alias("_n"), chunks.alias("_chunks"))

    def lanes(shift: int) -> Column:
        one = lambda total, h: total + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_LANES))
        return F.transform("_chunks", lambda c: F.aggregate(c, F.lit(0).cast("long"), one))

    held = held.select(*keep, "_n", *[lanes(s).alias(f"_l{s}") for s in range(16)])
    bits = []
    for bit in range(BITS):
        lane = 16 * (bit // 16)
        votes = F.aggregate(f"_l{bit % 16}", F.lit(0).cast("long"), _lane_sum(lane))
        bits.append(F.when(2 * votes > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    whole = bits[0]
    for b in bits[1:]:
        whole = whole.bitwiseOR(b)
    return held.select(*keep, whole.alias(name))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Every row with its fingerprint as a long; a column of that name is replaced.

    Null and empty texts, and those without a letter or number, have the fingerprint 0. Equal texts
    have equal ones. A text of any length is used whole. Nothing is shuffled.
    """
    base, back = aside(without(docs, [name]), keep=[text])
    return back(_with_fingerprint(base, F.coalesce(F.col(text), F.lit("")), name))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of bits that agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def with_next(docs: DataFrame, id: str, text: str, also: list[str], sorted_bytes: int = SORTED_BYTES) -> DataFrame:
    """Every row with the text (``next_<text>``) and other columns of the next row in descending order of id.

    After the last comes the first. Rows that share an id are ordered by the hash of
    their text; rows without one come last. Ranges of ids of bounded size are sorted by
    themselves. The first row of each also stands, as a guest, at the end of the one before,
    so the texts are shuffled once.
    """
    docs, back = aside(without(docs, [f"next_{c}" for c in [text, *also]]), keep=[id, text, *also])
    key = F.coalesce(F.col(id).cast("long"), F.lit(-(2**63)))
    size = F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 64)
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.max(key).alias("top"), size.alias("b")).first()
    if total["top"] is None:
        return back(docs).select("*", F.col(text).alias(f"next_{text}"), *[F.col(c).alias(f"next_{c}") for c in also])
    n = max(least, -(-total["b"] // sorted_bytes))
    # quantiles are ids of rows, so each is the first of its range
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("c")).first()["c"]
    bounds = sorted({total["top"], *cuts}, reverse=True)
    steps = F.lit([1 << i for i in reversed(range(max(1, (len(bounds) - 1).bit_length())))])
    table = F.lit(bounds)
    found = F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.coalesce(F.get(table, low + s) >= F.col("_key"), F.lit(False)), low + s).otherwise(low))
    # on the last step before a bound that is absent the search stays where it is
    placed = docs.withColumn("_key", key).withColumn("_range", found)
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guest"))
    first = F.col("_key") == F.get(table, F.col("_range"))
    dealt = placed.select(*[f"`{c}`" for c in docs.columns], "_key", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("_p"))
    order = W.partitionBy("_p.range").orderBy("_p.guest", F.desc("_key"), F.xxhash64(text))
    ahead = [F.lead(c).over(order).alias(f"next_{c}") for c in [text, *also]]
    return back(dealt.select(*[f"`{c}`" for c in docs.columns], "_p", *ahead).filter("NOT _p.guest").drop("_p"))


def near_counts(prints: DataFrame, wanted: DataFrame, fingerprint: str = "fingerprint", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For each wanted fingerprint (the long column ``q``), how many rows of ``prints`` lie within the radius.

    Equal fingerprints are one entry. For every choice of ``blocks - radius`` blocks there is a
    table keyed by them; two fingerprints within the radius agree in at least one, and only entries
    that do are compared. Columns ``q`` and ``n_near``, a wanted one's own rows included.
    """
    width = BITS // blocks
    edges = [i * width for i in range(blocks)] + [BITS]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(df: DataFrame, column: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("t"), F.col(column).bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(signed)]
        return df.select("*", F.inline(F.array(*keys)))

    entries = prints.groupBy(F.col(fingerprint).alias("f")).agg(F.count("*").alias("n"))
    queries = wanted.select("q").distinct()
    met = tables(entries, "f").join(tables(queries, "q"), ["t", "k"]).filter(F.bit_count(F.col("f").bitwiseXOR(F.col("q"))) <= radius)
    return met.select("q", "f", "n").distinct().groupBy("q").agg(F.sum("n").alias("n_near"))
