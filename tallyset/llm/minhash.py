"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles are its runs of five words (all of its words, if fewer); each is hashed once to 64 bits. The high
bits of a hash name one of `bins` bins, and a bin keeps its least hash. An empty bin takes the value of a filled bin by
optimal densification: every empty bin has its own random order of all bins, and the first filled one in that order
lends its value, so two texts that share filled bins lend alike. Stored are the low `low_bits` bits of each bin, as hex.
The likeness of two fingerprints is the share of equal bins, corrected for the chance 2^-low_bits that two different
values agree, within 0 and 1.

Null or empty text, and text without a word: the empty fingerprint, whose likeness to another empty one is 1 and to any
other 0. Equal texts have equal fingerprints, so repeated rows do. Rows with one doc_id follow each other by a hash of the
text, and rows without a doc_id come last in that order. Columns but doc_id and text are not read. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

BINS_LOG2, LOW_BITS, SHINGLE = 8, 8, 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, width: int = SHINGLE) -> Column:
    """The hash of each run of `width` words; of all words if there are fewer; no hash without words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(width)]))
    return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(words, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def bin_of(h: Column, log2: int) -> Column:
    """0 to 2**log2 - 1, in the order of signed hashes."""
    return (F.shiftright(h, 64 - log2) + (1 << (log2 - 1))).cast("int")


def minima(hashes: Column, log2: int) -> Column:
    """The least hash of each filled bin, in the order of bins."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h, log2) != bin_of(F.get(s, i - 1), log2))))


def spread(least: Column, log2: int) -> Column:
    """A value for each bin, null where it is empty."""
    none = F.lit(None).cast("long")

    def step(h: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(bin_of(F.get(least, i - 1), log2))
        return F.concat(F.array_repeat(none, bin_of(h, log2) - before - 1), F.array(h))

    tail = F.array_repeat(none, (1 << log2) - 1 - bin_of(F.element_at(least, -1), log2))
    return F.when(F.size(least) == 1 << log2, least).otherwise(F.concat(F.flatten(F.transform(least, step)), tail))


def densified(least: Column, log2: int, probes: int = 16) -> Column:
    """A value for every bin: its own, or that of the filled bin that comes first in the bin's own random order. The
    order starts with `probes` hashed bins and goes on with all bins by a hash; a later one is looked at only if none
    before it is filled."""
    bins = 1 << log2

    def value(all_: Column, b: Column) -> Column:
        first = [F.get(all_, F.pmod(F.xxhash64(b, F.lit(k)), F.lit(bins)).cast("int")) for k in range(probes)]
        rest = F.array_min(F.transform(least, lambda h, i: F.xxhash64(b, bin_of(h, log2)).bitwiseAND(-bins).bitwiseOR(i.cast("long"))))
        return F.coalesce(F.get(all_, b), *first, F.get(least, rest.bitwiseAND(bins - 1).cast("int")))

    filled = let(spread(least, log2), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: value(all_, b)))
    return F.when(F.size(least) == bins, least).when(F.size(least) > 0, filled).otherwise(F.array().cast("array<bigint>"))


def codes(text: Column, log2: int = BINS_LOG2, low_bits: int = LOW_BITS, width: int = SHINGLE) -> Column:
    """The low bits of each bin's value, less half their range, as bytes; of a text without words, none."""
    low = lambda v: (v.bitwiseAND((1 << low_bits) - 1) - (1 << (low_bits - 1))).cast("tinyint")
    return let(words_of(text), lambda w: let(minima(shingle_hashes(w, width), log2), lambda m: F.transform(densified(m, log2), low)))


def packed(code: Column, low_bits: int = LOW_BITS) -> Column:
    """The fingerprint as lowercase hex."""
    digits = (low_bits + 3) // 4
    return F.lower(F.array_join(F.transform(code, lambda v: F.lpad(F.hex(v.cast("int") + (1 << (low_bits - 1))), digits, "0")), ""))


def likeness(a: Column, b: Column, low_bits: int = LOW_BITS) -> Column:
    """The estimated share of common shingles, from the codes of two texts."""
    chance = 2.0**-low_bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    fair = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(fair)


def edited(text: Column, following: Column) -> Column:
    """text with its last third replaced by the first as many characters of the following text, or all of it."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


#: Quantiles of doc_id that are told apart, at most, in two steps of at most their root.
MOST_RANGES = 4096


def ranges(docs: DataFrame, per_bucket: int) -> tuple[Column, Column, bool]:
    """(o, sub): the bucket of a row of docs (doc_id, h), such that rows by descending doc_id (nulls last) and h come by
    descending o and ascending sub; and whether some doc_id has so many rows that equal rows should go as one.

    o tells quantiles of doc_id apart, and doc_ids that fill a quantile from others. sub cuts what still has over per_bucket
    rows: a quantile by doc_id, a doc_id (or none) by h."""
    s = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    n, k = s.known, max(1, min(MOST_RANGES, -(-s.known // per_bucket)))
    shares = F.array(*[F.lit(i / k) for i in range(k)] or [F.lit(0.0)])
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * k).alias("q"), F.max("doc_id").alias("high")).first() if n else None
    bounds = sorted({int(q) for q in found.q}) if n else [0]
    filled = sorted({int(q) for q in bounds if list(found.q).count(q) > 1}) if n else []
    high = int(found.high) if n else 0
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    block = F.greatest(at_most(longs([b[0] for b in blocks])), F.lit(1))
    place = ((block - 1) * step + at_most(F.element_at(F.array(*[longs(b) for b in blocks]), block))).cast("long")  # of the last bound not above
    fills = F.array_contains(longs(filled), F.col("doc_id")) if filled else F.lit(False)
    o = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(2 * place + F.when(fills, 0).otherwise(1)).cast("long")
    cuts = max(1, -(-n // (k * per_bucket)))
    low = F.get(longs([bounds[0], *bounds]), place.cast("int")).cast("decimal(20,0)")
    top = F.get(longs([*bounds, high + 1]), place.cast("int")).cast("decimal(20,0)")
    by_id = -F.floor((F.col("doc_id").cast("decimal(20,0)") - low) * cuts / F.greatest(top - low, F.lit(1)))
    by_h = lambda m: F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * max(1, m))
    rows_of_one = max(-(-n // per_bucket), 1)
    sub = F.when(F.col("doc_id").isNull(), by_h(-(-(s.n - n) // per_bucket))).when(fills, by_h(rows_of_one)).otherwise(by_id if cuts > 1 else F.lit(0)).cast("long")
    return o, sub, bool(filled) or s.n - n > per_bucket


def with_next(docs: DataFrame, per_bucket: int = 1024) -> DataFrame:
    """docs (doc_id, text) with code and next (text, code): those of the next row by descending doc_id, nulls last; after the last
    row comes the first. Rows are dealt into ranges of doc_id of about per_bucket rows; only the first row of each range
    is looked at across ranges."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    o, sub, crowded = ranges(rows, per_bucket)
    dealt = rows.select("doc_id", "text", "h", o.alias("o"), sub.alias("sub"), F.lit(1).cast("long").alias("n"))
    if crowded:  # equal rows go as one
        dealt = dealt.groupBy("doc_id", "text", "h", "o", "sub").agg(F.count("*").alias("n"))
    dealt = dealt.withColumn("code", codes(F.col("text")))
    order = Window.partitionBy("o", "sub").orderBy(F.col("doc_id").desc_nulls_last(), "h")
    near = dealt.withColumn("next", F.lead(F.struct("text", "code")).over(order)).withColumn("last", F.lead("o").over(order).isNull())
    # the first row of each range, moved to the range before it
    first = F.struct(-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)"), "h")
    tops = dealt.groupBy("o", "sub").agg(F.min_by("text", first).alias("top"))
    ends = dealt.groupBy("o").agg(F.max("sub").alias("sub"))  # two for each quantile at most
    chain = Window.orderBy(F.col("o").desc())
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = ends.select("o", F.coalesce(F.lag(F.struct("o", "sub")).over(chain), F.last(F.struct("o", "sub")).over(whole)).alias("above"))
    tops = tops.withColumn("before", F.lag("sub").over(Window.partitionBy("o").orderBy("sub"))).join(above, "o")
    to = F.when(F.col("before").isNull(), F.col("above")).otherwise(F.struct("o", F.col("before").alias("sub")))
    tops = tops.select(to["o"].alias("o"), to["sub"].alias("sub"), F.lit(True).alias("last"), F.struct(F.col("top").alias("text"), codes(F.col("top")).alias("code")).alias("top"))
    found = near.join(tops, ["o", "sub", "last"], "left").withColumn("next", F.when(F.col("last"), F.col("top")).otherwise(F.col("next")))
    if crowded:  # all but the last of equal rows are followed by their like
        each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
        found = found.select("*", each).withColumn("next", F.when(F.col("copy") < F.col("n"), F.struct("text", "code")).otherwise(F.col("next")))
    return found.select("doc_id", "text", "code", "next")


def edits(docs: DataFrame) -> DataFrame:
    """The fingerprints of each document, of its edited text, and their likeness; see edited() and with_next()."""
    pairs = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    out = pairs.withColumn("changed", edited(F.col("text"), F.col("next.text"))).withColumn("edited_code", codes(F.col("changed")))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), packed(F.col("code")).alias("fingerprint"), packed(F.col("edited_code")).alias("edited_fingerprint"),
        likeness(F.col("code"), F.col("edited_code")).alias("near_edited"), likeness(F.col("code"), F.col("next.code")).alias("near_next"),
    )
