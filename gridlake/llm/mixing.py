"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Every source gets a target number of words. A document's expected copies are target / source size; within a source
the expected copies are prefix-summed in a fixed order, one random offset is added, and a document is emitted once for
each integer boundary that its stretch of the sum crosses. The order goes by size class first, so that each class is
drawn evenly and the words taken come near the target.

The prefix sum is taken in two levels, so that no task ever holds a source: the rows are counted by (source, size
class, digest bucket), a window sums these counts over the few thousand buckets of a source, and a second window ranks
the rows inside one bucket only. A source with a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, cut, free_name

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is repeated this often at most.
MOST = 3
#: Hexadecimal digits of a document's digest that number the buckets within a size class: 16 ** 2 buckets.
DIGITS = 2


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Sortable class of a size: its bit length and its five leading bits, so sizes in a class differ by 1/16 at most."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 5))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Targets of (source, source_size): the total is shared by weight, none above ``most`` times its source.

    What a capped source can't take is shared again by weight. In the order of cap / weight the capped sources come
    first, so one pass finds the level at which the rest shares (a window over the sources, one row each).
    """
    k = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = before.rowsBetween(Window.unboundedPreceding, -1)
    rest = before.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    leveled = weighed.withColumn("level", level)
    first = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    found = leveled.withColumn("shared", first.over(whole).getField("level"))
    target = F.when(F.col("shared").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("shared") * F.col("weight")))
    return found.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of ``docs``, written once, so that no text is read or counted again."""
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, digits: int = DIGITS, seed: str = "", size: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document).

    ``size`` is an expression over ``docs``, by default the number of words of its column text. Columns of ``docs`` with
    these names are replaced. Null texts have size 0; a null source is a source of its own,
    the last one; a null doc_id sorts by the digest of an empty id; repeated rows are documents of their own. Rows that
    tie in size, id and digest are interchangeable: their copies may be dealt either way. An empty table gives none.
    """
    made = {"size", "source_size", "target", "copies"}
    kept = [c for c in docs.columns if c.lower() not in made]
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    names = {k: free_name(docs, k) for k in ("mix_class", "mix_digest", "mix_bucket", "mix_rank", "mix_before", "mix_rate", "mix_u")}
    n = {k: col(v) for k, v in names.items()}
    size = n_words(F.col("text")) if size is None else size
    base = docs.select(*[col(c) for c in kept], size.alias("size"))
    keyed = base.withColumns({names["mix_class"]: _size_class(F.col("size")), names["mix_digest"]: digest})
    keyed = keyed.withColumn(names["mix_bucket"], F.substring(n["mix_digest"], 1, digits))

    slim = docs.select("source", size.alias("size"), digest.alias("d"))
    counts = slim.groupBy("source", _size_class(F.col("size")).alias("c"), F.substring("d", 1, digits).alias("b"))
    counts = cut(counts.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")))  # for two uses one count
    plan = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("c", "b").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2.0**32
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    a, b = summed.alias("a"), plan.withColumns({"rate": rate, "u": offset}).alias("b")
    buckets = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").alias("s"), "c", "b", "before", "source_size", "target", "rate", "u")

    inside = Window.partitionBy(col("source"), n["mix_class"], n["mix_bucket"]).orderBy(n["mix_digest"], F.col("size"))
    ranked = keyed.withColumn(names["mix_rank"], F.row_number().over(inside))
    hit = ranked["source"].eqNullSafe(buckets["s"]) & (n["mix_class"] == F.col("c")) & (n["mix_bucket"] == F.col("b"))
    joined = ranked.join(buckets, hit)
    upto = F.floor((F.col("before") + n["mix_rank"]) * F.col("rate") + F.col("u"))
    below = F.floor((F.col("before") + n["mix_rank"] - 1) * F.col("rate") + F.col("u"))
    copies = F.least((upto - below).cast("long"), F.lit(most).cast("long"))
    return joined.select(*[col(c) for c in kept], "size", "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    plan = mix(docs, **options)
    copy = free_name(plan, "mix_copy")
    out = plan.where(F.col("copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[col(c) for c in docs.columns if c in plan.columns])
