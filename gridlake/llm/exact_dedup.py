"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut where its own content says so (after a sentence or line end, between a least and a most length), so that
texts which share a stretch share its chunks. Chunks get 128-bit identifiers, and one aggregation over the distinct
(identifier, chunk) pairs verifies that no identifier names two chunks; should one ever do, the next, wider kind of
identifier is taken, in the end the chunk itself. After that, two texts are equal exactly when their ordered
identifier lists are, and only those lists (16 bytes for a few thousand characters) are shuffled and compared:
documents move no text beyond the one, map-side combined, aggregation of distinct chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, without_rows

#: Least and most characters of a chunk.
LEAST, MOST = 1024, 8192


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text in order as content-defined chunks; their concatenation is the text, an empty text has none."""
    pattern = rf"(?s).{{{least - 1},{most - 1}}}?[\n.!?]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _two_lanes(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


#: Kinds of identifiers, each wider than the one before; the last can't collide.
IDENTIFIERS = (_two_lanes, lambda c: F.sha2(c, 512), lambda c: c)


def verified(text: DataFrame, identifiers=IDENTIFIERS, least: int = LEAST, most: int = MOST):
    """The first kind of identifier under which every chunk of column ``text`` has an identifier of its own."""
    pieces = text.select(F.explode(chunks(F.col("text"), least, most)).alias("chunk"))
    for identifier in identifiers[:-1]:
        pairs = pieces.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
        if not pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            return identifier
    return identifiers[-1]


def groups(docs: DataFrame, identifiers=IDENTIFIERS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the text's xxhash64.

    Equal texts form a group; the row with the largest doc_id stays, a null doc_id being smaller than any. Rows that
    repeat doc_id and text are copies like others: one of them stays, which one makes no difference. Null texts count
    as empty and all empty texts are equal. An empty table gives an empty result; other columns play no part.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    identifier = verified(texts, identifiers, least, most)
    recipe = F.transform(chunks(F.col("text"), least, most), identifier)
    rows = cut(
        texts.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"),
            F.xxhash64("text").alias("text_xxh64"), recipe.alias("recipe"),
        )
    )
    # a copy's row number is taken from the materialised rows, so it is the same in both uses
    top = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    # a table of its own, so that the join may split the rows of a large group
    many = cut(top.where("group_size > 1").select(F.col("recipe").alias("same"), "top", "group_size"))
    joined = rows.join(many, F.col("recipe") == F.col("same"), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"),
        "text_sha256",
        "text_xxh64",
    )


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    found = groups(docs, **options)
    away = found.where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(text, 256)}
    return without_rows(docs, keys, away.select("doc_id", "text_sha256"))
