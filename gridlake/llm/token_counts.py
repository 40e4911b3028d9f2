"""Token counts by separator scan over flat token files without an index.

A token file is nothing but ids, little-endian and of one width, each document ended by the end-of-document id. Files
are cut into blocks of fixed size regardless of documents; a task reads its blocks by byte range and finds all end ids
of a block in one vectorised comparison. A block yields the lengths between its ends, the first of which lacks what
earlier blocks hold of that document. A prefix scan over the blocks of a file stitches these boundaries: the ids since
the last end before a block are carried into it, and the ends before it number its documents.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ROWS, encoder
from .common import cut, new_path

#: Ids of a block.
BLOCK = 1 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def write_flat(docs: DataFrame, folder: str, model: str, end_id: int, kind: str = "<u2") -> DataFrame:
    """Write the documents' ids to flat files, one a task, in the order in which the tasks read them; returns (file,
    ordinal, doc_id) of what it wrote. No text is shuffled.

    A file is written under a name of its own and renamed when whole, so tasks may be run again or twice. A text that
    makes the end id, or an id beyond ``kind``, fails the job: its counts would be wrong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder("library", model), TaskContext.get().partitionId()
        store, root = _open(folder)
        store.create_dir(root)
        draft, ordinal = f"{root}/.draft-{part}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    for ids, _ in coder.encode([t or "" for t in some.column("text").to_pylist()]):
                        if len(ids) and (int(ids.max()) > np.iinfo(kind).max or (ids == end_id).any()):
                            raise ValueError(f"a text holds the end-of-document id {end_id}, or an id that {kind} can't hold")
                        out.write(ids.astype(kind).tobytes() + np.array([end_id], kind).tobytes())
                    n = some.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), some.column("doc_id")], names=["file", "ordinal", "doc_id"])
                    ordinal += n
        if ordinal:
            store.move(draft, f"{root}/part-{part:08d}.ids")
        else:
            store.delete_file(draft)

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", "text").mapInArrow(run, f"file long, ordinal long, doc_id {id_kind}"))


def count_flat(spark: SparkSession, folder: str, end_id: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Per document of the flat files in ``folder``: file, ordinal in it (from 0), n_tokens without the end id, ended.

    Ids after a file's last end are a document that has not ended. Empty files have no documents, and two ends in a row
    enclose an empty one.
    """
    store, root = _open(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if root else []
    width = np.dtype(kind).itemsize
    files = [(int(i.base_name[5:-4]), i.base_name, i.size // width) for i in found if i.base_name.startswith("part-")]
    listed = spark.createDataFrame(files, "file long, name string, n long")  # a row a file
    starts = listed.where("n > 0").select("file", "name", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            rows = batch.to_pydict()
            for file, name, k in zip(rows["file"], rows["name"], rows["block"]):
                with store.open_input_file(f"{root}/{name}") as source:
                    source.seek(k * block * width)
                    ids = np.frombuffer(source.read(block * width), kind)
                ends = np.flatnonzero(ids == end_id)
                runs = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (ends[-1] + 1 if len(ends) else 0)
                columns = [[file], [k], [len(ends)], [tail], [runs]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "ends", "tail", "runs"])

    width_of = max(1, spark.sparkContext.defaultParallelism)
    spread = starts.repartition(max(width_of, sum(-(-n // block) for _, _, n in files) // 16), "file", "block")
    scanned = cut(spread.mapInArrow(run, "file long, block long, ends long, tail long, runs array<long>"))
    order = Window.partitionBy("file").orderBy("block")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = scanned.withColumns({"first": F.coalesce(F.sum("ends").over(ahead), F.lit(0)), "tails": F.coalesce(F.sum("tail").over(ahead), F.lit(0))})
    # tails never fall, so the greatest sum at a block with ends is that of the last such block
    since = F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("tails"))).over(ahead), F.lit(0))
    stitched = sums.withColumns({"carry": F.col("tails") - since, "next": F.lead("block").over(order)})
    inner = stitched.select("file", "first", "carry", F.posexplode("runs").alias("k", "run"))
    ended = inner.select("file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("run") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    open_ = stitched.where(F.col("next").isNull()).select("file", (F.col("first") + F.col("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(open_.where("n_tokens > 0"))


def token_counts(docs: DataFrame, model: str, end_id: int, kind: str = "<u2") -> DataFrame:
    """doc_id, n_tokens, file and ordinal of every document, counted in flat files written to the shared folder.

    Null texts count as empty: no tokens. Rows with a null or a repeated doc_id are documents of their own. Other columns
    are not read, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "flat")
    wrote = write_flat(docs, folder, model, end_id, kind)
    counted = count_flat(spark, folder, end_id, kind)
    return wrote.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
