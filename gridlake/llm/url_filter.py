"""URL filter: a sorted array of 64-bit digests, memory-mapped, probed by vectorised binary search.

The rule table is written once as two files: the digests in ascending order and the rules' full strings with offsets.
Spark ships both to every executor (``SparkContext.addFile``), workers map them into memory, and all probes of a batch
run through one ``searchsorted``. A digest that is found counts only after the stored string equals the probed one, so
colliding digests can't decide. Nothing is shuffled: one pass over the two columns that are needed.

A rule is ``host`` + ``path``: it fits the host and all its subdomains if the url's path starts with its path. A url is
probed with each suffix of its host at a label boundary and each path length that occurs in the table.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the production query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The table is held once per worker; larger lists are refused rather than shipped without a bound.
MOST_RULES = 20_000_000


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def write_table(rules, folder: str) -> str:
    """Write the digest array of ``rules`` into ``folder``; returns the common name of its files.

    Of rules with the same host and path the last one counts.
    """
    table = {f"{h}\n{p}".encode(): (v, len(h.encode())) for v, h, p in rules}
    if len(table) > MOST_RULES:
        raise ValueError(f"{len(table)} rules; the digest array takes {MOST_RULES}")
    keys = sorted(table, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    name = f"rules-{uuid.uuid4().hex}"
    np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8").tofile(f"{folder}/{name}.keys")
    ends = np.cumsum([0, *map(len, keys)]).astype("<i8")
    lengths = sorted({len(k.split(b"\n", 1)[1]) for k in keys})
    with open(f"{folder}/{name}.text", "wb") as out:
        out.write(np.array([len(keys), len(lengths)], "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + ends.tobytes())
        out.write(bytes(table[k][0] == "block" for k in keys) + b"".join(keys))
    return name


@functools.cache
def _driver_folder() -> str:
    """Where the driver keeps tables while it serves them; executors that start later fetch them too."""
    folder = tempfile.mkdtemp(prefix="gridlake-rules-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


class DigestArray:
    """The mapped table: ``find`` gives the rule number of each probe, -1 for none."""

    def __init__(self, stem: str):
        text = np.memmap(f"{stem}.text", np.uint8, "r")
        n, m = text[:16].view("<i8")
        self.keys = np.memmap(f"{stem}.keys", "<u8", "r") if n else np.zeros(0, "<u8")
        self.lengths = [int(x) for x in text[16 : 16 + 8 * m].view("<i8")]
        at = 16 + 8 * m
        self.ends = text[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.block, self.text = text[at : at + n], text[at + n :]

    def string(self, k: int) -> bytes:
        return self.text[self.ends[k] : self.ends[k + 1]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(probes), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)) if len(self.keys) else ():
            k = at[i]
            while k < len(self.keys) and self.keys[k] == digests[i]:  # all strings of this digest
                if self.string(k) == probes[i]:
                    found[i] = k
                    break
                k += 1
        return found


def _judge(table: DigestArray, hosts: list[str], paths: list[str]) -> tuple[list, list]:
    rules, verdicts = [None] * len(hosts), ["allow"] * len(hosts)
    probes, owner = [], []
    for i, (h, p) in enumerate(zip(hosts, paths)):
        if not h:
            continue
        h, p = h.encode(), p.encode()
        starts = [0, *(j + 1 for j, c in enumerate(h) if c == 46)]
        for n in table.lengths:
            if n <= len(p):
                end = b"\n" + p[:n]
                probes += [h[s:] + end for s in starts]
                owner += [i] * len(starts)
    best: dict[int, tuple[int, int, int]] = {}
    found = table.find(probes)
    for j in np.flatnonzero(found >= 0):
        key = (len(probes[j]), probes[j].index(b"\n"), int(found[j]))
        best[owner[j]] = max(best.get(owner[j], key), key)
    for i, (_, _, k) in best.items():
        rules[i] = table.string(k).replace(b"\n", b"").decode()
        verdicts[i] = "block" if table.block[k] else "allow"
    return rules, verdicts


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` of ``pages`` with host, path, rule (null if none fits) and verdict for ``url``.

    The longest rule that fits decides (of equal length the one with the longer host); urls that no rule fits are
    allowed, for they are not in the table. Null urls and urls without ``://`` have empty host and path and are allowed.
    Repeated rows are judged each; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    folder = _driver_folder()
    name = write_table(rules, folder)
    for kind in ("keys", "text"):
        spark.sparkContext.addFile(os.path.join(folder, f"{name}.{kind}"))
    slim = pages.select(*keep, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestArray(os.path.join(SparkFiles.getRootDirectory(), name))
        for batch in batches:
            got = _judge(table, batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got[0], pa.string()), pa.array(got[1], pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(run, f"{kinds}, rule string, verdict string")
