"""URL filter over a sorted digest array: rules and block lists of hosts and paths.

An entry is a host and the start of a path. Its string (both joined; a host has no slash, so the string says where it ends) is
hashed by 64-bit xxhash. Keys are sorted by Spark and written with their strings into one file, which the context hands
to every executor; a replaced executor fetches it again. Tasks map the file into memory, so the workers of one machine
share its pages and none of them loads it. A batch of URLs gives the strings of those of its host suffixes and path starts whose
lengths occur in the list; their keys are found by one vectorised binary search, and a found key counts
only where the stored string is the same. No row of URLs is exchanged, whatever hosts they crowd on.

The file may take `LIMIT` bytes. A longer list is joined instead: distinct (host, path) pairs and their strings meet the
entries by string, which gives the same results.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the
end. Both are empty for a null URL or one without `://`. An entry fits its host and all subdomains if the path starts
with its path. The longest fitting rule decides (of equal length the longer host), and a URL without one is blocked
if a blocked entry fits it, else allowed. Entries without host (null) are left out, a null path is an empty one; of equal
entries rules count before others, then a blocking one before an allowing one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from guichet.llm.common import parts, staged

LIMIT = 256 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_RULE, _BLOCK = 1, 2
_OUT = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([xxhash.xxh64_intdigest(e) for e in batch.column("entry").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], names=["key", *batch.schema.names])


def digest_table(entries: DataFrame) -> DataFrame:
    """(key, entry, flags, host_length, path_length), sorted by key: the distinct entries of `entries(host, path, rule, verdict)`."""
    path = F.coalesce("path", F.lit(""))
    host = F.translate("host", _UPPER, _LOWER)
    flags = F.when(F.col("rule"), _RULE).otherwise(0) + F.when(F.col("verdict") == "block", _BLOCK).otherwise(0)
    one = entries.where("host is not null").select(F.concat(host, path).alias("entry"), F.struct("rule", (F.col("verdict") == "block").alias("block"), flags.alias("flags"), F.length(host).alias("h"), F.length(path).alias("p")).alias("is"))
    one = one.groupBy("entry").agg(F.max("is").alias("is")).select("entry", F.col("is.flags").cast("int").alias("flags"), F.col("is.h").alias("host_length"), F.col("is.p").alias("path_length"))
    keyed = one.mapInArrow(_keys, "key bigint, entry string, flags int, host_length int, path_length int")
    return staged(keyed.repartitionByRange(parts(entries.sparkSession), "key").sortWithinPartitions("key"), "digests")


class DigestArray:
    """The file of a digest table, mapped: keys, flags and ends of the strings as arrays, then the strings."""

    def __init__(self, path: str, count: int):
        part = lambda kind, start, size: np.memmap(path, kind, "r", start, (size,)) if size else np.zeros(0, kind)
        self.keys, self.ends = part(np.int64, 0, count), part(np.int64, 8 * count, count)
        self.flags = part(np.uint8, 16 * count, count)
        self.text = part(np.uint8, 17 * count, os.path.getsize(path) - 17 * count)

    @staticmethod
    def write(path: str, sorted_rows: pa.Table) -> None:
        strings = [e.encode() for e in sorted_rows.column("entry").to_pylist()]
        with open(path, "wb") as out:
            out.write(sorted_rows.column("key").to_numpy().astype(np.int64).tobytes())
            out.write(np.cumsum([len(e) for e in strings], dtype=np.int64).tobytes())
            out.write(sorted_rows.column("flags").to_numpy().astype(np.uint8).tobytes())
            out.write(b"".join(strings))

    def flags_of(self, strings: list[str]) -> list[int | None]:
        """Flags of each string that is an entry; keys that are equal by chance are passed over."""
        found: list[int | None] = [None] * len(strings)
        keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64).view(np.int64)
        at = np.searchsorted(self.keys, keys)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else []
        for i in hits:
            k, text = int(at[i]), strings[i].encode()
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.text[(self.ends[k - 1] if k else 0) : self.ends[k]].tobytes() == text:
                    found[i] = int(self.flags[k])
                    break
                k += 1
        return found


def _fitting(host: str, path: str, hosts: frozenset[int], paths: list[int]) -> Iterator[tuple[str, int]]:
    """Strings of the entries that would fit, with the length of their host; only lengths that the list has."""
    at = 0
    while True:
        if len(host) - at in hosts:
            for n in paths:
                if n > len(path):
                    break
                yield host[at:] + path[:n], len(host) - at
        at = host.find(".", at) + 1
        if not at:
            return


def _judging(name: str, count: int, hosts: frozenset[int], paths: list[int]) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name), count)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                yield judged(batch.slice(start, 4096), array)

    def judged(batch: pa.RecordBatch, array: DigestArray) -> pa.RecordBatch:
        strings, sizes, rows = [], [], []
        for row, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
            for text, size in _fitting(host, path, hosts, paths):
                strings.append(text)
                sizes.append(size)
                rows.append(row)
        best: list[tuple | None] = [None] * batch.num_rows
        listed = [False] * batch.num_rows
        for row, text, size, flags in zip(rows, strings, sizes, array.flags_of(strings)):
            if flags is None:
                continue
            if flags & _RULE:
                best[row] = max(best[row] or (-1, -1, "", 0), (len(text), size, text, flags))
            elif flags & _BLOCK:
                listed[row] = True
        rule = [b[2] if b else None for b in best]
        verdict = ["block" if (b[3] & _BLOCK if b else hit) else "allow" for b, hit in zip(best, listed)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return judge


def _joined(urls: DataFrame, table: DataFrame, paths: list[int]) -> DataFrame:
    """The same verdicts by joins: fitting strings of distinct hosts and paths meet the entries."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in paths]), lambda n: n <= F.length("path")) if paths else F.array().cast("array<int>")
    pages = urls.select("host", "path").distinct()
    strings = pages.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(starts).alias("n"))
    strings = strings.select("host", "path", F.length("suffix").alias("size"), F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("n"))).alias("entry"))
    met = strings.join(table.select("entry", "flags"), "entry")
    is_rule, blocks = F.col("flags").bitwiseAND(_RULE) > 0, F.col("flags").bitwiseAND(_BLOCK) > 0
    best = met.groupBy("host", "path").agg(F.max(F.when(is_rule, F.struct(F.length("entry").alias("n"), "size", "entry", blocks.alias("block")))).alias("best"), F.max(~is_rule & blocks).alias("listed"))
    block = F.coalesce(F.col("best.block"), F.col("listed"), F.lit(False))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("best.entry").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, entries: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), limit: int = LIMIT) -> DataFrame:
    """The `keep` columns of `pages` with host, path, rule (string of the deciding rule, else null) and verdict (allow or block).

    `entries(host, path, rule, verdict)` holds rules and plain list entries. Repeated rows stay. Columns not kept are not
    read; a kept one may not bear the name of a result.
    """
    if set(keep) & set(_OUT):
        raise ValueError(f"kept columns may not be named {', '.join(_OUT)}")
    spark = pages.sparkSession
    table = digest_table(entries)
    urls = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("entry") + 17), F.lit(0)).alias("bytes"), F.collect_set("host_length").alias("hosts"), F.collect_set("path_length").alias("paths")).first()
    if size["bytes"] > limit:
        return _joined(urls, table, sorted(size["paths"]))
    name = f"urls-{uuid.uuid4().hex}.digests"
    path = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)  # the driver serves it from here; executors keep their own
    DigestArray.write(path, table.select("key", "entry", "flags").orderBy("key").toArrow())
    spark.sparkContext.addFile(path)
    schema = StructType([*urls.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return urls.mapInArrow(_judging(name, size["n"], frozenset(size["hosts"]), sorted(size["paths"])), schema)
