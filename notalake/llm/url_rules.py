"""URL filters: allow and block rules kept as a sorted digest array.

The index is one file: sorted 64-bit xxhash keys, offsets, and the full rule strings. Tasks map it
into memory, look candidates up with a vectorised binary search, and compare the stored string, so a
digest collision never decides. A rule (host, path) fits its host and all subdomains when the url's
path starts with the rule's; the longest rule wins, at equal length the one with the longer host.

Candidates of a url are its host suffixes at label borders, each with the path prefixes whose length
some rule has. Executors make the index out of a table of rules, as files of one digest range each. The
files are shipped through the shared folder and probed one after the other in the same pass over the
urls, so rule tables of any size take one way, and the driver holds one file of `shard_bytes` at a time.

Defined results: a null url, or one without "://", has empty host and path and gets the default
verdict; a rule given twice counts once, and block wins over allow; no rules leave the default
verdict everywhere; repeated urls are judged alike; other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, shared_folder, stored, table
from .registry import query

Rule = tuple[str, str, str]  # host, path, verdict
SHARD_BYTES = 32 << 20  # of an index file, about
BORDER = "\x00"  # between host and path in a key: neither part of a url can hold it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, as stated in the module text; both empty without "://"."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + F.lit(3), F.char_length(known))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(host: str, path: str) -> bytes:
    return f"{host}{BORDER}{path}".encode()


def _index_of(strings: list[bytes], digests: np.ndarray, block: np.ndarray) -> bytes:
    """An index file of distinct keys in the order of their digests: counts, keys, offsets, path lengths, verdicts, strings; all little-endian."""
    lengths = sorted({len(k[k.index(BORDER.encode()) + 1 :].decode()) for k in strings})
    parts = [
        np.array([len(strings), len(lengths)], "<u8"),
        digests.astype("<u8"),
        np.cumsum([0, *map(len, strings)]).astype("<u8"),
        np.array(lengths, "<u8"),
        block.astype("u1"),
    ]
    return b"".join([p.tobytes() for p in parts] + strings)


def index_bytes(rules: Iterable[Rule]) -> bytes:
    """The index file of a handful of rules; `shards` makes those of a table."""
    chosen: dict[bytes, bool] = {}
    for host, path, verdict in rules:
        key = _key(host, path)
        chosen[key] = chosen.get(key, False) or verdict == "block"
    ordered = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in chosen.items())
    return _index_of([k for _, k, _ in ordered], np.array([d for d, _, _ in ordered], np.uint64), np.array([v for _, _, v in ordered], bool))


def shards(rules: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Index files (shard, content) of a table of rules, each a range of digests of about `shard_bytes` at most, and their number.

    Executors digest, sort and write them; a rule that comes twice is there once, and blocks if either does.
    """
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.lit(18))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(size, 1) / shard_bytes)))
    once = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
            shard = (digests >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
            # signed numbers in the order of the unsigned ones
            order = (digests ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(order), pa.array(keys, pa.binary()), batch.column("verdict")], ["shard", "digest", "key", "verdict"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            part = pa.Table.from_batches(parts)
            digests = part["digest"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            content = _index_of(part["key"].to_pylist(), digests, np.array([v == "block" for v in part["verdict"].to_pylist()], bool))
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([content], pa.binary())], ["shard", "content"])

        held, parts = None, []
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1], [True]))).tolist() if len(numbers) else []
            for x, y in zip(edges, edges[1:]):
                if parts and numbers[x] != held:
                    yield out()
                    parts = []
                held = int(numbers[x])
                parts.append(batch.slice(x, y - x))
        if parts:
            yield out()

    each = once.mapInArrow(digested, "shard int, digest long, key binary, verdict string")
    made = each.repartition("shard").sortWithinPartitions("shard", "digest", "key").mapInArrow(written, "shard int, content binary")
    return stored(made, "url-shards"), 1 << bits


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in self.raw[:16].view("<u8"))
        self.keys = self.raw[16 : 16 + 8 * n].view("<u8")
        at = 16 + 8 * n
        self.offsets = self.raw[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.path_lengths = self.raw[at : at + 8 * m].view("<u8").tolist()
        at += 8 * m
        self.block = self.raw[at : at + n]
        self.strings = at + n

    def string(self, k: int) -> bytes:
        return self.raw[self.strings + int(self.offsets[k]) : self.strings + int(self.offsets[k + 1])].tobytes()

    def find(self, candidates: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """Place of each candidate in the index, -1 if it has none: binary search, then the string decides."""
        if digests is None:
            digests = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        low, high = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        found = np.full(len(candidates), -1, np.int64)
        for i in np.flatnonzero(high > low).tolist():
            found[i] = next((k for k in range(int(low[i]), int(high[i])) if self.string(k) == candidates[i]), -1)
        return found


@lru_cache(maxsize=4)
def _opened(path: str) -> Index:
    return Index(path)


def ship(spark: SparkSession, content: bytes) -> str:
    """Writes the index to the shared folder and has every executor fetch it; its name among Spark's files."""
    name = f"url-rules-{hashlib.sha256(content).hexdigest()[:32]}.idx"
    path = f"{shared_folder(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        # under another name first: a file of this name is always whole
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = system.create(part, True)
        out.write(content)
        out.close()
        if not system.rename(part, target):
            system.delete(part, False)
    spark.sparkContext.addFile(str(system.makeQualified(target).toString()))
    return name


def suffixes(host: str) -> list[str]:
    """The host, then what is left after each dot."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


FOUND = "struct<rule_host: string, rule_path: string, verdict: string>"
FOUND_ARROW = pa.struct([("rule_host", pa.string()), ("rule_path", pa.string()), ("verdict", pa.string())])


def _probe(name: str, host: str, path: str, out: str, first: bool, schema: T.StructType):
    """Probes one index file; `out` holds what earlier files found, and keeps it where this one has nothing longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(os.path.abspath(SparkFiles.get(name)))
        for batch in batches:
            hosts, paths = batch.column(host), batch.column(path)
            # each pair of a batch is looked up once
            pairs = list(zip(hosts.to_pylist(), paths.to_pylist()))
            number = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
            candidates: list[bytes] = []
            owner: list[int] = []
            for (h, p), i in number.items():
                heads = [p[:n] for n in index.path_lengths if n <= len(p or "")] if h is not None and p is not None else []
                for s in suffixes(h) if heads else []:
                    candidates += [_key(s, head) for head in heads]
                    owner += [i] * len(heads)
            found = index.find(candidates)
            best: list[tuple[int, int, str, str, bool] | None] = [None] * len(number)
            for c in np.flatnonzero(found >= 0).tolist():
                h, p = candidates[c].decode().split(BORDER, 1)
                entry = (len(h) + len(p), len(h), h, p, bool(index.block[found[c]]))
                if best[owner[c]] is None or entry[:2] > best[owner[c]][:2]:
                    best[owner[c]] = entry
            rows = [best[number[pair]] for pair in pairs]
            fresh = [b and {"rule_host": b[2], "rule_path": b[3], "verdict": "block" if b[4] else "allow"} for b in rows]
            if not first:
                before = batch.column(out).to_pylist()
                size = lambda r: (-1, -1) if r is None else (len(r["rule_host"]) + len(r["rule_path"]), len(r["rule_host"]))
                fresh = [a if size(a) >= size(b) else b for a, b in zip(before, fresh)]
            kept = [batch.column(n) for n in schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fresh, FOUND_ARROW)], [*[n for n in schema.names if n != out], out])

    return run


def judge(urls: DataFrame, rules: DataFrame, *, host: str = "host", path: str = "path", default: str = "allow", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Adds a struct (rule_host, rule_path, verdict), and gives its name. `rules` has host, path, verdict ("allow" or "block").

    Index files of one digest range after the other are shipped and probed, in one pass over the urls; the
    driver holds one file at a time.
    """
    spark = urls.sparkSession
    out = free_name(urls, "judged")
    clean = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter(F.col("verdict").isin("allow", "block"))
    files, _ = shards(clean, shard_bytes)
    schema = T.StructType([*urls.schema.fields, T.StructField(out, T._parse_datatype_string(FOUND))])
    judged = urls
    numbers = sorted(r["shard"] for r in files.select("shard").collect())
    for k, shard in enumerate(numbers):
        name = ship(spark, bytes(files.filter(F.col("shard") == shard).first()["content"]))
        judged = judged.mapInArrow(_probe(name, host, path, out, k == 0, schema), schema)
    if not numbers:
        judged = judged.withColumn(out, F.lit(None).cast(FOUND))
    none = F.struct(F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_path"), F.lit(default).alias("verdict"))
    return judged.withColumn(out, F.coalesce(F.col(f"`{out}`"), none)), out


QUERY_RULES: list[Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in QUERY_RULES)


@query(
    "op2_url_rules",
    rf"""
    WITH rules(rule_host, rule_path, verdict) AS (VALUES {_SQL_RULES}),
    cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    named AS (
        SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM cut
    ),
    fits AS (
        SELECT n, rule_host, rule_path, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS place
        FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict
    FROM named LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
    """,
)
def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    urls = table(spark, folder, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rules = spark.createDataFrame(QUERY_RULES, "host string, path string, verdict string")
    judged, name = judge(urls, rules)
    return judged.select("page_id", "host", "path", F.concat(f"{name}.rule_host", f"{name}.rule_path").alias("rule"), F.col(f"{name}.verdict").alias("verdict"))
