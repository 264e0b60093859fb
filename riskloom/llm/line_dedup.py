"""Reversible line deduplication over sharded cuckoo filters and exact reference tables.

An index keeps, in a shared folder:

* ``log``: the exact references, one row (key, doc, sign) for each line key of
  each inserted (+1) or deleted (-1) document, by epoch;
* ``filters``: for each shard a chain of cuckoo filters with one fingerprint
  for each live key, by epoch;
* ``commits``: one small file for each epoch. It comes last, and never replaces
  another: an epoch without one doesn't count, and a later job goes on after the
  last one that has one.

An insert probes its keys in the filters; only those that may be known are
looked up in the exact table, and keys that are new get a fingerprint. Judging
a batch's lines probes the filters as they were before the batch: a key that
they don't hold can only repeat inside the batch, whose own log tells; only the
others are looked up in the exact table. A delete takes references away that
are there (others are ignored); keys without any left lose their fingerprint,
and the next smallest document becomes the keeper of a line. Keys are spread
over shards by hash and are aggregated before they reach one, so a line that
very many documents share is one row there.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import fresh_path, lookup, packed, unpacked, written
from ._text import SPACE, mix, slices

#: A shorter key (in code points) is never removed.
MIN_KEY = 10
KEYS_PER_SHARD = 250_000
SLOTS = 4
KICKS = 200


def line_key(line: bytes) -> bytes | None:
    """Digest of a line stripped of ASCII white space, A-Z in lower case; None if the key is short."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_KEY or (len(key) < 4 * MIN_KEY and len(key.decode("utf-8", "replace")) < MIN_KEY):
        return None
    return hashlib.sha256(key).digest()[:16]


class CuckooTable:
    """Buckets of four 16-bit fingerprints; 0 is a free slot. Works on arrays of 64-bit hashes."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n: int) -> CuckooTable:
        buckets = 1 << max(4, math.ceil(math.log2(max(1, n) / (SLOTS * 0.85))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, h: np.ndarray):
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return print_, first, self.other(first, print_)

    def other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        print_, first, second = self.places(h)
        return (self.slots[first] == print_[:, None]).any(1) | (self.slots[second] == print_[:, None]).any(1)

    def add(self, h: np.ndarray) -> bool:
        """Adds one fingerprint for each hash, or, if they don't all find room, none."""
        before = self.slots.copy()
        print_, at, _ = self.places(h)
        for kick in range(KICKS):
            order = np.argsort(at, kind="stable")
            print_, at = print_[order], at[order]
            head = np.concatenate([[True], at[1:] != at[:-1]])
            turn = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            free = self.slots[at] == 0
            fits = turn < free.sum(1)
            slot = ((np.cumsum(free, 1) == turn[:, None] + 1) & free).argmax(1)
            self.slots[at[fits], slot[fits]] = print_[fits]
            print_, at = print_[~fits], at[~fits]
            if not len(at):
                return True
            if kick % 2:  # both buckets are full: the first waiting print of each bucket takes a slot, whose print moves on
                head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                slot = (kick // 2 + at[head]) % SLOTS
                out = self.slots[at[head], slot].copy()
                self.slots[at[head], slot] = print_[head]
                print_[head] = out
            at = self.other(at, print_)
        self.slots = before
        return False

    def remove(self, h: np.ndarray) -> np.ndarray:
        """Clears one fingerprint for each hash; True where one was there."""
        gone = np.zeros(len(h), bool)
        for i, (p, a, b) in enumerate(zip(*self.places(h))):
            for bucket in (a, b):
                hit = np.flatnonzero(self.slots[bucket] == p)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    gone[i] = True
                    break
        return gone


class CuckooFilter:
    """A chain of tables: when the last one is full, a larger one follows."""

    def __init__(self, body: bytes | None = None):
        self.tables, at = [], 0
        while body is not None and at < len(body):
            (n,) = struct.unpack_from("<q", body, at)
            self.tables.append(CuckooTable(np.frombuffer(body, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy()))
            at += 8 + 2 * n * SLOTS

    def body(self) -> bytes:
        return b"".join(struct.pack("<q", len(t.slots)) + t.slots.tobytes() for t in self.tables)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for t in self.tables:
            out |= t.holds(h)
        return out

    def add(self, h: np.ndarray) -> None:
        if len(h) and not (self.tables and self.tables[-1].add(h)):
            self.tables.append(CuckooTable.sized(2 * len(h)))
            if not self.tables[-1].add(h):  # more equal prints than two buckets hold
                half = len(h) // 2
                if not half:
                    raise RuntimeError("an empty cuckoo table refused a hash")
                self.add(h[:half])
                self.add(h[half:])

    def remove(self, h: np.ndarray) -> None:
        left = h
        for t in self.tables:
            left = left[~t.remove(left)]


def line_entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc, same): each line key of each row once; same tells the texts of one id apart."""
    rows = packed(docs.select(id_col, text_col), id_col, text_col).select("id", "text", F.xxhash64("text").alias("same"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, sizes = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    own = {line_key(line) for line in (text or b"").split(b"\n")} - {None}
                    keys += sorted(own)
                    sizes.append(len(own))
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column("id").take(row), part.column("same").take(row)], ["key", "doc", "same"])

    return rows.mapInArrow(run, "key binary, doc long, same long")


class LineIndex:
    """Line references of a growing and shrinking set of documents.

    Null and empty texts have no keys. A null id counts as the least id. Rows
    with an id already inserted add their lines to that document; one delete
    of the same rows takes back one insert, and a delete of what isn't there (a
    second time, or by mistake) nothing. Empty tables change nothing.

    A path with an index is opened as its last commit left it. shards is the
    number to begin with; it grows with the lines, and the filters are dealt
    again. Of several jobs that write one epoch the first commit holds, the
    others get an error and change nothing.
    """

    LOG = "key binary, doc long, sign int"
    FILTERS = "shard int, body binary, epoch int"
    #: lines: those of all documents, at least the number of keys; base: the first epoch whose filters have these shards.
    COMMIT = "epoch int, folder string, sign int, shards int, lines long, base int"

    def __init__(self, spark, path: str | None = None, shards: int | None = None):
        self.spark, self.path, self.shards, self.lines, self.base = spark, path or fresh_path(spark, "line-index"), shards, 0, 0
        self.commits = self._committed() if path else []
        if self.commits:
            self.shards, self.lines, self.base = self.commits[-1]["shards"], self.commits[-1]["lines"], self.commits[-1]["base"]

    @property
    def epoch(self) -> int:
        return len(self.commits)

    @property
    def deletes(self) -> bool:
        return any(c["sign"] < 0 for c in self.commits)

    def _hadoop(self, *names: str):
        """Hadoop's classes, its settings and the path of a name in the index."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        return hadoop, self.spark._jsc.hadoopConfiguration(), hadoop.Path("/".join([self.path, *names]))

    def _committed(self) -> list[dict]:
        _, conf, folder = self._hadoop("commits")
        if not folder.getFileSystem(conf).exists(folder):
            return []
        rows = self.spark.read.schema(self.COMMIT).json(f"{self.path}/commits/*.json").collect()  # one row for each epoch
        commits = sorted((r.asDict() for r in rows), key=lambda c: c["epoch"])
        if [c["epoch"] for c in commits] != list(range(len(commits))):
            raise RuntimeError(f"{self.path} lacks some of its commits")
        return commits

    def _commit(self, commit: dict) -> None:
        hadoop, conf, draft = self._hadoop("commits", f"_{commit['folder']}")
        out = draft.getFileSystem(conf).create(draft)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        final = self._hadoop("commits", f"{commit['epoch']}.json")[2]
        whole = draft.getFileSystem(conf).makeQualified(draft)
        hadoop.FileContext.getFileContext(whole.toUri(), conf).rename(draft, final, self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))  # fails where a file is
        self.commits.append(commit)

    def _folders(self, kind: str, first: int = 0) -> list[str]:
        return [f"{self.path}/{kind}/{c['folder']}" for c in self.commits[first:]]

    def _log(self) -> DataFrame:
        if not self.epoch:
            return self.spark.createDataFrame([], self.LOG)
        return self.spark.read.schema(self.LOG).parquet(*self._folders("log"))

    def _filters(self, epoch: int | None = None) -> DataFrame:
        """The filters of each shard, as they are now or were before an epoch."""
        epoch = self.epoch if epoch is None else epoch
        base = self.base if epoch == self.epoch else self.commits[epoch - 1]["base"]
        folders = [f"{self.path}/filters/{c['folder']}" for c in self.commits[base:epoch]]
        if not folders:
            return self.spark.createDataFrame([], "shard int, body binary")
        return self.spark.read.schema(self.FILTERS).parquet(*folders).groupBy("shard").agg(F.max_by("body", "epoch").alias("body"))

    def _shard(self, shards: int | None = None):
        return F.pmod(F.xxhash64("key"), F.lit(shards or self.shards)).cast("int").alias("shard")

    def references(self, of: DataFrame | None = None) -> DataFrame:
        """The exact table (of these keys): key, n_docs, keeper (the smallest document that holds the key)."""
        log = self._log() if of is None else self._log().join(of.select("key"), "key", "left_semi")
        rows = log.groupBy("key", "doc").agg(F.sum("sign").alias("n")).where("n > 0")
        return rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc").alias("keeper"))

    def repeated(self, keys: DataFrame) -> DataFrame:
        """key, keeper, n (rows that refer to it) of those keys that two or more documents hold, and maybe of others.

        keys has each key in question once. What the filters before the last
        insert don't hold is judged by that insert's own log alone.
        """
        inserted = bool(self.commits) and self.commits[-1]["sign"] > 0
        before = self.epoch - 1 if inserted else self.epoch
        found = self.spark.createDataFrame([], "key binary, keeper long, n long")
        known = None
        if before:
            known = written(self._probe(keys, before).where("maybe").select("key"), "known-lines")
            found = self.references(known).where("n_docs > 1").select("key", "keeper", F.col("n_docs").alias("n"))
        if inserted:
            own = self.spark.read.schema(self.LOG).parquet(self._folders("log")[-1])
            own = own if known is None else own.join(known, "key", "left_anti")
            own = own.groupBy("key").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.count("*").alias("n")).where("keeper < last").select("key", "keeper", "n")
            found = found.unionByName(own) if before else own
        return found

    def _probe(self, keys: DataFrame, epoch: int) -> DataFrame:
        """(key, maybe): whether the filters before an epoch may hold each of these distinct keys."""
        def probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            filter_ = CuckooFilter(old["body"].iloc[0] if len(old) else None)
            return pd.DataFrame({"key": new["key"], "maybe": filter_.holds(new["h"].to_numpy(np.int64).view(np.uint64))})

        shards = self.shards if epoch == self.epoch else self.commits[epoch - 1]["shards"]
        hashed = keys.select("key", self._shard(shards), F.xxhash64("key", F.lit(7)).alias("h"))
        return hashed.groupBy("shard").cogroup(self._filters(epoch).groupBy("shard")).applyInPandas(probe, "key binary, maybe boolean")

    def _update(self, keys: DataFrame, add: bool, folder: str) -> None:
        """A new version of the filters of the shards that own these keys (distinct, one row each)."""
        epoch = self.epoch

        def change(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(new):
                return pd.DataFrame({"shard": [], "body": [], "epoch": []})
            filter_ = CuckooFilter(old["body"].iloc[0] if len(old) else None)
            h = np.sort(new["h"].to_numpy(np.int64).view(np.uint64))
            (filter_.add if add else filter_.remove)(h)
            return pd.DataFrame({"shard": new["shard"].iloc[:1], "body": [filter_.body()], "epoch": [epoch]})

        hashed = keys.select(self._shard(), F.xxhash64("key", F.lit(7)).alias("h"))
        hashed.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInPandas(change, self.FILTERS) \
            .write.parquet(f"{self.path}/filters/{folder}")

    def _unknown(self, keys: DataFrame) -> DataFrame:
        """Those of these distinct keys that no document in the index holds."""
        if not self.epoch:
            return keys

        probed = written(self._probe(keys, self.epoch), "line-probes")
        maybe = probed.where("maybe").select("key")
        known = self._log().join(maybe, "key", "left_semi").groupBy("key", "doc").agg(F.sum("sign").alias("n")).where("n > 0").select("key").distinct()
        return probed.where("not maybe").select("key").union(maybe.join(known, "key", "left_anti"))

    def _change(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> LineIndex:
        lines = 0 if sign < 0 else docs.agg(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
        before = self.shards, self.lines, self.base
        try:
            self.lines += lines if sign > 0 else 0
            wanted = max(8, math.ceil(self.lines / KEYS_PER_SHARD))
            outgrown = self.shards is not None and wanted > 2 * max(4, self.shards)
            if outgrown or self.shards is None:
                self.shards, self.base = wanted, self.epoch
            folder = f"{self.epoch}-{uuid.uuid4().hex}"
            path = f"{self.path}/log/{folder}"
            entries = line_entries(docs, id_col, text_col)
            if sign > 0:
                entries = entries.select("key", "doc", F.lit(1).alias("sign"))
            else:  # only references that are there can go
                gone = entries.groupBy("key", "doc").agg(F.count("*").alias("gone"))
                held = self._log().groupBy("key", "doc").agg(F.sum("sign").alias("held")).where("held > 0")
                entries = gone.join(held, ["key", "doc"]).select("key", "doc", (-F.least("gone", "held")).cast("int").alias("sign"))
            entries.write.parquet(path)
            rows = self.spark.read.schema(self.LOG).parquet(path)
            if sign < 0:
                self.lines += rows.agg(F.sum("sign")).first()[0] or 0
            keys = rows.select("key").groupBy("key").agg(F.lit(1)).select("key")
            if sign < 0:
                every = self._log().unionByName(rows).join(keys, "key", "left_semi").groupBy("key", "doc").agg(F.sum("sign").alias("n"))
                keys = every.groupBy("key").agg(F.max("n").alias("n")).where("n <= 0").select("key")
            elif outgrown and self.epoch:  # all live keys, into filters of the new shards
                every = self._log().unionByName(rows).groupBy("key", "doc").agg(F.sum("sign").alias("n"))
                keys = every.where("n > 0").select("key").distinct()
            else:
                keys = self._unknown(keys)
            self._update(keys, sign > 0, folder)
            self._commit({"epoch": self.epoch, "folder": folder, "sign": sign, "shards": self.shards, "lines": self.lines, "base": self.base})
        except BaseException:
            self.shards, self.lines, self.base = before
            raise
        return self

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._change(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Takes documents that were inserted, with the same texts, out again."""
        return self._change(docs, -1, id_col, text_col)

    def keep_first(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of docs without lines that a smaller document holds: row, id, text, n_lines, n_dropped.

        A key goes only if two or more documents of the index hold it. The
        other lines stay in order, joined by a line feed; a null text stays null
        and counts as one empty line.
        """
        entries = line_entries(docs, id_col, text_col)
        repeated = written(self.repeated(entries.select("key").distinct()), "repeated-lines")
        drops = lookup(entries, repeated.select("key", "keeper"), "key", repeated.select("key", "n")).where("doc > keeper")
        # by id and text: a null or repeated id's texts don't meet
        drops = drops.groupBy(F.col("doc").alias("id"), "same").agg(F.collect_set("key").alias("drops"))
        rows = packed(docs, id_col, text_col).withColumn("same", F.xxhash64("text"))
        rows = rows.join(drops, ["id", "same"], "left").select("row", "id", "text", "drops")

        def rewrite(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    texts, n_lines, n_dropped = [], [], []
                    for text, drop in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("drops").to_pylist()):
                        lines = (text or b"").split(b"\n")
                        kept = lines
                        if drop:
                            drop = set(drop)
                            kept = [line for line in lines if line_key(line) not in drop]
                        texts.append(None if text is None else b"\n".join(kept).decode("utf-8", "replace"))
                        n_lines.append(len(lines))
                        n_dropped.append(len(lines) - len(kept))
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                                     ["row", "id", "text", "n_lines", "n_dropped"])

        schema = T.StructType([rows.schema["row"], rows.schema["id"], rows.schema["text"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return rows.mapInArrow(rewrite, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, each text without the lines that a document with a smaller id holds."""
    index = LineIndex(docs.sparkSession).insert(docs, id_col, text_col)
    return unpacked(index.keep_first(docs, id_col, text_col), docs, text_col)
