"""Line dedup over sharded cuckoo filters that exact reference-count tables back.

A store holds, in tables of the shared folder, the line keys of every document (references), for every key the number of
its documents and the largest id among them (counts), and for every shard of keys a cuckoo filter of those found in
enough documents. An insertion or deletion writes what it changes as a new version: the documents' references, the
touched keys' new counts, and the filters of shards in which keys became frequent or ceased to be. So dedup is reversible.

Dedup asks the filters first. Up to a bound of bytes they are sent to every task, so that a line that isn't frequent is settled there; beyond
it the keys go to the shards, where each filter is there once for a part of its keys. Only keys that pass are looked up in the counts, and what
was a false alarm is found out by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.bytesops import U64, mix
from trackloom.llm.common import arrow_batches, docs_table, shared_dir

MIN_CHARS = 40
MIN_DOCS = 5
BLANK = b" \t\n\x0b\x0c\r"
NO_ID = np.iinfo(np.int64).min

KEY = np.dtype([("hi", "<i8"), ("lo", "<i8")])
#: Frequent keys of a shard, at some 5 bytes each in its filter.
SHARD_KEYS = 200_000
#: All filters are sent to the tasks up to so many bytes; beyond them keys and filters meet by shard.
FILTER_BYTES = 64 << 20
#: A frequent key's documents meet its count in so many places.
SALTS = 16


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, deletable; at most 2 * 4 / 2**16 of absent keys pass.

    Keys whose fingerprints find no place go to an exact overflow list, so no key is ever lost.
    """

    SLOTS, KICKS = 4, 64

    def __init__(self, capacity: int) -> None:
        need = max(1, int(capacity / 0.85 / self.SLOTS) + 1)
        self.n = 1 << (need - 1).bit_length()
        self.slots = np.zeros((self.n, self.SLOTS), np.uint16)
        self.overflow: list[tuple[int, int]] = []
        self._random = np.random.default_rng(7)

    def dumps(self) -> bytes:
        """The filter as bytes: the overflow's size, the overflow, the slots."""
        return np.int64(len(self.overflow)).tobytes() + np.array(self.overflow, "<i8").tobytes() + self.slots.tobytes()

    @classmethod
    def loads(cls, blob: bytes) -> CuckooFilter:
        out, k = cls(0), int(np.frombuffer(blob, np.int64, 1)[0])
        out.overflow = [tuple(x) for x in np.frombuffer(blob, "<i8", 2 * k, 8).reshape(-1, 2).tolist()]
        out.slots = np.frombuffer(blob, np.uint16, offset=8 + 16 * k).reshape(-1, cls.SLOTS).copy()
        out.n = len(out.slots)
        return out

    def has_room(self, keys: int) -> bool:
        """Whether so many keys leave the table loose enough."""
        return keys <= 0.9 * self.n * self.SLOTS

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys["hi"].astype(U64) ^ (keys["lo"].astype(U64) * U64(0x9E3779B97F4A7C15)))
        print_ = ((h >> U64(48)).astype(np.uint16)) | np.uint16(0)
        print_ = np.where(print_ == 0, np.uint16(1), print_)
        a = (h & U64(self.n - 1)).astype(np.int64)
        return print_, a, self._other(a, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """The second bucket; its own inverse."""
        return bucket ^ (mix(print_.astype(U64)) & U64(self.n - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Enters keys; each round places at most one fingerprint a bucket, the rest wait or kick."""
        print_, a, b = self._places(keys)
        whose = np.arange(len(keys))
        at = a.copy()
        for turn in range(self.KICKS + 2):
            if not len(whose):
                return
            _, one = np.unique(at, return_index=True)
            free = self.slots[at[one]] == 0
            has = free.any(axis=1)
            done = one[has]
            self.slots[at[done], free[has].argmax(axis=1)] = print_[done]
            if turn:  # in a full bucket a random fingerprint makes room and moves on
                full = one[~has]
                slot = self._random.integers(0, self.SLOTS, len(full))
                out = self.slots[at[full], slot].copy()
                self.slots[at[full], slot] = print_[full]
                print_[full], at[full] = out, self._other(at[full], out)
            rest = np.ones(len(whose), bool)
            rest[done] = False
            if not turn:
                at = np.where(rest, b, at)
            print_, at, whose = print_[rest], at[rest], whose[rest]
        self.overflow += zip(print_.tolist(), at.tolist())

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(keys)
        found = (self.slots[a] == print_[:, None]).any(axis=1) | (self.slots[b] == print_[:, None]).any(axis=1)
        for p, at in self.overflow:
            found |= (print_ == p) & ((a == at) | (b == at))
        return found

    def delete(self, keys: np.ndarray) -> None:
        """Removes one fingerprint of each key; only keys that were inserted may be given."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for at in (a, b):
                hit = np.flatnonzero(self.slots[at] == p)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break
            else:
                for other in ((p, a), (p, b)):
                    if other in self.overflow:
                        self.overflow.remove(other)
                        break


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _long(key: bytes, least: int) -> bool:
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode()) >= least)


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def keys_of(text: str | None, least: int) -> set[bytes]:
    """The distinct keys of a text's lines that are long enough."""
    if not text:
        return set()
    return {_digest(key) for line in text.encode().split(b"\n") if len(line) >= least and _long(key := line_key(line), least)}


def without(text: str | None, gone: bytes | None, least: int) -> tuple[str, int, int]:
    """(text left, lines, lines dropped) of one document whose keys ``gone``, end to end, lose their lines."""
    if not gone:
        return text or "", (text or "").count("\n") + 1, 0
    lines, bad = text.encode().split(b"\n"), {gone[k : k + 16] for k in range(0, len(gone), 16)}
    left = [x for x in lines if not (len(x) >= least and _long(key := line_key(x), least) and _digest(key) in bad)]
    return b"\n".join(left).decode(), len(lines), len(lines) - len(left)


def packed(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc, keys): each row's distinct keys end to end; rows without any are left out."""
    src = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [b"".join(keys_of(t, least)) for t in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["doc", "keys"])
            yield out.filter(pa.array([bool(x) for x in own], pa.bool_()))

    return src.mapInArrow(run, "doc long, keys binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc, hi, lo) of rows (doc, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            keys = np.frombuffer(b"".join(blobs), KEY)
            doc = np.repeat(batch.column(0).to_numpy(), [len(x) // 16 for x in blobs])
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(keys["hi"].copy()), pa.array(keys["lo"].copy())], names=["doc", "hi", "lo"])

    return rows.select("doc", "keys").mapInArrow(run, "doc long, hi long, lo long")


def _keys(t: pa.Table) -> np.ndarray:
    out = np.empty(len(t), KEY)
    out["hi"], out["lo"] = t["hi"].to_numpy(), t["lo"].to_numpy()
    return out


def settled(changes: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's new filter: changes (come, go) entered into its filter, or one of all its frequent keys (every)."""
    kind = changes["kind"].to_pylist()
    of = {k: _keys(changes.filter(pa.array([x == k for x in kind], pa.bool_()))) for k in ("come", "go", "every")}
    shard = changes["shard"][0].as_py()
    if "every" in kind or not len(filters):
        own, hot = CuckooFilter(2 * len(of["every"])), len(of["every"])
        own.insert(of["every"])
    else:
        own = CuckooFilter.loads(filters["filter"][0].as_py())
        own.delete(of["go"])
        own.insert(of["come"])
        hot = filters["hot"][0].as_py() + len(of["come"]) - len(of["go"])
    return pa.table({"shard": pa.array([shard], pa.int32()), "hot": pa.array([hot], pa.int64()), "slots": pa.array([own.n * own.SLOTS], pa.int64()), "filter": pa.array([own.dumps()], pa.binary())})


class LineStore:
    """Incremental dedup: references, counts and filters at ``path``, a folder that all executors share, in versions.

    Rows that share an id are one document; inserting an id again adds to its document. A version is complete when
    insert() or delete() returns, and ``version`` names it; one that was broken off is written over by the next.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None, version: int = 0, shard_keys: int = SHARD_KEYS) -> None:
        self.spark, self.path, self.min_chars, self.min_docs = spark, path, min_chars, min_docs
        self.shards, self.version, self.shard_keys = shards, version, shard_keys

    # tables

    def _read(self, name: str, version: int | None = None) -> DataFrame:
        """Rows of all versions with their number v."""
        last = self.version if version is None else version
        out = None
        for v in range(1, last + 1):
            part = self.spark.read.parquet(f"{self.path}/{name}/v{v}").withColumn("v", F.lit(v))
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, name: str, df: DataFrame, version: int) -> DataFrame:
        path = f"{self.path}/{name}/v{version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def references(self) -> DataFrame:
        """(doc, keys) inserted and not deleted since."""
        rows = self._read("references")
        if self.version < 2:
            return rows.select("doc", "keys")
        gone = rows.where("keys IS NULL").groupBy("doc").agg(F.max("v").alias("until"))
        return rows.where("keys IS NOT NULL").join(gone, "doc", "left").where("until IS NULL OR v > until").select("doc", "keys")

    def counts(self, version: int | None = None) -> DataFrame:
        """(hi, lo, docs, largest) of the keys: the latest version's row of each."""
        last = self.version if version is None else version
        rows = self._read("counts", last)
        if last < 2:
            return rows.select("hi", "lo", "docs", "largest")
        newest = rows.groupBy("hi", "lo").agg(F.max_by(F.struct("docs", "largest"), "v").alias("x"))
        return newest.select("hi", "lo", "x.docs", "x.largest").where("docs > 0")

    def filters(self) -> DataFrame:
        """(shard, hot, slots, filter): the latest version's row of each shard."""
        rows = self._read("filters")
        if self.version < 2:
            return rows.drop("v")
        return rows.groupBy("shard").agg(F.max_by(F.struct("hot", "slots", "filter"), "v").alias("x")).select("shard", "x.*")

    # changes

    def insert(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds documents."""
        v, there = self.version + 1, self.version > 0
        rows = self._write("references", packed(df, id_col, text_col, self.min_chars), v)
        pairs = unpacked(rows)
        if there:  # what these documents have already doesn't count again
            old = unpacked(self.references().join(rows.select("doc").distinct(), "doc", "left_semi"))
            pairs = pairs.distinct().join(old, ["doc", "hi", "lo"], "left_anti")
        new = pairs.groupBy("hi", "lo").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("largest"))
        if there:
            before = self.counts().withColumnsRenamed({"docs": "old", "largest": "old_largest"})
            new = new.join(before, ["hi", "lo"], "left").select("hi", "lo", (F.col("docs") + F.coalesce("old", F.lit(0))).alias("docs"), F.greatest("largest", "old_largest").alias("largest"), F.coalesce("old", F.lit(0)).alias("old"))
        else:
            new = new.withColumn("old", F.lit(0).cast("long"))
        self._finish(new, v)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes documents out; ids that the store doesn't hold change nothing."""
        if not self.version:
            return
        v = self.version + 1
        gone = ids.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        self._write("references", gone.select("doc", F.lit(None).cast("binary").alias("keys")), v)
        held = self.references()
        lost = unpacked(held.join(gone, "doc", "left_semi")).groupBy("hi", "lo").agg(F.count_distinct("doc").alias("lost"), F.max("doc").alias("lost_largest"))
        touched = lost.join(self.counts(), ["hi", "lo"])
        # where the largest document goes, the next one is sought among the references that stay
        bare = touched.where("docs > lost AND largest = lost_largest").select("hi", "lo")
        next_ = unpacked(held.join(gone, "doc", "left_anti")).join(bare, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc").alias("next"))
        new = touched.join(next_, ["hi", "lo"], "left").select("hi", "lo", (F.col("docs") - F.col("lost")).alias("docs"), F.coalesce("next", "largest").alias("largest"), F.col("docs").alias("old"))
        self._finish(new, v)

    def _finish(self, new: DataFrame, v: int) -> None:
        """Writes the touched keys' counts (hi, lo, docs, largest, old) and the filters that change with them."""
        new = self._write("counts", new, v)
        now, old = F.col("docs") >= self.min_docs, F.col("old") >= self.min_docs
        if self.shards is None:
            self.shards = max(1, -(-new.where(now).count() // self.shard_keys))
        shard = F.pmod(F.col("lo"), F.lit(self.shards)).cast("int").alias("shard")
        kind = F.when(now & ~old, "come").when(old & ~now, "go")
        changes = new.where(now != old).select(shard, "hi", "lo", kind.alias("kind"))
        empty = self.spark.createDataFrame([], "shard int, hot long, slots long, filter binary")
        filters = self.filters() if self.version else empty
        grown = changes.groupBy("shard").agg(F.sum(F.when(F.col("kind") == "come", 1).otherwise(-1)).alias("more")).join(filters.drop("filter"), "shard", "left")
        full = grown.where("hot IS NULL OR hot + more > 0.9D * slots").select("shard")
        if self.version:
            every = self.counts(v).where(F.col("docs") >= self.min_docs).select(shard, "hi", "lo", F.lit("every").alias("kind")).join(F.broadcast(full), "shard", "left_semi")
            changes = changes.unionByName(every)
        else:
            changes = changes.withColumn("kind", F.lit("every"))
        self._write("filters", changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_changed, "shard int, hot long, slots long, filter binary"), v)
        self.version = v

    # questions

    def frequent(self) -> DataFrame:
        """(hi, lo, docs, largest) of keys in at least ``min_docs`` documents."""
        return self.counts().where(F.col("docs") >= self.min_docs)

    def screened(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, hi, lo): the distinct keys of each row that pass the filters."""
        filters, least = self.filters(), self.min_chars
        shared = None
        if (filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= FILTER_BYTES:
            shared = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.select("shard", "filter").collect()})
        shards = self.shards or 1
        src = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text_col}`").alias("t"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None if shared is None else {k: CuckooFilter.loads(x) for k, x in shared.value.items()}
            for batch in batches:
                blobs = [b"".join(keys_of(t, least)) for t in batch.column(1).to_pylist()]
                keys = np.frombuffer(b"".join(blobs), KEY)
                doc = np.repeat(batch.column(0).to_numpy(), [len(x) // 16 for x in blobs])
                if own is not None:
                    shard, hit = keys["lo"] % shards, np.zeros(len(keys), bool)
                    for k, f in own.items():
                        mine = np.flatnonzero(shard == k)
                        hit[mine] = f.contains(keys[mine])
                    doc, keys = doc[hit], keys[hit]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(keys["hi"].copy()), pa.array(keys["lo"].copy())], names=["doc", "hi", "lo"])

        asked = src.mapInArrow(run, "doc long, hi long, lo long")
        return asked if shared is not None else _asked_by_shard(asked, filters, shards)

    def gone(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, gone): the keys whose lines a document loses, end to end; documents that lose none are left out."""
        asked = self.screened(df, id_col, text_col).distinct().withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
        exact = self.frequent().select("hi", "lo", "largest").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        lost = asked.join(exact, ["hi", "lo", "salt"]).where("doc <> largest")
        rows = lost.groupBy("doc").agg(F.collect_list(F.struct("hi", "lo")).alias("k"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                keys = np.empty(len(lists.flatten()), KEY)
                keys["hi"], keys["lo"] = lists.flatten().field("hi").to_numpy(), lists.flatten().field("lo").to_numpy()
                ends = np.cumsum([0, *(len(x) for x in lists)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keys[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc", "gone"])

        return rows.mapInArrow(run, "doc long, gone binary")

    def dedup(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``df`` without the lines that the store's documents make frequent, as dedup() gives it."""
        carried = [c for c in df.columns if c not in ("n_lines", "n_dropped", "__doc", "__gone")]
        src = df.select(*[F.col(f"`{c}`") for c in carried])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
        lost = self.gone(df, id_col, text_col).withColumnsRenamed({"doc": "__doc", "gone": "__gone"})
        joined = src.join(lost, F.coalesce(src[f"`{id_col}`"].cast("long"), F.lit(NO_ID)) == lost["__doc"], "left").drop("__doc")
        at, least = carried.index(text_col), self.min_chars

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *own, gone = batch.columns
                out = [without(t, g, least) for t, g in zip(own[at].to_pylist(), gone.to_pylist())]
                own[at] = pa.array([o[0] for o in out], pa.string())
                yield pa.RecordBatch.from_arrays([*own, pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=[*carried, "n_lines", "n_dropped"])

        return joined.mapInArrow(clean, f"{fields}, n_lines long, n_dropped long")


def _asked_by_shard(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(doc, hi, lo): the keys that pass their shard's filter.

    A shard's keys are dealt to several places by document, each with the filter before its keys, so that a task holds one filter and streams through the keys.
    """
    none = F.lit(None).cast("long")
    shard, salt = F.pmod(F.col("lo"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))
    rows = keys.select("doc", "hi", "lo", shard.alias("shard"), salt.alias("salt"), F.lit(None).cast("binary").alias("filter"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    heads = filters.select(none.alias("doc"), none.alias("hi"), none.alias("lo"), "shard", places.alias("salt"), "filter")
    met = rows.unionByName(heads).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = None, None
        for batch in batches:
            shard, salt = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            blank = np.asarray(batch.column(5).is_null())
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(salt) != 0) | ~blank[1:] | ~blank[:-1]])) if len(shard) else np.zeros(0, int)
            hit = np.zeros(len(shard), bool)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
                if not blank[a]:
                    own, place = CuckooFilter.loads(batch.column(5)[a].as_py()), (shard[a], salt[a])
                elif place == (shard[a], salt[a]):  # a shard without frequent keys has no filter
                    part = batch.slice(a, b - a)
                    keys = np.empty(b - a, KEY)
                    keys["hi"], keys["lo"] = part.column(1).to_numpy(), part.column(2).to_numpy()
                    hit[a:b] = own.contains(keys)
            yield batch.filter(pa.array(hit)).select(["doc", "hi", "lo"])

    return met.mapInArrow(run, "doc long, hi long, lo long")


def _changed(changes: pa.Table, filters: pa.Table) -> pa.Table:
    if not len(changes):
        return pa.table({"shard": pa.array([], pa.int32()), "hot": pa.array([], pa.int64()), "slots": pa.array([], pa.int64()), "filter": pa.array([], pa.binary())})
    return settled(changes, filters)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> DataFrame:
    """``df`` with lines of frequent keys taken out of ``text_col``, and with n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased, compared by a 128-bit hash. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents stay in the largest id only. A null or empty
    text is one empty line and comes back empty. Ids are whole numbers; rows that share an id are one document, and a null
    id is the smallest one. Columns n_lines and n_dropped of ``df`` are replaced, __doc and __gone dropped; other columns are
    carried. One row per input row. The store of the documents is written to the shared folder.
    """
    store = LineStore(df.sparkSession, shared_dir(df.sparkSession), min_chars, min_docs, shards)
    store.insert(df, id_col, text_col)
    return store.dedup(df, id_col, text_col)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped and the digest of what is kept."""
    arrow_batches(spark)
    out = dedup(docs_table(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
lines AS (
  SELECT doc_id, r, i, w[i] AS line,
         translate(regexp_replace(regexp_replace(w[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
hot AS (SELECT k, max(doc_id) AS largest FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT l.doc_id, l.r, l.i, l.line, h.k IS NOT NULL AND l.doc_id <> h.largest AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
