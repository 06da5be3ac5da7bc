"""Exact dedup with an index of live digests that grows and shrinks: cuckoo filters in front of stored keys.

Two texts are equal when nothing differs once ASCII white space is deleted; their key is the SHA-256 of what remains. Keys lie in
shards by their first bits. A shard keeps the stored keys of all live texts and a cuckoo filter of 16-bit fingerprints, four to a
bucket; each filled slot points at the stored key that it stands for. A key without its fingerprint in either of its two buckets
is new, and nothing stored is read; a hit is verified against the whole stored key in the slot. Deleting a key frees its slot.
Where keys no longer fit, the filter is laid out anew with twice the buckets from the stored keys, because a fingerprint alone
does not say where else its key belongs. Shards that have grown past ``SHARD`` keys on average are dealt anew, from stored keys too.

The index lives in tables of the shared checkpoint folder: ``rows`` (one narrow row per live document) and ``state`` (stored keys with
count and keeper, and a filter row per shard). Equal keys are combined in every map task before they travel, so a text that a third
of all documents hold is one row per Arrow batch; texts are read once and never move. Of equal texts, the row with the most code
points, then the smallest doc_id (null last), then the earliest row stays; of repeated rows with one doc_id exactly one stays.
Null texts count as empty, and empty texts are equal to one another; long texts are digested by the JVM, at any length; extra columns
are ignored; an empty table makes an empty index. doc_id is an integer.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.hashing import U, mix
from tapeworks.session import ensure_checkpoint_dir

SLOTS, TURNS, LAST = 4, 200, np.iinfo(np.int64).max
SHARD = 1_000_000
STATE = "shard int, kind string, sha binary, n long, chars long, doc_id long, batch long, tag long, pos long, slots binary, hit boolean"
_STATE = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("sha", pa.binary()), *[(c, pa.int64()) for c in ("n", "chars", "doc_id", "batch", "tag", "pos")],
                    ("slots", pa.binary()), ("hit", pa.bool_())])
FIELDS = ("n", "chars", "doc_id", "batch", "tag")


class CuckooFilter:
    """Fingerprints of keys in buckets of four; ``at`` holds the place of each slot's stored key."""

    def __init__(self, buckets: int = 64):
        self.fp = np.zeros((buckets, SLOTS), np.uint16)
        self.at = np.full((buckets, SLOTS), -1, np.int32)

    def _home(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(np.ascontiguousarray(keys[:, 8:16]).view(U)[:, 0])
        return ((h >> U(40)) % U(65535) + U(1)).astype(np.uint16), (h & U(len(self.fp) - 1)).astype(np.int64)

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(fp.astype(U), 5) & U(len(self.fp) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray, stored: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key's fingerprint is there, and the place of the stored key that equals it, or -1."""
        fp, a = self._home(keys)
        b = self._other(fp, a)
        hit = np.concatenate([self.fp[a], self.fp[b]], 1) == fp[:, None]
        place = np.full(len(keys), -1, np.int64)
        if stored is not None:
            row, slot = np.nonzero(hit)
            at = np.concatenate([self.at[a], self.at[b]], 1)[row, slot]
            same = (stored[at] == keys[row]).all(1)
            place[row[same]] = at[same]
        return hit.any(1), place

    def insert(self, keys: np.ndarray, at: np.ndarray) -> bool:
        """Put distinct keys that aren't there; False where some found no slot, and the filter has to be laid out anew."""
        fp, bucket = self._home(keys)
        at = at.astype(np.int32)
        for turn in range(TURNS):
            if not len(fp):
                return True
            order = np.argsort(bucket, kind="stable")
            fp, bucket, at = fp[order], bucket[order], at[order]
            head = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            rank = np.arange(len(bucket)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            free = self.fp[bucket] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
            self.fp[bucket[fits], slot[fits]] = fp[fits]
            self.at[bucket[fits], slot[fits]] = at[fits]
            fp, bucket, at = fp[~fits], bucket[~fits], at[~fits]
            if turn == 0:
                bucket = self._other(fp, bucket)
                continue
            one = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            b, s = bucket[one], (mix(at[one].astype(U), turn) & U(SLOTS - 1)).astype(np.int64)
            fp[one], self.fp[b, s] = self.fp[b, s], fp[one]
            at[one], self.at[b, s] = self.at[b, s], at[one]
            bucket[one] = self._other(fp[one], b)
        return False

    def delete(self, keys: np.ndarray, at: np.ndarray) -> None:
        """Free the slots of keys that are stored at these places."""
        fp, a = self._home(keys)
        for bucket in (a, self._other(fp, a)):
            row, slot = np.nonzero((self.fp[bucket] == fp[:, None]) & (self.at[bucket] == at[:, None]))
            self.fp[bucket[row], slot], self.at[bucket[row], slot] = 0, -1

    def dump(self) -> bytes:
        return self.fp.tobytes() + self.at.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> "CuckooFilter":
        out = cls(len(blob) // (6 * SLOTS))
        out.fp = np.frombuffer(blob, np.uint16, len(blob) // 6).reshape(-1, SLOTS).copy()
        out.at = np.frombuffer(blob, np.int32, offset=out.fp.nbytes).reshape(-1, SLOTS).copy()
        return out


def key_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """32-byte keys as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def better(a: dict, b: dict) -> np.ndarray:
    """Where the row a goes before the row b as keeper."""
    out, tie = np.zeros(len(a["n"]), bool), np.ones(len(a["n"]), bool)
    for name, sign in (("chars", -1), ("doc_id", 1), ("batch", 1), ("tag", 1)):
        x, y = sign * a[name], sign * b[name]
        out |= tie & (x < y)
        tie &= x == y
    return out


def combined(keys: np.ndarray, f: dict) -> tuple[np.ndarray, dict]:
    """One row for each key: the counts' sum and the best keeper."""
    if not len(keys):
        return keys, f
    parts = np.ascontiguousarray(keys).view(U)
    order = np.lexsort((f["tag"], f["batch"], f["doc_id"], -f["chars"], *parts.T))
    keys, parts, f = keys[order], parts[order], {k: v[order] for k, v in f.items()}
    head = np.flatnonzero(np.concatenate(([True], (parts[1:] != parts[:-1]).any(1))))
    return keys[head], {k: np.add.reduceat(v, head) if k == "n" else v[head] for k, v in f.items()}


def fields(table) -> dict:
    return {c: table[c].fill_null(LAST).to_numpy(zero_copy_only=False) if c == "doc_id" else table[c].fill_null(0).to_numpy(zero_copy_only=False) for c in FIELDS}


class Shard:
    """Stored keys of a shard, in the order of their places, and the filter in front of them."""

    def __init__(self, keys: np.ndarray, f: dict, blob: bytes | None):
        self.keys, self.f, self.size = keys, f, len(keys)
        self.filter = CuckooFilter.load(blob) if blob else CuckooFilter()

    def _room(self, more: int) -> None:
        if self.size + more > len(self.keys):
            spare = max(more, len(self.keys), 1024)
            self.keys = np.concatenate([self.keys, np.zeros((spare, 32), np.uint8)])
            self.f = {k: np.concatenate([v, np.zeros(spare, np.int64)]) for k, v in self.f.items()}

    def resize(self) -> None:
        live = np.flatnonzero(self.f["n"][:self.size] > 0)
        buckets = 2 * len(self.filter.fp)
        while True:
            self.filter = CuckooFilter(buckets)
            if self.filter.insert(self.keys[live], live):
                return
            buckets *= 2

    def add(self, keys: np.ndarray, f: dict) -> None:
        """Distinct keys with their counts: new ones are stored, others verified and merged."""
        place = self.filter.find(keys, self.keys)[1]
        old, new = place >= 0, place < 0
        at, mine = place[old], {k: v[old] for k, v in f.items()}
        wins = better(mine, {k: v[at] for k, v in self.f.items()})
        self.f["n"][at] += mine["n"]
        for k in FIELDS[1:]:
            self.f[k][at[wins]] = mine[k][wins]
        many = int(new.sum())
        self._room(many)
        at = np.arange(self.size, self.size + many)
        self.keys[at] = keys[new]
        for k in FIELDS:
            self.f[k][at] = f[k][new]
        self.size += many
        if not self.filter.insert(keys[new], at):
            self.resize()

    def put(self, keys: np.ndarray, f: dict) -> None:
        """Stored keys with other counts and keepers; a count of 0 deletes the key."""
        place = self.filter.find(keys, self.keys)[1]
        known = place >= 0
        at = place[known]
        for k in FIELDS:
            self.f[k][at] = f[k][known]
        gone = at[self.f["n"][at] == 0]
        self.filter.delete(self.keys[gone], gone)

    def rows(self, shard: int) -> pa.Table:
        """Live keys at new places without gaps, and the filter."""
        live = np.flatnonzero(self.f["n"][:self.size] > 0)
        if len(live) < self.size:
            to = np.full(self.size, -1, np.int32)
            to[live] = np.arange(len(live))
            self.filter.at = np.where(self.filter.at >= 0, to[self.filter.at], -1).astype(np.int32)
        n = len(live)
        f = {k: pa.array(v[live], pa.int64(), mask=v[live] == LAST if k == "doc_id" else None) for k, v in self.f.items()}
        empty = lambda t: pa.nulls(n, t)
        keys = pa.array([k.tobytes() for k in self.keys[live]], pa.binary())
        body = pa.table([pa.array(np.full(n, shard), pa.int32()), pa.array(["live"] * n, pa.string()), keys, *[f[k] for k in FIELDS], pa.array(np.arange(n), pa.int64()), empty(pa.binary()), empty(pa.bool_())], schema=_STATE)
        head = pa.Table.from_pylist([{"shard": shard, "kind": "filter", "slots": self.filter.dump()}], schema=_STATE)
        return pa.concat_tables([body, head])


def changed(table: pa.Table) -> pa.Table:
    """A shard's next state from its last one (kinds live and filter) and what is added or put."""
    shard = table["shard"][0].as_py()
    part = lambda kind: table.filter(pc.equal(table["kind"], kind))
    live = part("live").sort_by("pos")
    slots = part("filter")["slots"].to_pylist()
    s = Shard(key_rows(live["sha"]).copy(), {k: v.copy() for k, v in fields(live).items()}, slots[0] if slots else None)
    put, add = part("put"), part("add")
    if len(put):
        s.put(key_rows(put["sha"]), fields(put))
    for i in range(0, len(add), 65536):
        some = add.slice(i, 65536)
        s.add(*combined(key_rows(some["sha"]), fields(some)))
    return s.rows(shard)


def screened(table: pa.Table) -> pa.Table:
    """Which of the asked keys a shard's filter may hold."""
    slots = table.filter(pc.equal(table["kind"], "filter"))["slots"].to_pylist()
    asked = table.filter(pc.equal(table["kind"], "ask"))
    hit = CuckooFilter.load(slots[0]).find(key_rows(asked["sha"]))[0] if slots and len(asked) else np.zeros(len(asked), bool)
    return asked.set_column(asked.schema.get_field_index("hit"), "hit", pa.array(hit, pa.bool_())).select(_STATE.names)


def _combine(batches):
    for b in batches:
        keys, f = combined(key_rows(b["sha"]), fields(b))
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), *[pa.array(f[k], pa.int64(), mask=f[k] == LAST if k == "doc_id" else None) for k in FIELDS]], names=["sha", *FIELDS])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text, and the key of the text without ASCII white space."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"),
                       F.unhex(F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256)).alias("sha"))


class ExactIndex:
    """Live documents by their digests; ``insert`` and ``delete`` write the next version of its two tables."""

    def __init__(self, spark: SparkSession, shards: int | None = None):
        ensure_checkpoint_dir(spark)
        self.spark, self.shards, self.batches, self.held = spark, shards, 0, 0
        self.rows = spark.createDataFrame([], "doc_id long, chars long, sha binary, tag long, batch long")
        self.state = spark.createDataFrame([], STATE)

    def _state_rows(self, changes: DataFrame, kind: str) -> DataFrame:
        shard = F.pmod(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"), F.lit(self.shards)).cast("int")
        have = dict(shard=shard, kind=F.lit(kind))
        return changes.select(*[have.get(f.name, F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.state.schema])

    def _apply(self, changes: DataFrame, kind: str, state: DataFrame | None = None) -> None:
        state = self.state if state is None else state
        self.state = state.unionByName(self._state_rows(changes, kind)).groupBy("shard").applyInArrow(changed, STATE).checkpoint()

    def _deal(self, more: int) -> None:
        """As many shards as the keys ask for; where that is more than now, all stored keys are dealt anew."""
        self.held += more
        if self.shards is None:
            self.shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.held // SHARD + 1)
        elif self.held > 2 * SHARD * self.shards:
            self.shards = self.held // SHARD + 1
            self._apply(self.live().select("sha", *FIELDS), "add", self.state.where("false"))

    def insert(self, docs: DataFrame) -> None:
        new = digests(docs).withColumn("tag", F.monotonically_increasing_id()).withColumn("batch", F.lit(self.batches).cast("long")).checkpoint()
        self.batches += 1
        self._deal(new.count())
        parts = new.withColumn("n", F.lit(1).cast("long")).select("sha", *FIELDS).mapInArrow(_combine, "sha binary, " + ", ".join(f"{c} long" for c in FIELDS))
        self._apply(parts, "add")
        self.rows = self.rows.unionByName(new)

    def delete(self, ids: DataFrame) -> None:
        """All rows with one of these doc_ids (one column) go; where a keeper goes, the best of the rows left takes its place."""
        ids = ids.toDF("gone").distinct()
        dead = self.rows.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").select("sha").distinct().checkpoint()
        self.rows = self.rows.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").checkpoint()
        order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "batch", "tag", "chars")
        left = self.rows.join(dead, "sha", "left_semi").groupBy("sha").agg(F.count("*").alias("n"), F.min(order).alias("k"))
        now = dead.join(left, "sha", "left").select("sha", F.coalesce("n", F.lit(0)).alias("n"), "k.chars", "k.doc_id", "k.batch", "k.tag")
        self._apply(now, "put")

    def live(self) -> DataFrame:
        """Stored keys with count and keeper."""
        return self.state.where("kind = 'live'")

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id and the live keeper's keep_id of documents whose text is in the index; filters are asked first, stored keys verify their hits."""
        asked = digests(docs).checkpoint()
        keys = asked.select("sha").distinct()
        hits = self.state.where("kind = 'filter'").unionByName(self._state_rows(keys, "ask")).groupBy("shard").applyInArrow(screened, STATE).where("hit").select("sha")
        found = self.live().join(hits, "sha", "left_semi").select("sha", F.col("doc_id").alias("keep_id"))
        return asked.join(found, "sha").select("doc_id", "keep_id")

    def verdicts(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept and text_sha256 of every live row."""
        groups = self.live().where("n > 1").select("sha", F.struct("n", "doc_id", "batch", "tag").alias("g"))
        kept = F.col("g").isNull() | ((F.col("g.batch") == F.col("batch")) & (F.col("g.tag") == F.col("tag")))
        return self.rows.join(groups, "sha", "left").select(
            "doc_id", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("g.doc_id")).alias("keep_id"), F.coalesce("g.n", F.lit(1)).cast("long").alias("group_size"),
            kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Verdicts of an index that all documents are inserted into."""
    index = ExactIndex(docs.sparkSession)
    index.insert(docs)
    return index.verdicts()
