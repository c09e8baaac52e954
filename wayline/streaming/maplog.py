"""A digest-checked log of changes: batches of set and deleted keys, applied in order, batch or streaming.

A batch is (seq, at, app, why, set map<string,string>, del array<string>, freed array<string>, digest decimal).  The digest of a state is the
sum of a 62-bit hash of every (key, value), modulo 2^62, so it follows from a batch's changes alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators import sequences as Q
from wayline.session import checkpoint_dir, cut

BATCH = "seq long, at string, app string, why string, set map<string,string>, del array<string>, freed array<string>, digest decimal(20,0)"
MODULUS = 1 << 62
NOTHING = "key string, value string"


def entry_hash(key: Column, value: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit("\0"), value), 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(MODULUS).cast("decimal(20,0)")


def digest(entries: DataFrame) -> DataFrame:
    """One row: the state's digest and its number of entries."""
    total = F.coalesce(F.sum(entry_hash(F.col("key"), F.col("value")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return entries.agg((total % F.lit(MODULUS).cast("decimal(38,0)")).cast("decimal(20,0)").alias("digest"), F.count("*").alias("n"))


def changes(batches: DataFrame) -> DataFrame:
    """(seq, key, value): what each batch does; value null deletes.  A key that a batch both deletes and sets is set."""
    s = batches.select("seq", F.explode("set").alias("key", "value"))
    d = batches.select("seq", F.explode("del").alias("key")).withColumn("value", F.lit(None).cast("string"))
    return s.unionByName(d).groupBy("seq", "key").agg(F.max("value").alias("value"))


def apply_batches(entries: DataFrame, batches: DataFrame) -> DataFrame:
    """The entries (key, value) after all batches: each key's last change counts."""
    last = changes(batches).groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("x")).select("key", "x.value")
    kept = entries.join(last.select("key"), "key", "left_anti")
    return kept.select("key", "value").unionByName(last.where("value is not null"))


#: Batches per chunk of the running sums over a log, which go over one row per chunk.
LOG_CHUNK = 4096


def _over_log(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the batches up to and with the row's."""
    return Q.running(df.withColumn("__c", F.floor(F.col("seq") / LOG_CHUNK)), [], ["seq"], value, out).drop("__c")


def digests_after(entries: DataFrame, batches: DataFrame, base: int | None = None) -> DataFrame:
    """(seq, digest): the digest after each batch, from the changes alone; to be held against the digests that the batches name.

    ``base``: the digest of ``entries`` if it is known; of the entries then only the changed ones are read."""
    c = changes(batches)
    old = entries.select("key", "value").join(c.select("key").distinct(), "key", "left_semi")
    w = Window.partitionBy("key").orderBy(F.asc_nulls_first("seq"))
    zero = F.lit(0).cast("decimal(38,0)")
    h = F.when(F.col("value").isNotNull(), entry_hash(F.col("key"), F.col("value")))
    x = c.unionByName(old.select(F.lit(None).cast("long").alias("seq"), "key", "value")).withColumn("h", F.coalesce(h, F.lit(0).cast("decimal(20,0)")).cast("decimal(38,0)"))
    per = x.withColumn("d", F.col("h") - F.coalesce(F.lag("h").over(w), zero)).where("seq is not null").groupBy("seq").agg(F.sum("d").alias("d"))
    if base is None:
        base = int(digest(entries).first().digest)
    m = F.lit(MODULUS).cast("decimal(38,0)")
    # one row per batch from here on; a batch without changes keeps the digest of the one before
    per = batches.select("seq").distinct().join(per, "seq", "left").select("seq", F.coalesce(F.col("d").cast("decimal(38,0)"), zero).alias("d"))
    return _over_log(per, "d", "run").select("seq", ((((F.col("run") + F.lit(base).cast("decimal(38,0)")) % m + m) % m).cast("decimal(20,0)")).alias("digest"))


def check_batches(entries: DataFrame, batches: DataFrame, after: int, digests: DataFrame | None = None) -> DataFrame:
    """(seq, fault): batches that don't follow the one before ('gap'; the first must follow ``after``) or name another digest ('digest');
    ``digests``: as from digests_after, if they are known."""
    b = Q.beside(batches.select("seq", "digest"), [], ["seq"], [], LOG_CHUNK).withColumn("__p", F.coalesce("__prev.seq", F.lit(after)))
    gaps = b.where(F.col("seq") != F.col("__p") + 1).select("seq", F.lit("gap").alias("fault"))
    got = (digests_after(entries, batches) if digests is None else digests).withColumnRenamed("digest", "got")
    bad = b.where("digest is not null").join(got, "seq").where("digest <> got").select("seq", F.lit("digest").alias("fault"))
    return gaps.unionByName(bad)


def map_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, what, value): 'set' with the new value or 'deleted', from one state to another; what is equal isn't listed."""
    x = old.select("key", F.col("value").alias("a"), F.lit(True).alias("ina")).join(new.select("key", F.col("value").alias("b"), F.lit(True).alias("inb")), "key", "full_outer")
    what = F.when(F.col("inb").isNull(), "deleted").when(F.col("ina").isNull() | ~F.col("a").eqNullSafe(F.col("b")), "set")
    return x.withColumn("what", what).where("what is not null").select("key", "what", F.col("b").alias("value"))


def changes_since(batches: DataFrame, since: int, max_bytes: int, oldest: int) -> DataFrame:
    """(seq, what, bytes): the batches after a cursor, as many as stay within ``max_bytes`` (one at least).  A cursor before the oldest batch
    held gets one row 'reset': take the snapshot."""
    if since + 1 < oldest:
        return batches.sparkSession.createDataFrame([(oldest, "reset", 0)], "seq long, what string, bytes long")
    size = F.length(F.to_json(F.struct("set", "del"))).cast("long")
    b = batches.where(F.col("seq") > since).select("seq", size.alias("bytes"))
    b = _over_log(b, "bytes", "run")
    return b.where((F.col("run") <= max_bytes) | (F.col("run") == F.col("bytes"))).select("seq", F.lit("batch").alias("what"), "bytes")


def watch_marks(batches: DataFrame, depth: int = 1) -> DataFrame:
    """(prefix, seq): the last batch that touched a key of each prefix (parts before the ``depth``-th slash)."""
    return changes(batches).groupBy(F.substring_index("key", "/", depth).alias("prefix")).agg(F.max("seq").alias("seq"))


def due_deletes(freed: DataFrame, holders: DataFrame, cursors: DataFrame) -> DataFrame:
    """(name, seq): freed names (name, seq) that no entry holds (holders: name) and that every client (cursors: client, seq) has passed."""
    last = freed.groupBy("name").agg(F.max("seq").alias("seq"))
    low = cursors.agg(F.coalesce(F.min("seq"), F.lit((1 << 62))).alias("low"))
    return last.join(holders.select("name").distinct(), "name", "left_anti").join(F.broadcast(low), F.col("seq") <= F.col("low")).select("name", "seq")


def orphans(stored: DataFrame, holders: DataFrame, freed: DataFrame) -> DataFrame:
    """Stored names that nothing holds and nothing has freed."""
    return stored.select("name").distinct().join(holders.select("name"), "name", "left_anti").join(freed.select("name"), "name", "left_anti")


def stale_targets(targets: DataFrame, reads: DataFrame, files: DataFrame, last: DataFrame) -> DataFrame:
    """(target, key): targets whose content key, the hash of all they read (reads: target, path; files: path, hash), differs from their last run's
    (last: target, key) or that never ran.  A file that isn't there counts as such."""
    r = reads.join(files, "path", "left").select("target", F.concat_ws("=", "path", F.coalesce("hash", F.lit("absent"))).alias("r"))
    k = targets.select("target").join(r, "target", "left").groupBy("target").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set("r"))), 256).alias("key"))
    return k.join(last.select("target", F.col("key").alias("key")), ["target", "key"], "left_anti")


def reuse_rows(rows: DataFrame, previous: DataFrame, key: list[str], values: list[str], compute) -> DataFrame:
    """Rows with ``values`` copied from the previous run where their key is found there; ``compute`` makes the others only."""
    p = previous.select(*key, *values).dropDuplicates(key)
    found = rows.join(p, key, "inner")
    missing = compute(rows.join(p.select(*key), key, "left_anti"))
    return found.unionByName(missing.select(*found.columns))


def gate(listing: DataFrame, accepted: DataFrame, checks: dict[str, Column], partner: str | None = None) -> DataFrame:
    """(path, verdict, why): new or changed files (path, hash, ...) are 'accepted', or 'held' with the first check that fails; with a
    column ``partner`` a file is held while its partner is."""
    new = listing.join(accepted.select("path", "hash"), ["path", "hash"], "left_anti")
    why = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    x = new.withColumn("why", why)
    if partner:
        bad = x.where("why is not null").select(F.col("path").alias("__bad")).distinct()
        x = x.join(bad, F.col(partner) == F.col("__bad"), "left").withColumn("why", F.coalesce("why", F.when(F.col("__bad").isNotNull(), F.lit("partner")))).drop("__bad")
    return x.select("path", F.when(F.col("why").isNull(), "accepted").otherwise("held").alias("verdict"), "why")


class StateStore:
    """Versions of the entries in a shared folder: snapshots, and between them the changes of each version.

    A version is written under its name and counts once its marker is there, so a lost executor or driver leaves the last version standing,
    and a batch that comes again is written again under the same name.  A version's changes are written, not the state; every
    ``compact_every`` versions a snapshot is, and what it makes needless is deleted.  The digest of each version is kept beside it, so that checking a batch
    reads the changed entries only."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 16):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        self.fs_path = self._path(self.folder)
        self.fs = self.fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _named(self, letter: str) -> list[int]:
        if not self.fs.exists(self.fs_path):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.fs_path)]
        return sorted(int(n[1:]) for n in names if n[:1] == letter and n[1:].isdigit() and self.fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def versions(self) -> list[int]:
        return sorted(set(self._named("v")) | set(self._named("d")))

    def newest(self) -> tuple[int, DataFrame]:
        """The last version and its entries: the last snapshot, and over it the changes since, of each key the last."""
        snaps, deltas = self._named("v"), self._named("d")
        last = max([0, *snaps, *deltas])
        base = max([0, *snaps])
        entries = self.spark.read.schema(NOTHING).parquet(f"{self.folder}/v{base}") if base else self.spark.createDataFrame([], NOTHING)
        since = [d for d in deltas if d > base]
        if not since:
            return last, entries
        changed = self.spark.read.schema("seq long, key string, value string").parquet(*[f"{self.folder}/d{d}" for d in since])
        top = changed.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("x")).select("key", "x.value")
        return last, entries.join(top.select("key"), "key", "left_anti").unionByName(top.where("value is not null"))

    def digest(self, version: int) -> int:
        return int(self.spark.read.schema("digest decimal(20,0)").parquet(f"{self.folder}/g{version}").first().digest) if version else 0

    def write(self, version: int, entries: DataFrame, changed: DataFrame, after: int) -> None:
        """``changed``: seq, key, value (null: deleted) since the last version; ``entries``: what they make of it; ``after``: its digest."""
        self.spark.createDataFrame([(str(after),)], "digest string").select(F.col("digest").cast("decimal(20,0)")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/g{version}")
        snaps, deltas = self._named("v"), self._named("d")
        open_ = [d for d in deltas if d > max([0, *snaps])]
        if len(open_) + 1 < self.compact_every:
            changed.write.mode("overwrite").parquet(f"{self.folder}/d{version}")
            return
        entries.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        # the snapshot before this one stays, with what follows it
        keep = max([0, *snaps])
        for letter, old in [("v", k) for k in snaps if k < keep] + [("d", k) for k in deltas if k <= keep] + [("g", k) for k in self._named("g") if k < keep]:
            self.fs.delete(self._path(f"{self.folder}/{letter}{old}"), True)


def follow(spark: SparkSession, feed: str, store: StateStore, checkpoint: str, files_per_batch: int = 4):
    """A streaming query that applies the feed's batch files (JSON lines) to the store, whole micro-batches at a time.

    Batches at or before the store's version are skipped, so a restart or a repeated micro-batch changes nothing; a gap or a wrong digest stops the query.  A
    micro-batch writes its changes and reads the entries they touch; the state is rewritten only when the store compacts it."""

    def each(df: DataFrame, _: int) -> None:
        # the batch's frame is planned several times
        df = df.persist()
        try:
            version, entries = store.newest()
            new = df.where(F.col("seq") > version)
            last = new.agg(F.max("seq").alias("m")).first().m
            if last is None:
                return
            digests = digests_after(entries, new, store.digest(version)).persist()
            after = int(digests.where(F.col("seq") == last).first().digest)
            faults = check_batches(entries, new, version, digests).orderBy("seq").limit(10).collect()
            digests.unpersist()
            if faults:
                raise ValueError(f"the log doesn't fit: {[(r.seq, r.fault) for r in faults]}")
            top = changes(new).groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("value"), "seq").alias("x")).select("seq", "key", "x.value")
            store.write(int(last), apply_batches(entries, new), top, after)
        finally:
            df.unpersist()

    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_batch).json(feed)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, batches: DataFrame, files: int = 6) -> DataFrame:
    """The state after batches that are written as a feed and followed by a streaming query."""
    base = f"{checkpoint_dir(spark)}/maplog-{uuid.uuid4().hex}"
    named = cut(batches.drop("digest").join(digests_after(spark.createDataFrame([], NOTHING), batches, 0), "seq"))
    bounds = named.agg(F.max("seq").alias("m")).first().m or 0
    step = -(-bounds // files) or 1
    for k in range(0, bounds, step):
        named.where((F.col("seq") > k) & (F.col("seq") <= k + step)).coalesce(1).write.mode("append").json(f"{base}/feed")
    store = StateStore(spark, f"{base}/state", 4)
    q = follow(spark, f"{base}/feed", store, f"{base}/checkpoint", 1)
    q.awaitTermination()
    return store.newest()[1]


def client_cursors(says: DataFrame, ttl_ms: int) -> DataFrame:
    """Streaming: each client's last said sequence, forgotten ``ttl_ms`` after its last word.  says: client, seq."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"client": [key[0]], "seq": [None], "gone": [True]}).astype({"seq": "Int64"})
            return
        last = state.get[0] if state.exists else -1
        for f in frames:
            last = max(last, int(f["seq"].max()))
        state.update((last,))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"client": [key[0]], "seq": [last], "gone": [False]})

    return says.groupBy("client").applyInPandasWithState(run, "client string, seq long, gone boolean", "last long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def compact(batches: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
    """The snapshot of the batches up to one, and the batches after it."""
    return apply_batches(batches.sparkSession.createDataFrame([], NOTHING), batches.where(F.col("seq") <= upto)), batches.where(F.col("seq") > upto)


def batch_line(seq: int, set_: dict, del_: list, **more) -> str:
    return json.dumps({"seq": seq, "set": set_, "del": del_, **more}, sort_keys=True)
