"""Exact deduplication through a cuckoo-filter index of live digests.

A text is known by the SHA-256 of its characters without white space.  The index
holds one entry per live digest: a 16-bit fingerprint in one of two buckets of four
slots, and beside the slot a pointer to the stored key.  A fingerprint that matches
is verified against the key it points to; entries can be deleted again; when a
placement runs into too many moves, the table doubles and is filled anew from the
stored keys.  Tasks first combine their own rows in a bounded index, then each
shard of digests has one index that decides.
"""

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch.llm.base import free_name, shipped
from fraudwatch.session import settle

shipped(__name__)

SPACE = " \t\n\x0b\x0c\r"
DIGEST = 32
SLOTS = 4
#: Moves of fingerprints after which a table counts as full.
MOVES = 200
#: Live digests that a task combines at a time before the shuffle.
COMBINED = 200_000
#: Rows whose digests one shard's index holds, about 100 bytes each.
SHARD_ROWS = 1_000_000
LIVE = "digest binary, copies bigint, n_chars bigint, unnamed int, doc_id bigint, row bigint"
NAMES = [x.split()[0] for x in LIVE.split(", ")]


class CuckooIndex:
    """Live digests and, for each, the copies met and the row that stays."""

    def __init__(self, buckets: int = 256):
        self.keys, self.alive, self.free = bytearray(), 0, []
        self.copies, self.rank = array("q"), []
        self._table(buckets)

    def _table(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))  # 0: a free slot
        self.entry = array("q", bytes(8 * SLOTS * buckets))

    def key(self, entry: int) -> bytes:
        return bytes(self.keys[entry * DIGEST : (entry + 1) * DIGEST])

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & self.mask)

    def _slot(self, digest: bytes) -> int:
        """The slot of a live digest, or -1: fingerprints first, then the stored key."""
        mark, first, second = self._places(digest)
        prints = self.prints
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[slot] == mark and self.key(self.entry[slot]) == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> int:
        """The entry of a live digest, or -1."""
        slot = self._slot(digest)
        return -1 if slot < 0 else self.entry[slot]

    def _place(self, digest: bytes, entry: int) -> bool:
        mark, first, second = self._places(digest)
        prints, held = self.prints, self.entry
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[slot]:
                    prints[slot], held[slot] = mark, entry
                    return True
        bucket = first
        for turn in range(MOVES):
            slot = bucket * SLOTS + (turn + entry) % SLOTS
            prints[slot], mark = mark, prints[slot]
            held[slot], entry = entry, held[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[slot]:
                    prints[slot], held[slot] = mark, entry
                    return True
        return False

    def insert(self, digest: bytes, copies: int, rank: tuple) -> int:
        """Add a digest that is not live; its entry."""
        if self.free:
            entry = self.free.pop()
            self.keys[entry * DIGEST : (entry + 1) * DIGEST] = digest
            self.copies[entry], self.rank[entry] = copies, rank
        else:
            entry = len(self.copies)
            self.keys += digest
            self.copies.append(copies)
            self.rank.append(rank)
        self.alive += 1
        if not self._place(digest, entry):
            self._grow()
        return entry

    def _grow(self) -> None:
        """Double the table until every stored key finds a place."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._table(buckets)
            if all(self._place(self.key(e), e) for e in range(len(self.copies)) if self.rank[e] is not None):
                return

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; whether it was live."""
        slot = self._slot(digest)
        if slot < 0:
            return False
        entry = self.entry[slot]
        self.prints[slot] = 0
        self.rank[entry] = None
        self.free.append(entry)
        self.alive -= 1
        return True

    def add(self, digest: bytes, copies: int, rank: tuple) -> None:
        """Count rows of a digest; of two rows the one with the lower rank stays."""
        entry = self.find(digest)
        if entry < 0:
            self.insert(digest, copies, rank)
            return
        self.copies[entry] += copies
        if rank < self.rank[entry]:
            self.rank[entry] = rank

    def entries(self) -> Iterator[int]:
        return (e for e in range(len(self.copies)) if self.rank[e] is not None)

    def rows(self, entries: list[int]) -> pa.RecordBatch:
        """Entries as rows of the live table; a rank is (-n_chars, unnamed, doc_id, row)."""
        ranks = [self.rank[e] for e in entries]
        return pa.record_batch([
            pa.array([self.key(e) for e in entries], pa.binary()), pa.array([self.copies[e] for e in entries], pa.int64()),
            pa.array([-r[0] for r in ranks], pa.int64()), pa.array([r[1] for r in ranks], pa.int32()),
            pa.array([r[2] for r in ranks], pa.int64()), pa.array([r[3] for r in ranks], pa.int64()),
        ], names=NAMES)

    def batches(self, size: int = 50_000) -> Iterator[pa.RecordBatch]:
        held = []
        for entry in self.entries():
            held.append(entry)
            if len(held) == size:
                yield self.rows(held)
                held = []
        if held:
            yield self.rows(held)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, tuple]]:
    digest, copies, chars, unnamed, ids, row = (batch.column(n).to_pylist() for n in NAMES)
    return zip(digest, copies, zip([-c for c in chars], unnamed, ids, row))


def combine(batches: Iterator[pa.RecordBatch], most: int = COMBINED) -> Iterator[pa.RecordBatch]:
    """Merge a task's rows in an index of bounded size.

    When it is full, digests met once are deleted from it and sent on; those that keep
    coming stay, so a text that owns a third of the rows leaves a task once or twice.
    """
    index = CuckooIndex()
    for batch in batches:
        for digest, copies, rank in _read(batch):
            index.add(digest, copies, rank)
            if index.alive >= most:
                leaving = [e for e in index.entries() if index.copies[e] == 1]
                if len(leaving) < most // 2:
                    leaving = list(index.entries())
                yield index.rows(leaving)
                for entry in leaving:
                    index.delete(index.key(entry))
    yield from index.batches()


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's events in order (stored entries, withdrawals, arrivals) to its live entries."""
    index = CuckooIndex()
    for batch in batches:
        for event, (digest, copies, rank) in zip(batch.column("event").to_pylist(), _read(batch)):
            if event == WITHDRAWN:
                index.delete(digest)
            else:
                index.add(digest, copies, rank)
    yield from index.batches()


STORED, WITHDRAWN, ARRIVED = 0, 1, 2


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def keyed(docs: DataFrame) -> DataFrame:
    """The live table's columns for every single row, without texts; settled, so that row numbers hold."""
    return settle(docs.select(
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.lit(1).cast("bigint").alias("copies"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), F.col("doc_id").isNull().cast("int").alias("unnamed"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
    ))


def update(index: DataFrame | None, arrived: DataFrame | None = None, withdrawn: DataFrame | None = None,
           shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The live table after the digests of ``withdrawn`` have left ``index`` and the rows of ``arrived`` have come.

    All three have the columns of ``keyed``; a withdrawn digest goes with all its
    copies.  The shards are as many as the rows need.
    """
    told = [t.select(*NAMES, F.lit(event).alias("event")) for event, t in ((STORED, index), (WITHDRAWN, withdrawn)) if t is not None]
    total = sum(t.count() for t in told)
    if arrived is not None:
        total += arrived.count()
        told.append(arrived.select(*NAMES).mapInArrow(combine, LIVE).withColumn("event", F.lit(ARRIVED)))
    events = told[0]
    for more in told[1:]:
        events = events.unionByName(more)
    spark = events.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_rows))
    dealt = events.repartition(shards, "digest")
    if len(told) > 1:
        dealt = dealt.sortWithinPartitions("event")
    return dealt.mapInArrow(replay, LIVE)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: digest, doc_id, n_chars, keep_id, group_size and whether it is the row that stays.

    Texts are equal when they are so without the characters of white space; a null
    text is an empty one, and all empty texts are equal.  The row with the most code
    points stays, then the one with the smallest doc_id (rows without one come last),
    then, among repeated rows, one of them.  keep_id is null where the row that stays
    has no doc_id.  An empty table gives no rows; other columns are not read.
    """
    rows = keyed(docs)
    live = update(None, rows).where("copies > 1")
    stays = live.select(
        "digest", F.col("copies").alias("group_size"), F.when(F.col("unnamed") == 0, F.col("doc_id")).alias("keep"),
        F.col("row").alias("keep_row"))
    # Texts met once need no partner; of a text met by many rows, the rows are dealt out anew if they are too many.
    met = rows.join(settle(stays), "digest", "left")
    own = F.when(F.col("unnamed") == 0, F.col("doc_id"))
    alone = F.col("group_size").isNull()
    return met.select(
        "digest", own.alias("doc_id"), "n_chars", F.when(alone, own).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one stays."""
    told = settle(classes(docs))
    one, key, size, times = (free_name(docs, n) for n in ("kept_id", "kept_digest", "kept_chars", "kept_times"))
    named = told.select(F.col("doc_id").alias(one), F.col("digest").alias(key), F.col("n_chars").alias(size), "kept")
    kept = named.groupBy(one, key, size).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias(times)).where("kept").drop("kept")
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    fits = F.col("doc_id").cast("bigint").eqNullSafe(F.col(one)) & (digest == F.col(key)) & (
        F.length(F.coalesce("text", F.lit(""))) == F.col(size))
    out = docs.join(kept, fits)
    # Only rows that are repeated are compared again.
    repeated = out.where(F.col(times) > 1).dropDuplicates([one, key, size])
    return out.where(F.col(times) == 1).unionByName(repeated).select(*docs.columns)
