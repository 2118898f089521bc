"""Exact Jaccard self-join of shingle sets by set relations: skip index blocks, derive answers from similar sets.

The stages, each a Spark job whose unit is a row or a bounded block:

1. Every text becomes its set of shingle hashes; equal sets become one.
2. Hashes are dealt to buckets and counted.  A hash of one set only can join
   nothing, so it is dropped there, and a set that keeps too few hashes to
   reach the threshold is done.
3. What is left is ordered by frequency, and each set lists its first hashes
   (the prefix that any partner must meet) in an index.  Lists are laid out in
   blocks of similar set size; blocks out of reach are never joined.
4. Answers come in rounds.  A list first compares all its sets with one leader.
   Sets that join the leader join its component and so have their answer from it.
   Sets of a large component, or of small ones around a busy set, form chunks; a set asks a
   chunk only if they share a list and are in different components, and the smaller
   component asks the larger.
   A chunk's lists answer for all its sets at once, exactly.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fraudwatch.llm.base import WordHashes, blocks, mix, shingle_hashes, shipped, small_batches, tidied, word_array
from fraudwatch.llm.components import connected
from fraudwatch.session import settle

shipped(__name__)

WIDTH = 5
#: Two sets join when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rounds of comparisons with leaders before what is left open.
ROUNDS = 2
#: Sets of a chunk, and sets that a task compares with a chunk.
CHUNK, ASKING = 1024, 256
#: Slices, a power of two, in which a bucket's hashes are counted.
SLICES = 8


def shingle_set(hashes: WordHashes, text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z count as lower case, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.unique(shingle_hashes(word_array(hashes, words), width))


def set_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a set: equal sets, equal ids."""
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return int(mix(np.bitwise_xor.reduce(mix(shingles + place * np.uint64(0x9E3779B97F4A7C15)), keepdims=True)).view(np.int64)[0]) if len(shingles) else 0


def sets_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, the size of its set and the set's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches, "text"):
            found = [shingle_set(hashes, text, width) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array(map(set_id, found), pa.int64())],
                names=["doc_id", "n_shingles", "sid"],
            )

    return _slim(docs).mapInArrow(tidied(run), "doc_id bigint, n_shingles bigint, sid bigint")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _dealt(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Hashes of every set by bucket: per block of texts and bucket, runs of one set's hashes.

    ``head`` holds (set id, set size, hashes here) of each run, ``hashes`` the
    runs one after the other.  The bucket comes from a hash's upper 16 bits and
    its lower 48 are sent, so with many buckets nothing is lost, and with few
    there is little to confuse.  Copies within a block are sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in blocks(batches, "text"):
            sets: dict[int, np.ndarray] = {}
            for text in batch.column("text").to_pylist():
                found = shingle_set(known, text, width)
                if len(found):
                    sets.setdefault(set_id(found), found)
            if not sets:
                continue
            sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
            hashes = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(sets)), sizes)
            bucket = (hashes >> np.uint64(48)).astype(np.int64) % buckets
            order = np.lexsort((owner, bucket))
            hashes, owner, bucket = hashes[order], owner[order], bucket[order]
            ids = np.fromiter(sets, np.int64, len(sets))
            ends = np.flatnonzero(np.diff(bucket)) + 1
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(bucket)]):
                sets_here, runs = np.unique(owner[lo:hi], return_counts=True)
                head = np.stack([ids[sets_here], sizes[sets_here], runs])
                low = hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                for column, value in zip(out, (int(bucket[lo]), head.tobytes(), low.tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                names=["bucket", "head", "hashes"],
            )

    return _slim(docs).mapInArrow(tidied(run), "bucket int, head binary, hashes binary")


def _shared(parts: list, heads: list, of: list, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice of a bucket's hashes, in order, those of two sets at least, with the set and the number of sets."""
    found, owners = [], []
    for (bucket, low), head, sets in zip(parts, heads, of):
        here = np.flatnonzero(low[:, 5] // (256 // SLICES) == part)  # the highest byte
        wide = np.zeros((len(here), 8), np.uint8)
        wide[:, :6] = low[here]
        found.append(wide.view("<u8").ravel() | np.uint64(bucket << 48))
        owners.append(sets[np.searchsorted(np.cumsum(head[2]), here, "right")])
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    # Most hashes stand alone: sort values only, then look closer at those that repeat.
    values = np.sort(hashes)
    twice = values[1:][values[1:] == values[:-1]]
    if len(twice):
        repeats = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
        hashes, owner = hashes[repeats], owner[repeats]
    else:
        hashes, owner = hashes[:0], owner[:0]
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)  # a copy of a set repeats its (hash, set)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    starts = np.flatnonzero(np.append(np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]))
    count = np.diff(np.append(starts, len(hashes)))
    count = np.repeat(count, count)
    shared = count > 1
    return hashes[shared], owner[shared], count[shared]


def _counted(dealt: DataFrame, buckets: int) -> DataFrame:
    """The hashes that other sets have too, with the number of sets that have them, dealt back by set.

    Rows are laid out as in ``_dealt``, with the bucket of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, parts = [], []
        for batch in batches:
            for bucket, head, low in zip(*(batch.column(c).to_pylist() for c in ("bucket", "head", "hashes"))):
                parts.append((bucket, np.frombuffer(low, np.uint8).reshape(-1, 6)))
                heads.append(np.frombuffer(head, np.int64).reshape(3, -1))
        if not parts:
            return
        head = np.concatenate(heads, axis=1)
        sids, of = np.unique(head[0], return_inverse=True)
        size = np.zeros(len(sids), np.int64)
        size[of] = head[1]
        of = np.split(of.astype(np.int32), np.cumsum([h.shape[1] for h in heads])[:-1])
        slices = [_shared(parts, heads, of, part) for part in range(SLICES)]
        hashes, owner, count = (np.concatenate(x) for x in zip(*slices))
        if not len(hashes):
            return
        del parts, slices
        dest = (mix(sids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)[owner]
        order = np.lexsort((owner, dest))
        dest, hashes, owner, count = dest[order], hashes[order], owner[order], count[order]
        ends = np.flatnonzero(np.diff(dest)) + 1
        out: tuple[list, ...] = ([], [], [], [])
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(dest)]):
            if lo == hi:
                continue
            here, runs = np.unique(owner[lo:hi], return_counts=True)
            head = np.stack([sids[here], size[here], runs])
            values = (int(dest[lo]), head.tobytes(), hashes[lo:hi].tobytes(), np.minimum(count[lo:hi], 0xFFFFFFFF).astype(np.uint32).tobytes())
            for column, value in zip(out, values):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "head", "hashes", "counts"]
        )

    return dealt.repartition(buckets, "bucket").mapInArrow(tidied(run), "bucket int, head binary, hashes binary, counts binary")


def _ordered(counted: DataFrame, percent: int, buckets: int) -> DataFrame:
    """sid, n and the shared hashes, rarest first, of sets that can have a partner; prefix is how many to index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, parts, often = [], [], []
        for batch in batches:
            heads += [np.frombuffer(x, np.int64).reshape(3, -1) for x in batch.column("head").to_pylist()]
            parts += [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
            often += [np.frombuffer(x, np.uint32) for x in batch.column("counts").to_pylist()]
        if not parts:
            return
        head, hashes, often = np.concatenate(heads, axis=1), np.concatenate(parts), np.concatenate(often)
        sids, of = np.unique(head[0], return_inverse=True)
        size = np.zeros(len(sids), np.int64)
        size[of] = head[1]
        owner = np.repeat(of, head[2])
        order = np.lexsort((hashes, often, owner))
        hashes, bounds = hashes[order], np.searchsorted(owner[order], np.arange(len(sids) + 1))
        shared = np.diff(bounds)
        need = -(-percent * size // 100)
        for at in range(0, len(sids), 1000):
            kept = [i for i in range(at, min(at + 1000, len(sids))) if shared[i] >= need[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sids[kept]), pa.array(size[kept]), pa.array([hashes[bounds[i] : bounds[i + 1]].tobytes() for i in kept], pa.binary()),
                 pa.array((shared - need + 1)[kept])],
                names=["sid", "n", "hashes", "prefix"],
            )

    return counted.repartition(buckets, "bucket").mapInArrow(tidied(run), "sid bigint, n bigint, hashes binary, prefix bigint")


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """The index: (hash, block of sizes, set, size, place of the hash in the set's order).

    Partners' sizes differ by less than the factor 100 / percent, which is the
    width of a block, so they lie in one block or in two neighbouring ones.
    """
    step = float(np.log(100 / percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prefix = batch.column("n").to_numpy(), batch.column("prefix").to_numpy()
            if not len(n):
                continue
            hashes = [np.frombuffer(h, np.int64)[:p] for h, p in zip(batch.column("hashes").to_pylist(), prefix.tolist())]
            full = np.array([len(h) // 8 for h in batch.column("hashes").to_pylist()])
            count = np.array([len(h) for h in hashes])
            place = np.concatenate([np.arange(c) for c in count]) + np.repeat(n - full, count)
            block = np.floor(np.log(n) / step + 1e-9).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes)), pa.array(np.repeat(block, count)),
                 pa.array(np.repeat(batch.column("sid").to_numpy(), count)), pa.array(np.repeat(n, count)), pa.array(place)],
                names=["hash", "block", "sid", "n", "place"],
            )

    return sets.mapInArrow(tidied(run), "hash bigint, block int, sid bigint, n bigint, place bigint")


def _possible(percent: int):
    """Sizes and places of two index entries allow a join: what can still follow reaches the least intersection."""
    n, m = F.col("n"), F.col("m")
    sizes = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    # intersection * (100 + percent) >= percent * (n + m)
    most = F.least(n - F.col("place"), m - F.col("mplace"))
    return sizes & (most * (100 + percent) >= (n + m) * percent)


def _to_leaders(index: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs of a set and the leader of one of its lists, one leader for each hash and block."""
    scramble = F.xxhash64(F.lit(seed), F.col("sid"))
    leaders = index.groupBy("hash", F.col("block").alias("oblock")).agg(
        F.min(F.struct(scramble.alias("r"), F.col("sid").alias("other"), F.col("n").alias("m"), F.col("place").alias("mplace"))).alias("top")
    )
    leaders = leaders.select("hash", "oblock", "top.other", "top.m", "top.mplace")
    met = index.join(leaders, "hash").where((F.col("block") - F.col("oblock")).between(-1, 1) & (F.col("sid") != F.col("other")) & _possible(percent))
    return met.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()


def _members(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """sid, its component so far with its size, and its chunk: at most about CHUNK sets of one large component, or of small ones together.

    A large component's leaders are dealt to as many shelves as its size asks for, so near
    copies with a leader for every few sets do not make a chunk of each.  A component of
    less than CHUNK sets goes as a whole to the shelf of the busiest set that it was
    compared with, so sets just short of joining do not make a chunk of each either.
    """
    comps = connected(known.where(_joins(percent)).select("a", "b"))
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    comps = comps.join(sizes, "comp").withColumnRenamed("node", "sid")
    rows = sets.select("sid").join(comps, "sid", "left").join(_pivots(known), "sid", "left").join(_busiest(known), "sid", "left")
    rows = rows.select("sid", F.coalesce("comp", "sid").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("pivot", "sid").alias("pivot"), "busiest")
    anchors = rows.where(F.col("size") < CHUNK).groupBy("comp").agg(F.coalesce(F.max("busiest")["met"], F.col("comp")).alias("anchor"))
    rows = rows.join(anchors, "comp", "left")
    large = F.xxhash64("comp", F.pmod(F.xxhash64(F.lit("shelf"), "pivot"), F.ceil(F.col("size") / CHUNK)))
    rows = rows.withColumn("shelf", F.coalesce("anchor", large))
    crowd = rows.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    part = F.pmod(F.xxhash64(F.lit("chunk"), F.when(F.col("anchor").isNull(), F.col("sid")).otherwise(F.col("comp"))), "chunks")
    return rows.join(crowd, "shelf").select("sid", "comp", "size", F.xxhash64("shelf", part).alias("chunk"))


def _open_chunks(index: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """sid and chunk: sets that share a list with a chunk which holds members of a larger component there.

    Of two components the smaller asks (of equal ones that with the smaller id), so
    the many sets of one large component ask nothing about the few around it.
    """
    told = index.join(members, "sid").withColumn("own", F.struct("size", "comp"))
    lists = told.groupBy("hash", F.col("block").alias("oblock"), "chunk").agg(
        F.max("own").alias("top"), F.min("n").alias("m"), F.max("n").alias("m_most"), F.min("place").alias("mplace")
    )
    near = (F.col("block") - F.col("oblock")).between(-1, 1) & (F.col("own") < F.col("top"))
    n = F.col("n")
    sizes = (n * 100 >= F.col("m") * percent) & (F.col("m_most") * 100 >= n * percent)
    most = F.least(n - F.col("place"), F.col("m_most") - F.col("mplace"))
    possible = sizes & (most * (100 + percent) >= (n + F.col("m")) * percent)
    asking = told.select("hash", "block", "sid", "n", "place", "own")
    return asking.join(lists, "hash").where(near & possible).select("sid", "chunk").distinct()


def _answered(asking: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of asking sets with members of their chunks, one at least for each other component that has any.

    A chunk's sets go to a task together with at most about ASKING of the sets that
    ask; a chunk that more sets ask about goes to several tasks.
    """
    crowd = asking.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("pieces"))
    told = members.join(sets.select("sid", "n", "hashes"), "sid")
    piece = F.pmod(F.xxhash64(F.lit("piece"), "sid"), "pieces").cast("int").alias("piece")
    columns = ["sid", "n", "comp", "size", "hashes"]
    left = asking.join(crowd, "chunk").select("sid", F.col("chunk").alias("of"), piece).join(told, "sid")
    left = left.select(F.col("of").alias("asked"), F.col("piece").alias("part"), *(F.col(c).alias(f"my_{c}") for c in columns))
    every = F.explode(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)).alias("piece")
    right = told.join(crowd, "chunk").select(F.col("chunk").alias("of"), every, *columns)

    def answer(asked: pa.Table, chunk: pa.Table) -> pa.Table:
        found: tuple[list, list] = ([], [])
        if asked.num_rows and chunk.num_rows:
            sids, n, comp, size = (chunk.column(c).to_numpy() for c in ("sid", "n", "comp", "size"))
            sets_here = [np.frombuffer(x, np.uint64) for x in chunk.column("hashes").to_pylist()]
            hashes, owner = np.concatenate(sets_here), np.repeat(np.arange(len(sids)), [len(x) for x in sets_here])
            order = np.argsort(hashes)
            hashes, owner = hashes[order], owner[order]
            rows = zip(*(asked.column(f"my_{c}").to_pylist() for c in columns))
            for sid, own_n, own_comp, own_size, blob in rows:
                mine = np.frombuffer(blob, np.uint64)
                low, high = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
                runs = high - low
                at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
                common = np.bincount(owner[at], minlength=len(sids))
                larger = (size > own_size) | ((size == own_size) & (comp > own_comp))
                links = np.flatnonzero(larger & (common * (100 + percent) >= percent * (own_n + n)))
                for i in links[np.unique(comp[links], return_index=True)[1]]:
                    found[0].append(sid)
                    found[1].append(int(sids[i]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return left.groupBy("asked", "part").cogroup(right.groupBy("of", "piece")).applyInArrow(answer, "a bigint, b bigint")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with their exact intersection, from the shared hashes of both sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                for x, y in zip(batch.column("ha"), batch.column("hb"))
                for x, y in [(x.as_buffer(), y.as_buffer())]
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"]
            )

    return pairs.join(left, "a").join(right, "b").mapInArrow(tidied(run), "a bigint, b bigint, na bigint, nb bigint, common bigint")


def _joins(percent: int):
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def _pivots(known: DataFrame) -> DataFrame:
    """For each compared set the leader nearest to it, with the exact Jaccard distance."""
    distance = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    both = known.select(F.col("a").alias("sid"), F.struct(distance.alias("distance"), F.col("b").alias("pivot")).alias("p")).unionByName(
        known.select(F.col("b").alias("sid"), F.struct(distance.alias("distance"), F.col("a").alias("pivot")).alias("p"))
    )
    return both.groupBy("sid").agg(F.min("p").alias("p")).select("sid", "p.pivot", "p.distance")


def _busiest(known: DataFrame) -> DataFrame:
    """For each compared set the busiest around it: of itself and those it was compared with the one that was compared most often.

    The busiest around that one is taken, so the leaders of lists with much the same sets end at few of them.
    """
    both = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    often = both.groupBy(F.col("a").alias("met")).agg(F.count(F.lit(1)).alias("times"))
    told = F.struct("times", "met").alias("told")
    met = both.join(often, F.col("b") == F.col("met")).select(F.col("a").alias("sid"), told)
    first = settle(met.unionByName(often.select(F.col("met").alias("sid"), told)).groupBy("sid").agg(F.max("told").alias("busiest")))
    second = first.select(F.col("sid").alias("met"), F.col("busiest").alias("further"))
    return first.join(second, F.col("busiest.met") == F.col("met")).select("sid", F.col("further").alias("busiest"))


def set_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different sets that together connect all sets that join.

    Each link is a joining pair, compared exactly.  A joining pair without a link
    of its own lies in one component with others that connect it.
    """
    spark = docs.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    with small_batches(spark):
        sets = settle(_ordered(_counted(_dealt(docs, width, buckets), buckets), percent, buckets))
        index = settle(_index(sets, percent))
    known = None
    for seed in range(ROUNDS):
        pairs = _to_leaders(index, percent, seed)
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        with small_batches(spark):
            found = settle(_compared(pairs, sets))
        known = found if known is None else known.unionByName(found)
    members = settle(_members(sets, known, percent))
    asking = settle(_open_chunks(index, members, percent))
    with small_batches(spark):
        found = settle(_answered(asking, members, sets, percent))
    return known.where(_joins(percent)).select("a", "b").unionByName(found)


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows with equal shingle sets are in one component; so are rows whose sets
    join.  component_id is the smallest doc_id of the component.  A null or empty
    text, or one of white space, has no shingles, joins nothing and keeps its own
    doc_id.  Rows with a null doc_id take part and get a null component_id only if
    no row of their component has one.  Repeated rows stay.  Columns other than
    doc_id and text are not looked at.  Set and shingle ids are 64-bit hashes.
    """
    with small_batches(docs.sparkSession):
        rows = settle(sets_of(docs, width))
    comps = connected(set_links(docs, width, percent))
    grouped = rows.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
    placed = grouped.join(comps.select(F.col("node").alias("sid"), "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    smallest = placed.groupBy("comp").agg(F.min("first").alias("component"))
    answer = placed.join(smallest, "comp").select("sid", "component")
    full = rows.where("n_shingles > 0").join(answer, "sid").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)
