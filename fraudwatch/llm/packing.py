"""Packing by power-of-two decomposition: no sequence holds tokens of two documents."""

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fraudwatch.llm.base import blocks, broadcast_if_small, kept, shipped, small_batches, tidied
from fraudwatch.session import settle

shipped(__name__)

#: Longest sequence, a power of two.
MAX_TOKENS = 4096
#: Id that closes a document.
END_ID = 2
#: Runs between white space whose ids a task remembers: about 200 bytes each.
KNOWN_RUNS = 1_200_000
#: Sequences whose ids are widened at a time: at most 16 KB each.
WIDENED_ROWS = 500
#: Runs by which a vocabulary shows that its rules leave a-z as they are.
PROBES = (b"a", b"s", b"the", b"qzxv", b"abcdefghijklmnopqrstuvwxyz")
#: Marks that the vocabulary's rules always part from a letter before them.
MARKS = b",.!?;:*$%&#+-=()[]{}|/\\\"<>@^_~`"

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, turn bigint"


def cuts(tokens: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full sequences, then its remainder's binary digits.

    >>> cuts(11, 4)
    [(0, 4), (4, 4), (8, 2), (10, 1)]
    """
    out = [(start, most) for start in range(0, tokens - most + 1, most)]
    start, rest = len(out) * most, tokens % most
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


class Encoder:
    """Ids of texts as 32-bit integers in the machine's order (little-endian on all that Spark runs on), run by run.

    The vocabulary's own rules drop white space and never join what it parts, so
    each run between white space is encoded once and remembered.  A-Z are lowered
    first, as the vocabulary does; not where a text may name a special token.
    Runs of a-z, nearly all there are, have nothing that the rules could part or
    change: their merges are asked for directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.merges = self.tokenizer.model
        self.direct = all(self._plain(w) == self._ids([w])[0] for w in PROBES)

    def _ids(self, runs: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in runs], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _plain(self, run: bytes) -> bytes:
        return array("I", [token.id for token in self.merges.tokenize(run.decode())]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        runs = [(raw if b"<|" in raw else raw.lower()).split() for raw in map(str.encode, texts)]
        found = [list(map(self.known.get, words)) for words in runs]
        new = {w for words, ids in zip(runs, found) if None in ids for w, i in zip(words, ids) if i is None}
        if len(self.known) + 2 * len(new) > KNOWN_RUNS:
            self.known.clear()  # what was found stays in the lists
        self._learn(new)
        known = self.known
        return [
            b"".join(ids if None not in ids else [known[w] if i is None else i for w, i in zip(words, ids)])
            for words, ids in zip(runs, found)
        ]

    def _learn(self, new: set[bytes]) -> None:
        """Encode letters and the marks behind them apart: both are met in many runs."""
        known, parted, parts = self.known, {}, set()
        for run in new:
            core = run.rstrip(MARKS)
            if len(core) < len(run) and core and b"<|" not in run and (core.isalpha() or core.decode().lower().isalpha()):
                parted[run] = core
                parts.add(core)
                parts.add(run[len(core) :])
            else:
                parts.add(run)
        todo = parts.difference(known)
        if self.direct:
            letters = {w for w in todo if w.isalpha() and w.islower()}  # ASCII only, as of bytes
            known.update((w, self._plain(w)) for w in letters)
            todo -= letters
        todo = list(todo)
        for start in range(0, len(todo), 10_000):
            part = todo[start : start + 10_000]
            known.update(zip(part, self._ids(part)))
        known.update((w, known[core] + known[w[len(core) :]]) for w, core in parted.items())


def pieces(docs: DataFrame, vocabulary: str, most: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Cut the ids of every document into pieces whose lengths are powers of two up to ``most``.

    ``ids`` holds a piece's ids as little-endian integers: of 16 bits where all ids
    of the document fit, of 32 bits elsewhere; ``widened`` makes all 32 bits.  ``turn``
    numbers the pieces of one length within a task.  A null
    or empty text is its end id alone; a null doc_id keeps its pieces.  Repeated rows
    give repeated pieces.  Columns other than doc_id and text are not looked at.
    Rows stay in the task that reads them: nothing is shuffled.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(("encoder", vocabulary), lambda: Encoder(vocabulary))
        turns: dict[int, int] = {}
        for batch in blocks(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids += end
                tokens, width, wide = len(ids) // 4, 4, np.frombuffer(ids, "<u4")
                if wide.max() < 1 << 16:
                    ids, width = wide.astype("<u2").tobytes(), 2
                for start, length in cuts(tokens, most):
                    piece = ids[width * start : width * (start + length)]
                    turn = turns[length] = turns.get(length, -1) + 1
                    for column, value in zip(out, (doc_id, start, length, piece, tokens, turn)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "turn"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidied(cut, keeps=True), PIECES)


def widened(packed: DataFrame) -> DataFrame:
    """The same rows with all ids as 32-bit integers."""
    at = packed.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, WIDENED_ROWS):
                batch = whole.slice(start, WIDENED_ROWS)
                told = zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())
                ids = [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in told]
                yield batch.set_column(at, "ids", pa.array(ids, pa.binary()))

    return packed.mapInArrow(tidied(run, keeps=True), packed.schema)


def pack(docs: DataFrame, vocabulary: str, most: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Sequences of equal lengths next to each other: each piece is one sequence without padding.

    ``sequence_id`` numbers the sequences from 0 by length, longest first, so a
    range of ids is a bucket of equal lengths from which batches are drawn;
    ``offset`` is always 0.  ``ids`` holds little-endian 32-bit integers, 16 bits on
    the way where they fit.  An empty table gives an empty table.

    Nothing is sorted or shuffled: the encoding task numbers its pieces of each length,
    and there are few lengths, so the counts per task and length are all it takes to
    turn those numbers into the ids of the whole table.
    """
    with small_batches(docs.sparkSession):
        cut = settle(pieces(docs, vocabulary, most, end_id).withColumn("part", F.spark_partition_id()))
    counts = settle(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))  # one row per power of two
    longer = totals.select("length", (F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")).alias("longer"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    firsts = counts.withColumn("earlier", earlier).join(F.broadcast(longer), "length")
    # A row per task, with at most one entry per power of two.
    entry = F.struct("length", (F.col("longer") + F.col("earlier")).alias("first"))
    known = broadcast_if_small(firsts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("firsts")))
    numbered = cut.join(known, "part").withColumn("sequence_id", F.element_at("firsts", F.col("length")) + F.col("turn"))
    return widened(numbered.drop("part", "firsts", "turn").withColumn("offset", F.lit(0).cast("bigint")))
