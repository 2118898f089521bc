"""Pieces that several operators share."""

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch.session import settle, small_batches  # noqa: F401

# Helpers travel with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of eight bytes up to which a table may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Characters of text that a task turns into one block of arrays.
BLOCK_CHARS = 2_000_000
#: Distinct words whose hashes or ids a task keeps.
CACHE_WORDS = 250_000


def shipped(module: str) -> None:
    """Let the functions of a module travel with the job."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Settle a table of a few numbers a row; mark it for broadcast if its counted rows are few.

    Beyond ``max_rows`` the same join runs as an ordinary, shuffled one.
    """
    settled = settle(df)
    return F.broadcast(settled) if settled.count() <= max_rows else settled


def kept(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for its later tasks: functions travel anew with each task."""
    store = sys.modules.setdefault("fraudwatch_kept", ModuleType("fraudwatch_kept")).__dict__
    name = repr(key)
    if name not in store:
        store[name] = make()
    return store[name]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about BLOCK_CHARS of one text column (or one long text)."""
    for batch in batches:
        sizes = _lengths(batch.column(column))
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > BLOCK_CHARS:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that leaves its Python worker slim, as workers live on from stage to stage.

    At its end what Arrow's pool holds unused is given back; a stage that ``keeps``
    nothing also lets go at its start of what another stage's tasks have ``kept``.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            sys.modules.pop("fraudwatch_kept", None)
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidy


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for as many words as the bound says."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_array(hashes: WordHashes, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (an invertible mixer)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole run where there are fewer."""
    if not len(words):
        return words
    width, count = min(width, len(words)), max(1, len(words) - width + 1)
    out = np.full(count, np.uint64(width), np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
    return out
