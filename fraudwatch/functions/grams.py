"""Character n-grams as numbers, cut and counted for a batch of texts at a time.

A gram of up to three code points is one 63-bit number: 21 bits a code point, the
first one highest, each raised by one so that a shorter gram ends in zeros.  Numbers
sort as the texts do.  Grams are cut by shifting an array of code points, counted by
sorting a text's numbers, shuffled and joined as numbers, and become text at the end.
Spark deals out the texts and adds up the counts; this runs inside its tasks.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 21
#: Code points of one number; longer grams are scrambled hashes of their code points.
PACKED = 3
#: Code points whose grams are held at a time; a longer text is counted piece by piece.
PIECE = 1 << 19
#: Rows of one outgoing batch.
OUT_ROWS = 200_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def pack(points: np.ndarray, size: int, starts: int) -> np.ndarray:
    """Numbers of the grams of ``size`` code points that begin at the first ``starts`` places."""
    raised = points + 1
    out = raised[:starts] << (BITS * (PACKED - 1))
    for i in range(1, min(size, PACKED)):
        out |= raised[i : i + starts] << (BITS * (PACKED - 1 - i))
    for i in range(PACKED, size):
        mixed = (out.view(np.uint64) ^ (out.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out = (mixed + raised[i : i + starts].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
    return out


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs."""
    if not len(numbers):
        return numbers, numbers
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return numbers[first], np.diff(first, append=len(numbers))


def added(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers become one, with the sum of their counts."""
    if not len(numbers):
        return numbers, counts
    order = np.argsort(numbers, kind="stable")
    numbers, counts = numbers[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return numbers[first], np.add.reduceat(counts, first, axis=0)


def histogram(text: str | None, shortest: int, longest: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a text and their counts; pieces overlap by what a gram needs of the next one."""
    points = code_points(text or "")
    parts = []
    for begin in range(0, len(points), piece):
        here = points[begin : begin + piece + longest - 1]
        starts = [max(0, min(piece, len(here) - size + 1)) for size in range(shortest, longest + 1)]
        grams = [pack(here, size, n) for size, n in zip(range(shortest, longest + 1), starts) if n]
        if grams:
            parts.append(counted(np.concatenate(grams)))
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return added(*(np.concatenate(x) for x in zip(*parts)))


def texts_of(numbers: np.ndarray) -> pa.Array:
    """The grams behind numbers of up to three code points."""
    points = np.stack([(numbers >> (BITS * (PACKED - 1 - i))) & ((1 << BITS) - 1) for i in range(PACKED)], axis=1)
    sizes = (points > 0).sum(axis=1)
    flat = (points[points > 0] - 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(sizes).tolist()
    return pa.array([flat[a:b] for a, b in zip([0, *ends], ends)], pa.string())


def number_of(gram: str) -> int:
    points = code_points(gram)
    return int(pack(points, len(points), 1)[0])


def text_of(number: Column) -> Column:
    """The gram behind a number, as an expression: for results of bounded size."""
    point = lambda i: F.shiftright(number, BITS * (PACKED - 1 - i)).bitwiseAND((1 << BITS) - 1) - 1
    letter = lambda p: F.when(p < 0, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    return F.concat(*(letter(point(i)) for i in range(PACKED)))


def _rows(batches: Iterator[pa.RecordBatch], shortest: int, longest: int) -> Iterator[tuple[pa.Array, list, list, list]]:
    """Keys, and per text its grams and counts, for a bounded number of grams at a time."""
    for batch in batches:
        start, held, grams, counts = 0, 0, [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            g, n = histogram(text, shortest, longest)
            grams.append(g)
            counts.append(n)
            held += len(g)
            if held >= OUT_ROWS:
                yield batch.column(0).slice(start, row + 1 - start), grams, counts
                start, held, grams, counts = row + 1, 0, [], []
        if grams:
            yield batch.column(0).slice(start), grams, counts


def spelled(batches: Iterator[pa.RecordBatch], shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, gram, tf); every distinct gram of a batch is spelled once."""
    for keys, grams, counts in _rows(batches, shortest, longest):
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
        out = [keys.take(pa.array(owner)), texts_of(distinct).take(pa.array(place)), pa.array(np.concatenate(counts), pa.int32())]
        yield from pa.Table.from_arrays(out, names=["key", "gram", "tf"]).to_batches(OUT_ROWS)


def sums(batches: Iterator[pa.RecordBatch], shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(key, text) to (number, tf, df), added up over the texts of a batch."""
    for _, grams, counts in _rows(batches, shortest, longest):
        both = np.stack([np.concatenate(counts), np.ones(sum(map(len, grams)), np.int64)], axis=1)
        numbers, total = added(np.concatenate(grams), both)
        yield pa.record_batch([pa.array(numbers), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["number", "tf", "df"])


class Terms:
    """Vocabulary of packed grams with their weights, looked up by binary search."""

    def __init__(self, terms: list[str], idf: list[float], shortest: int, longest: int):
        numbers = np.array([number_of(t) for t in terms], np.int64)
        self.order = np.argsort(numbers)
        self.numbers, self.idf = numbers[self.order], np.array(idf, np.float64)[self.order]
        self.shortest, self.longest = shortest, longest

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted vocabulary and L2-normalised weights of a text."""
        if not len(self.numbers):
            return np.empty(0, np.int64), np.empty(0)
        numbers, counts = histogram(text, self.shortest, self.longest)
        at = np.searchsorted(self.numbers, numbers)
        known = self.numbers[np.minimum(at, len(self.numbers) - 1)] == numbers
        at = at[known]
        raw = counts[known] * self.idf[at]
        return at, raw / np.sqrt((raw * raw).sum()) if len(raw) else raw


def weighed(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, gram, weight); the norm is taken inside the row."""
    spelled_terms = texts_of(terms.numbers)
    for batch in batches:
        start, held, places, weights = 0, 0, [], []

        def told(end):
            owner = np.repeat(np.arange(start, end), [len(p) for p in places])
            out = [batch.column(0).take(pa.array(owner)), spelled_terms.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(weights))]
            return pa.Table.from_arrays(out, names=["key", "gram", "weight"]).to_batches(OUT_ROWS)

        for row, text in enumerate(batch.column(1).to_pylist()):
            at, weight = terms.weights(text)
            places.append(at)
            weights.append(weight)
            held += len(at)
            if held >= OUT_ROWS:
                yield from told(row + 1)
                start, held, places, weights = row + 1, 0, [], []
        if places:
            yield from told(batch.num_rows)


def patterns(shortest: int, longest: int):
    """A column function of squeezed texts: their distinct grams as numbers."""

    def distinct(texts: pa.Array) -> pa.Array:
        found = [histogram(t, shortest, longest)[0] for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))

    return F.arrow_udf(distinct, "array<bigint>")


def keyed(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(F.col(key).alias("key"), text.alias("text"))


def out_schema(df: DataFrame, key: str, rest: str) -> T.StructType:
    told = T.StructType.fromDDL(rest)
    return T.StructType([T.StructField("key", df.schema[key].dataType), *told.fields])
