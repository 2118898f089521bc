"""Runs of repeated words: maximal stretches in which words a period apart are identical.

Longest common extensions come from a difference cover: of the suffixes only those
at cover positions are sorted, and neighbours in that order carry their common
length.  To compare two positions, a few words are compared until both reach
sampled positions, then a sparse table of minima answers.  A harmonic grid drives
the search: for each period p the positions 0, p, 2p, ...; a run of three periods
holds three neighbouring grid points, and the extensions to both sides of one pair
give its ends.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fraudwatch.llm.base import blocks, kept, shipped

shipped(__name__)

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Positions are sampled modulo the square of this; the cover has 2 * STEP - 1 residues.
STEP = 8
MODULUS = STEP * STEP
#: Grid pairs that are looked at together.
PAIRS = 1 << 20
#: Rows of words that are compared at once.
AT_ONCE = 1 << 13
#: Words that must agree at a pair before extensions are asked for.
QUICK = 16
#: Texts up to so many words share one list of grid pairs.
SHARED_WORDS = 1 << 14


def cover() -> tuple[np.ndarray, np.ndarray]:
    """Which residues are sampled, and for two residues how far both are from sampled positions.

    The first STEP residues and all multiples of STEP have every difference modulo MODULUS.
    """
    sampled = np.zeros(MODULUS, bool)
    sampled[:STEP] = sampled[::STEP] = True
    shift = np.zeros((MODULUS, MODULUS), np.int64)
    both = lambda d: np.outer(np.roll(sampled, -d), np.roll(sampled, -d))
    for d in reversed(range(MODULUS)):
        shift[both(d)] = d
    return sampled, shift


class Extensions:
    """Longest common extensions of a sequence of positive numbers."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        # Zeros after the end, different from every word.
        self.words = np.concatenate([words, np.zeros(MODULUS, np.int32)])
        self.sampled, self.shift = kept(("cover", STEP), cover)
        self._sort(np.flatnonzero(self.sampled[np.arange(n) % MODULUS]))

    def _sort(self, at: np.ndarray) -> None:
        """Order the sampled suffixes: by their first MODULUS words, then by doubling along their residue."""
        n, place = self.n, np.full(self.n, -1, np.int64)
        place[at] = np.arange(len(at))
        self.place = place
        heads = self.words[at[:, None] + np.arange(MODULUS)].astype(">u4")
        heads = np.ascontiguousarray(heads).view(np.dtype((np.void, 4 * MODULUS))).ravel()
        rank = np.unique(heads, return_inverse=True)[1].astype(np.int64) + 1
        ranks, reach = [rank], MODULUS
        after = lambda r, far: np.where(at + far < n, r[place[np.minimum(at + far, n - 1)]], 0)
        while reach < n and rank.max(initial=0) < len(at):
            pair = rank * (len(at) + 2) + after(rank, reach)
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
            ranks.append(rank)
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        # Common lengths of neighbours: whole doubled blocks first, then word by word within the last block.
        left, right = at[order[:-1]].copy(), at[order[1:]].copy()
        length = np.zeros(len(left), np.int64)
        for level in reversed(range(len(ranks))):
            block = MODULUS << level
            inside = (left < n) & (right < n)
            same = inside.copy()
            same[inside] = ranks[level][place[left[inside]]] == ranks[level][place[right[inside]]]
            length[same] += block
            left[same] += block
            right[same] += block
        length += self._direct(np.minimum(left, n), np.minimum(right, n), np.full(len(left), MODULUS))
        self.table = [length]
        width = 1
        while 2 * width <= len(length):
            below = self.table[-1]
            self.table.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words in common from a and b, at most ``most`` of MODULUS and never past the end."""
        found = np.empty(len(a), np.int64)
        for start in range(0, len(a), AT_ONCE):
            x, y, m = (v[start : start + AT_ONCE] for v in (a, b, most))
            span = np.arange(max(1, int(m.max(initial=0))))
            differ = self.words[x[:, None] + span] != self.words[y[:, None] + span]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), len(span))
            found[start : start + AT_ONCE] = np.minimum(np.minimum(first, m), self.n - np.maximum(x, y))
        return found

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, a < b."""
        few = self.shift[a % MODULUS, b % MODULUS]
        found = self._direct(a, b, few)
        far = np.flatnonzero((found == few) & (b + few < self.n))
        if len(far):
            x, y = self.rank[self.place[a[far] + few[far]]], self.rank[self.place[b[far] + few[far]]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                here, row = level == k, self.table[k]
                least[here] = np.minimum(row[low[here]], row[high[here] - (1 << k)])
            found[far] += least
        return np.minimum(found, self.n - b)


def _shared_pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points i and periods p by ascending i + 2p; and how many have i + 2p below each number."""
    limit = SHARED_WORDS
    i, p = _pairs(1, limit // 2 + 1, limit)
    order = np.argsort(i + 2 * p, kind="stable")
    i, p = i[order].astype(np.int32), p[order].astype(np.int32)
    return i, p, np.searchsorted(i + 2 * p, np.arange(limit + 1))


def _pairs(first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points i = k * p of the periods first..last-1 with i + 2p below n."""
    periods = np.arange(first, last, dtype=np.int64)
    counts = np.maximum((n - 1) // periods - 1, 0)
    p = np.repeat(periods, counts)
    k = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
    return k * p, p


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grid points and periods of a text of n words, a bounded number at a time."""
    if n <= SHARED_WORDS:
        i, p, below = kept(("grid", SHARED_WORDS), _shared_pairs)
        yield i[: below[n]], p[: below[n]]
        return
    first = 1
    while first <= n // MIN_PERIODS:
        last = first + max(1, PAIRS * first // n)
        yield _pairs(first, min(last, n // MIN_PERIODS + 1), n)
        first = last


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length and period of every run, by start and then period; words are positive numbers."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    ahead = behind = None
    found: dict[tuple[int, int], int] = {}
    for i, p in _grid(n):
        # A run's first grid point i has i + p and i + 2p in the run too, and at least so many equal words.
        at = np.flatnonzero(words[i] == words[i + p])
        i, p = i[at], p[at]
        at = np.flatnonzero((words[i + p] == words[i + 2 * p]) & (3 * p <= n))
        i, p = i[at].astype(np.int64), p[at].astype(np.int64)
        equal = np.maximum(MIN_WORDS, MIN_PERIODS * p) - 2 * p
        for step in range(1, QUICK):
            if not len(i):
                break
            at = np.flatnonzero((step > equal) | (words[np.minimum(i + step, n - 1)] == words[np.minimum(i + p + step, n - 1)]))
            i, p, equal = i[at], p[at], equal[at]
        if not len(i):
            continue
        if ahead is None:
            ahead, behind = Extensions(words), Extensions(words[::-1].copy())
        end = i + p + ahead.common(i, i + p)
        # The words before i and i + p, read backwards; at 0 there are none.
        start = i.copy()
        inner = np.flatnonzero(i > 0)
        start[inner] -= behind.common(n - i[inner] - p[inner], n - i[inner])
        long = end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * p)
        for s, e, q in np.unique(np.stack([start[long], end[long], p[long]], 1), axis=0).tolist():
            # A stretch met with several periods has the smallest of them.
            found[s, e] = min(found.get((s, e), q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 1."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int32, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains beyond its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _detect(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, column):
        runs, texts = [], []
        for text in batch.column(column).to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").split()
            found = find_runs(numbered(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            texts.append(collapsed(words, found).decode("utf-8", "replace"))
        rest = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.record_batch([*rest, pa.array(runs, _RUNS), pa.array(texts, pa.string())], names=[*batch.schema.names, "runs", "collapsed"])


def detect(docs: DataFrame, column: str = "text") -> DataFrame:
    """The rows with ``runs`` (start, length and period in words, by start and then period) and ``collapsed``.

    Words are maximal stretches without ASCII white space, whole texts are read.  A run
    is a stretch of at least MIN_WORDS words and MIN_PERIODS of its smallest period
    that no neighbouring word extends.  The collapsed text keeps the words that lie in
    no run or within the first period of every run around them, joined by one space.
    Null, empty and blank texts have no run and an empty collapsed text.  Rows are
    looked at one by one: repeated rows and rows without an id stay, and the result is
    the same whatever other rows there are; an empty table gives none.  Own columns
    named ``runs`` or ``collapsed`` are replaced.
    """
    told = docs.drop("runs", "collapsed")
    schema = T.StructType([*told.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return told.mapInArrow(lambda batches: _detect(batches, column), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared as fractions; of equal ones the first. Null without runs."""
    better = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))


def looped(text: Column, doc_id: Column) -> Column:
    """A repetitive test text: of each id whose checksum ends in 0, the words from some place on repeat a first part."""
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(whole, r"[\x20\x09-\x0D]+")
    n = F.size(words)
    h = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.array_join(F.slice(words, a + 1, p), " ")
    # Whole copies of the part, then what is left of one more.
    copies = F.floor((n - a) / p).cast("int")
    rest = F.slice(words, a + 1, (n - a) - copies * p)
    parts = F.concat(F.slice(words, F.lit(1), a), F.array_repeat(again, copies), rest)
    return F.when((h % 10 == 0) & (whole != ""), F.array_join(parts, " ")).otherwise(text)
