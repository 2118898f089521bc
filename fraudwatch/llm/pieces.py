"""SentencePiece encoding and decoding by a streaming Viterbi pass.

For every end of a prefix the pass keeps one backpointer: the last piece of that
prefix's encoding.  A piece may end a prefix if it follows the last piece of the
prefix before it without the two merging otherwise, and exactly one piece can.
The window holds the backpointers of the last MAX_PIECE characters.  Whenever all
paths from the window lead through one boundary, the ids before it are final
and are given out, so a text of any length takes bounded memory.

The vocabulary's pieces carry scores, and its encoder merges the best-scored pair
first; the pass gives the same ids.
"""

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fraudwatch.llm.base import CACHE_WORDS, blocks, kept, shipped

shipped(__name__)

#: The character that stands for a space.
SPACE = "▁"
NONE: dict = {}
#: Runs whose ids a task remembers twice over (those met lately and those met before), and beginnings of runs: about 200 bytes each.
KNOWN_RUNS, KNOWN_BEGINNINGS = 400_000, 600_000


class Pieces:
    """A vocabulary: pieces by id with their scores, and single bytes for characters it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        plain = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = [model.id_to_piece(i) for i in range(count)]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.most = max(map(len, self.ids))
        # Where no piece has a space after another character, each space that follows one starts anew.
        self.spaces_first = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # When a piece is made: the best score is merged first.
        places = {score: place for place, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {piece: places[score] for piece, score in self.score.items() if len(piece) > 1}
        # What a piece can end with: no longer piece ends where the text so far does not.
        self.tails = {piece[i:] for piece in self.ids for i in range(len(piece))}
        self._follows: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._halves: dict[str, tuple[str, str] | None] = {}
        self.known = KnownRuns(self)
        # Whether a tail is a piece and its own encoding, as far as has been asked.
        self.stands: dict[str, bool] = {}
        # The last piece of a text's encoding, for texts that are the beginning of a run.
        self.last: dict[str, str] = {"": ""}

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes a piece of several characters, or none if other merges come first.

        The best-scored, then leftmost, neighbours are merged until none is left.
        """
        if piece in self._halves:
            return self._halves[piece]
        parts, last = list(piece), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                last = None
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self._halves[piece] = last
        return last

    def follows(self, left: str, right: str) -> bool:
        """Whether two pieces next to each other stay as they are.

        Their merges are undone, the latest first.  What then stands at the boundary
        would have merged across it if that merge comes before the ones undone; of two
        equal ranks the left one comes first.
        """
        first, second = left, right
        found = self._follows.get(left, NONE).get(right)
        if found is not None:
            return found
        rank, limit = self.rank, len(self.score) + 1
        while True:
            across = rank.get(left + right)
            if across is not None and across < limit:
                found = False
                break
            made, then = rank.get(left, -1) if len(left) > 1 else -1, rank.get(right, -1) if len(right) > 1 else -1
            if made > then:
                limit, left = made, self.halves(left)[1]
            elif then >= 0:
                limit, right = then + 1, self.halves(right)[0]
            else:
                found = True
                break
        self._pairs += 1
        if self._pairs >= CACHE_WORDS:
            self._follows.clear()
            self._pairs = 0
        self._follows.setdefault(first, {})[second] = found
        return found

    def whole(self, piece: str) -> bool:
        """Whether a piece is its own encoding."""
        return len(piece) < 2 or self.halves(piece) is not None


def stream(pieces: Pieces, chars: Iterable[str]) -> Iterator[str]:
    """Pieces of a stream of characters, each given out as soon as it is certain.

    ``ends[i]`` is where the last piece of the prefix of length i starts, and the
    piece.  The window keeps the ends that a later piece can still start from.
    """
    most, base, window = pieces.most, 0, ""  # ``base`` counts the characters before the window
    rank, tails = pieces.rank, pieces.tails
    last: list[tuple[int, str] | None] = [None]  # for each prefix that ends in the window: start and text of its last piece

    def settle(upto: int) -> list[str]:
        out, at = [], upto
        while at > 0:
            start, piece = last[at]
            out.append(piece)
            at = start
        return out[::-1]

    for char in chars:
        window += char
        n = len(window)
        found = None
        for start in range(n - 1, max(-1, n - 1 - most), -1):
            piece = window[start:]
            if start < n - 1:
                if piece not in tails:
                    break
                if piece not in rank or not pieces.whole(piece):
                    continue
            before = last[start]
            if before is None or pieces.follows(before[1], piece):
                found = (start, piece)  # one piece only can end a prefix
                break
        last.append(found)
        if n >= 2 * most and n % most == 0:
            # Paths from every end that a coming piece can start at; commit where they meet.
            alive = set(range(n - most + 1, n + 1))
            while len(alive) > 1:
                top = max(alive)
                alive.remove(top)
                alive.add(last[top][0])
            boundary = alive.pop()
            if boundary > 0:
                yield from settle(boundary)
                kept = last[boundary]
                window, base = window[boundary:], base + boundary
                last = [(e[0] - boundary, e[1]) if i else (0, kept[1]) for i, e in enumerate(last[boundary:])]
    yield from settle(len(window))


def of_run(pieces: Pieces, run: str) -> list[str]:
    """Pieces of a short run: the same pass, whose backpointers are shared by all runs that begin alike."""
    last, tails, stands, follows, known = pieces.last, pieces.tails, pieces.stands, pieces.follows, pieces._follows
    if len(last) >= KNOWN_BEGINNINGS:
        last.clear()
        last[""] = ""
    for n in range(1, len(run) + 1):
        upto = run[:n]
        if upto in last:
            continue
        for start in range(n - 1, -1, -1):
            piece = run[start:n]
            if start < n - 1:
                if piece not in tails:
                    break
                own = stands.get(piece)
                if own is None:
                    own = stands[piece] = piece in pieces.rank and pieces.whole(piece)
                if not own:
                    continue
            before = last[run[:start]]
            fits = not before or known.get(before, NONE).get(piece)
            if fits or (fits is None and follows(before, piece)):
                last[upto] = piece  # one piece only can end a prefix
                break
    out, at = [], len(run)
    while at:
        out.append(last[run[:at]])
        at -= len(out[-1])
    return out[::-1]


class KnownRuns(dict):
    """Ids of runs, made when first asked for.  Those met since the last change of halves outlive the next one."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.older = pieces, {}

    def __missing__(self, run: str) -> bytes:
        found = self.older.get(run)
        if found is None:
            pieces = self.pieces
            parts = of_run(pieces, run) if len(run) < 2 * pieces.most else stream(pieces, run)
            found = array("I", ids_of(pieces, parts)).tobytes()
        if len(run) <= 64:
            if len(self) >= KNOWN_RUNS:
                self.older = dict(self)
                self.clear()
            self[run] = found
        return found


def ids_of(pieces: Pieces, parts: Iterable[str]) -> list[int]:
    """Ids of pieces; a character without a piece becomes its bytes."""
    out = []
    for part in parts:
        found = pieces.ids.get(part)
        if found is not None:
            out.append(found)
        else:
            out.extend(pieces.bytes[b] for b in part.encode())
    return out


def encode(pieces: Pieces, text: str) -> bytes:
    """Ids of a text as little-endian 32-bit integers.

    A space is put in front.  Runs that start with spaces and end before the next
    one are streamed on their own where no piece crosses that boundary, and
    remembered.  In a run shorter than the window nothing has to be given out early;
    longer ones commit where their paths converge.
    """
    if not text:
        return b""
    marked = SPACE + text.replace(" ", SPACE)
    if not pieces.spaces_first:
        return np.array(ids_of(pieces, stream(pieces, marked)), "<u4").tobytes()
    return b"".join(map(pieces.known.__getitem__, _runs(marked)))


def _runs(marked: str) -> Iterable[str]:
    """Cut before every first space of a row of spaces."""
    if SPACE + SPACE not in marked and marked[-1] != SPACE:
        return [SPACE + word for word in marked.split(SPACE)[1:]]
    return _spaced_runs(marked)


def _spaced_runs(marked: str) -> Iterator[str]:
    spaces = ""
    for word in marked.split(SPACE)[1:]:
        spaces += SPACE
        if word:
            yield spaces + word
            spaces = ""
    if spaces:
        yield spaces


def decode(pieces: Pieces, ids: Iterable[int]) -> str:
    """The text of ids: bytes are joined to characters, broken ones become U+FFFD, the space in front goes."""
    out = bytearray()
    for i in ids:
        out += bytes([pieces.byte_of[i]]) if i in pieces.byte_of else pieces.text[i].replace(SPACE, " ").encode()
    text = out.decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (binary, little-endian 32-bit) of every row.

    Null or empty text has no ids.  Null doc_id stays, repeated rows stay, other
    columns are not looked at.  ``model`` is the path of a vocabulary of the BPE
    kind with byte fallback, as every worker sees it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(("pieces", model), lambda: Pieces(model))
        for batch in blocks(batches, "text"):
            ids = [encode(pieces, text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, ids binary")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(("pieces", model), lambda: Pieces(model))
        for batch in batches:
            texts = [decode(pieces, np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, number of ids, their CRC-32, and whether decoding gives the text back.

    A text that itself holds the character that stands for a space does not come
    back as it was: decoding gives spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(("pieces", model), lambda: Pieces(model))
        for batch in blocks(batches, "text"):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            ids = [encode(pieces, text) for text in texts]
            same = [decode(pieces, np.frombuffer(i, "<u4").tolist()) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_ids", "ids_crc32", "same"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, same boolean")
