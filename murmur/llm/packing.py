"""Packing: sum-of-squares online placement of tokenised documents into windows.

Every document is tokenised whole and ends with one separator id. Its full
windows are cut off the front; what remains is an item that is placed whole into
the open window whose fill level minimises the sum of the squared counts of open
windows by level (or into a new one). Counts are kept in an array by level, so
one placement costs one vector operation over at most ``window`` levels.

A task packs the rows of its own input split while it tokenises them; no ids are
shuffled and no window is shared between tasks. When a split ends, or when more
than ``max_open`` windows are open (which bounds memory), the open windows are
cut again: their pieces are laid end to end into full windows, and the last rest
into windows whose lengths are powers of two. So nothing is padded.

Null text counts as empty: one piece with the separator alone. Repeated rows are
packed once per row. An empty table gives no piece.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, documents, small_batches

WINDOW = 2048
SEPARATOR = 1
MAX_OPEN = 1024
#: Words whose ids a worker remembers.
REMEMBERED = 300_000
SPECIAL = "<|endoftext|>"
#: Marks that may end a word, and the end of the letters looked up without the pattern.
MARKS = tuple(".,;:!?")
LAST_LETTER = "\u0250"

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
PIECES_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class _Words(dict):
    """Ids (little-endian uint32 bytes) of a word, with a blank before it or none.

    A run of letters is one piece of the vocabulary's pattern and one final mark
    is another, so both are looked up alone; anything else goes through the pattern.
    """

    def __init__(self, plain, lead: str):
        super().__init__()
        self.pattern, self.piece, self.lead = plain.encode_ordinary, plain._core_bpe.encode_single_piece, lead
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha() and (word.isascii() or max(word) < LAST_LETTER):
                ids = array("I", self.piece((self.lead + word).encode())).tobytes()
            elif word[-1:] in MARKS and word[:-1].isalpha() and max(word) < LAST_LETTER:
                ids = self[word[:-1]] + array("I", self.pattern(word[-1])).tobytes()
            else:
                ids = array("I", self.pattern(self.lead + word)).tobytes()
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                # words in use move on from the older half, the others are forgotten
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of a byte-level BPE vocabulary, the same as the tokenizer file's.

    Words between single blanks and line ends are independent of each other in
    this vocabulary's pattern, so their ids are remembered. Texts with other
    white space are encoded in one piece, and texts with the special token's
    string go through the tokenizer itself.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.first, self.later = _Words(self.plain, ""), _Words(self.plain, " ")
        self.line_end = array("I", self.plain.encode_ordinary("\n")).tobytes()
        self.whole = None

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.vocabulary)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:
            # white space beside white space, at an end, or of another kind
            return np.array(self.plain.encode_ordinary(text), dtype="<u4")
        lines, later = [], self.later.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(self.first[head] + b"".join(map(later, rest)))
        return np.frombuffer(self.line_end.join(lines), dtype="<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = (vocabulary, ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Packer:
    """Windows of one task. ``rows`` collects finished pieces until they are taken."""

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.next_sequence = first_sequence
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.rows: dict[str, list[int]] = {f.name: [] for f in PIECES}

    def _emit(self, sequence: int, offset: int, piece) -> None:
        doc_id, start, ids, total = piece
        for name, value in zip(
            self.rows,
            (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset),
            strict=True,
        ):
            self.rows[name].append(value)

    def _close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self._emit(self.next_sequence, offset, piece)
            offset += len(piece[2])
        self.next_sequence += 1

    def level_for(self, size: int) -> int:
        """Fill level to place an item of ``size`` at; 0 opens a window."""
        last = self.window - size
        counts = self.counts
        # moving a window from level h to h + size changes the sum of squares by this much;
        # full windows leave the sum, so the top level counts as empty
        before = counts[: last + 1]
        after = counts[size : self.window + 1].copy()
        after[-1] = 0
        change = 2 * (after - before) + 2
        change[-1] = 1 - 2 * before[-1]
        change[0] = 2 * after[0] + 1 if last else 0
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        # ties go to the fullest window
        return last - int(np.argmin(change[::-1]))

    def place(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._close([(doc_id, start, ids[start : start + self.window], total)])
            start += self.window
        if start == total:
            return
        size = total - start
        piece = (doc_id, start, ids[start:].copy(), total)
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self._close(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.flush()

    def flush(self) -> None:
        """Cut the open windows again into full ones and powers of two."""
        flat = [p for level in sorted(self.open) for pieces in self.open[level] for p in pieces]
        rest = sum(len(p[2]) for p in flat)
        at = used = 0
        while rest:
            room = want = self.window if rest >= self.window else 1 << (rest.bit_length() - 1)
            pieces = []
            while room:
                doc_id, start, ids, total = flat[at]
                take = ids[used : used + room]
                pieces.append((doc_id, start + used, take, total))
                room -= len(take)
                used += len(take)
                if used == len(ids):
                    at, used = at + 1, 0
            self._close(pieces)
            rest -= want
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0

    def take(self) -> pa.RecordBatch:
        out = batch(PIECES, self.rows)
        self.rows = {f.name: [] for f in PIECES}
        return out


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    separator: int = SEPARATOR,
    max_open: int = MAX_OPEN,
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """One row per piece; see the module's text. Sequence ids are unique, not dense."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary, ranks), None
        end = np.array([separator], dtype="<u4")
        for rows in batches:
            if not rows.num_rows:
                continue
            if packer is None:
                packer = Packer(rows.column(2)[0].as_py() << 36, window, max_open)
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                packer.place(doc_id, np.concatenate([encode(text), end]))
            yield packer.take()
        if packer is not None:
            packer.flush()
            yield packer.take()

    return (
        documents(docs)
        .withColumn("part", F.spark_partition_id().cast("long"))
        .mapInArrow(run, PIECES_DDL)
    )
