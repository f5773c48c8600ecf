"""Words of texts in blocks of bounded size, for operators that work on arrays of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of UTF-8 bytes whose A-Z are lower-cased: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` and `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM = re.compile(rb"[a-z\x80-\xff]+")

PIECE_BYTES = 1 << 20
BLOCK_WORDS = 1 << 18


def utf8(text: Column) -> Column:
    """The bytes of a text; a null text counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def pieces(raw: bytes, word: re.Pattern, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """raw in pieces of about size bytes that end with a word's end; a word is never cut, however long."""
    at = 0
    while len(raw) - at > size:
        found = word.match(raw, at + size)
        end = found.end() if found else at + size
        yield raw[at:end]
        at = end
    yield raw[at:]


@dataclass(frozen=True)
class Block:
    """Words of consecutive segments of texts. A text is one segment, or several if it is long."""

    words: list[bytes]
    row: np.ndarray  # per segment: its text's row
    first: np.ndarray  # per segment: the number of its first word in its text
    begin: np.ndarray  # per segment, and one more: where its words begin in `words`
    carried: np.ndarray  # per segment: words at its front that end the segment before it

    @property
    def segment(self) -> np.ndarray:
        """Per word: its segment."""
        return np.repeat(np.arange(len(self.row)), np.diff(self.begin))


def blocks(texts: pa.Array, word: re.Pattern, carry: int = 0, limit: int = BLOCK_WORDS, size: int = PIECE_BYTES) -> Iterator[Block]:
    """The words of a column of UTF-8 bytes, A-Z lower-cased, some limit words at a time. Segments of one text overlap by carry words."""
    words: list[bytes] = []
    rows: list[tuple[int, int, int, int]] = []

    def block() -> Block:
        row, first, begin, carried = np.array(rows, np.int64).reshape(-1, 4).T
        return Block(words, row, first, np.append(begin, len(words)), carried)

    for at in range(0, len(texts), 256):
        for row, raw in enumerate(texts.slice(at, 256).to_pylist(), at):
            seen, tail = 0, []
            for piece in pieces(raw.lower(), word, size):
                found = word.findall(piece)
                rows.append((row, seen - len(tail), len(words), len(tail)))
                words += tail
                words += found
                seen += len(found)
                tail = (tail + found)[-carry:] if carry else []
                if len(words) >= limit:
                    yield block()
                    words, rows = [], []
    if rows:
        yield block()

