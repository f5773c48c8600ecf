"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are marked (a space becomes U+2581, one more goes in front) and parted into words. The
distinct new words of a batch are sorted, which lays them out as a trie in depth-first
order, and the forward table of a word is kept up to the prefix it shares with the next.

What the forward table holds depends on the model. For a unigram model it is the best
score of each prefix. For a BPE model summed scores would not give the model's own ids;
there it is the last piece of each prefix's encoding, which is the one piece that may follow
what precedes it: a pair may stand together exactly if encoding the two texts joined gives it back.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text, slices, tidy

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
ROWS = 1024
MOST_WORDS = 1_200_000
MOST_PAIRS = 1_000_000
UNKNOWN_SCORE = -1e6


class PieceModel:
    """Pieces of a SentencePiece model file with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str = MODEL, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = [model.get_score(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.kind = kind
        self.longest = max(map(len, self.ids))
        characters = set().union(*self.ids)
        alone = "".join(c for c in "\n\t\r" if c not in characters)  # only byte pieces hold these, so words may end at them
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.parts = re.compile(".+" if inner else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        raw = [p.replace(SPACE, " ").encode() if i in set(plain) else b"" for i, p in enumerate(self.pieces)]
        for byte, i in self.byte_ids.items():
            raw[i] = bytes([byte])
        self.raw = raw
        self.width, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words not met since the newer half began
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by definition: the adjacent pair whose join scores highest merges, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: str, right: str, key: int) -> bool:
        """Whether the pieces stand side by side once their joined text is encoded; left is empty for a word's first piece."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def forward(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, its ids) of sorted words; a single character c that is no piece has the id -1 - ord(c)."""
        ids, scores, longest, by_score, pairs = self.ids, self.scores, self.longest, self.kind != "bpe", self.pairs
        before, starts, lasts, best = "", [0], [0], [0.0]
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del starts[shared + 1 :], lasts[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found, last, total = -1, 0, 0.0
                for start in range(end - longest if end > longest else 0, end):
                    i = ids.get(word[start:end])
                    if i is None:
                        if start < end - 1:
                            continue
                        i = -1 - ord(word[start])
                    if by_score:
                        score = best[start] + (UNKNOWN_SCORE if i < 0 else scores[i])
                        if found < 0 or score > total:
                            found, last, total = start, i, score
                        continue
                    key = (lasts[start] << 32) + i if start else (1 << 62) + i
                    follows = pairs.get(key)
                    if follows is None:
                        follows = self.may_follow(word[starts[start] : start], word[start:end], key)
                    if follows:
                        found, last = start, i
                        break
                starts.append(found)
                lasts.append(last)
                best.append(total)
            pieces, end = [], len(word)
            while end:
                pieces.append(lasts[end])
                end = starts[end]
            pieces.reverse()
            yield word, pieces
            before = word

    def learn(self, words: set[str]) -> None:
        new = words - self.words.keys()
        if len(self.words) + len(new) > MOST_WORDS // 2:
            self.older, self.words = self.words, {}
            new = words
        again = new & self.older.keys()
        self.words.update((word, self.older[word]) for word in again)
        new = sorted(new - again)
        for word, pieces in self.forward(new):
            if min(pieces) < 0:
                pieces = [x for i in pieces for x in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")])]
            self.words[word] = struct.pack(f"<{len(pieces)}{self.code}", *pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [self.parts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*marked))
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), self.width) for words in marked]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[tuple[str, str], PieceModel] = {}


def load(path: str = MODEL, kind: str = "bpe") -> PieceModel:
    if (path, kind) not in _models:
        _models[path, kind] = PieceModel(path, kind)
    return _models[path, kind]


def encode(docs: DataFrame, path: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, ids (array<int>) of each row of docs; an empty or null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, kind)
        for ids, texts in slices(batches, ROWS):
            yield pa.RecordBatch.from_arrays([ids, pa.array([e.astype(np.int32) for e in model.encode(texts)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, kind)
        for batch in batches:
            texts = [model.decode(np.asarray(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def encoding_digest(docs: DataFrame, path: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip: whether decoding gives the text back.

    A text that holds U+2581 itself comes back with spaces there, as from the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, kind)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.byte_ids.values())] = True
        for ids, texts in slices(batches, ROWS):
            rows = [(len(e), int(is_byte[e].sum()), zlib.crc32(e.astype("<u4")), model.decode(e) == t) for e, t in zip(model.encode(texts), texts, strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 3, pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")


def q_spiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(documents(spark, sf_dir))
