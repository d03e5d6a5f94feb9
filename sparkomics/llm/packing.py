"""Packing: vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

Each task fills one bin at a time from a pool of waiting examples.  Among the examples that fit, it takes the one whose
demand vector (tokens, segments, loss tokens; each as a share of its limit) has the largest dot product with what is
left in the bin (the bin-centric dot-product rule of Panigrahy et al. 2011).  Where examples may be cut, the last free
tokens of a bin take the head of the example with the largest product, so only bins that close on another limit, and the
last bin of a task, stay short; those are cut at powers of two, largest first, which need no padding.

No shuffle: a task packs the rows it reads, in the order it reads them, holding at most ``POOL`` examples of at most one
bin each.  ``sequence_id`` has the partition in its high bits.  A task that is run again reads the same rows and packs
them alike if its input is a scan of files; ``pack_documents`` is meant to stand above one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, claim, id_text, runs, utf8

POOL = 512


@dataclass(frozen=True)
class Limits:
    """Of one bin.  Every limit is at least 1."""

    tokens: int = 2048
    segments: int = 1024
    loss_tokens: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("each limit must be at least 1")


@dataclass
class Piece:
    key: int
    start: int
    length: int
    loss: int
    sequence: int
    offset: int


class VectorPacker:
    """Packs a stream of examples ``add(key, tokens, loss)``; loss-bearing tokens are an example's last ones.

    ``cut``: examples may be split anywhere.  Otherwise only examples over a limit are split, at the limit, and pieces
    of those keep to themselves.  Examples without tokens are ignored.
    """

    def __init__(self, limits: Limits, cut: bool, first_sequence: int = 0, pool: int = POOL) -> None:
        self.limits, self.cut, self.sequence, self.size = limits, cut, first_sequence, pool
        self.whole = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.tokens = np.zeros(pool, dtype=np.int64)  # 0: a free place
        self.loss, self.start, self.key = (np.zeros(pool, dtype=np.int64) for _ in range(3))
        self.free = list(range(pool - 1, -1, -1))

    def add(self, key: int, tokens: int, loss: int) -> Iterator[list[Piece]]:
        """Yields the sequences that are complete."""
        limits, at, loss_from = self.limits, 0, tokens - loss
        while True:
            n = min(limits.tokens, tokens - at)
            if n <= 0:
                return
            n = min(n, max(loss_from - at, 0) + limits.loss_tokens)
            bears = max(0, at + n - max(at, loss_from))
            if at + n < tokens and (n == limits.tokens or not self.cut):  # a bin of its own
                yield from self._close([Piece(key, at, n, bears, 0, 0)])
            else:
                if not self.free:
                    yield from self._fill()
                i = self.free.pop()
                self.tokens[i], self.loss[i], self.start[i], self.key[i] = n, bears, at, key
            at += n

    def end(self) -> Iterator[list[Piece]]:
        while len(self.free) < self.size:
            yield from self._fill()

    def _best(self, left: np.ndarray, whole_only: bool) -> int:
        able = self.tokens > 0
        if whole_only:
            able &= (self.tokens <= left[0]) & (self.loss <= left[2])
        if left[1] < 1 or not able.any():
            return -1
        score = self.tokens * (left[0] / self.whole[0] ** 2) + left[1] / self.whole[1] ** 2 + self.loss * (left[2] / self.whole[2] ** 2)
        return int(np.argmax(np.where(able, score, -1.0)))

    def _fill(self) -> Iterator[list[Piece]]:
        left, pieces = self.whole.copy(), []
        while left[0] >= 1:
            i = self._best(left, whole_only=True)
            if i >= 0:
                n, bears = int(self.tokens[i]), int(self.loss[i])
            elif self.cut and (i := self._best(left, whole_only=False)) >= 0:
                plain = int(self.tokens[i] - self.loss[i])
                n = min(int(self.tokens[i]), int(left[0]), plain + int(left[2]))
                bears = max(0, n - plain)
                if n < 1:
                    break
            else:
                break
            pieces.append(Piece(int(self.key[i]), int(self.start[i]), n, bears, 0, 0))
            self.tokens[i] -= n
            self.start[i] += n
            self.loss[i] -= bears
            left -= (n, 1, bears)
            if not self.tokens[i]:
                self.free.append(i)
        yield from self._close(pieces)

    def _close(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        total = sum(p.length for p in pieces)
        room = total if total == self.limits.tokens or not self.cut else 1 << (total.bit_length() - 1)
        out: list[Piece] = []
        used = 0
        while pieces:
            p = pieces.pop(0)
            n = min(p.length, room - used)
            plain = p.length - p.loss
            out.append(Piece(p.key, p.start, n, max(0, n - plain), self.sequence, used))
            used += n
            if n < p.length:
                pieces.insert(0, Piece(p.key, p.start + n, p.length - n, p.loss - out[-1].loss, 0, 0))
            if used == room:
                yield out
                self.sequence += 1
                total -= used
                out, used, room = [], 0, 1 << (total.bit_length() - 1) if total else 0


SCHEMA = "start long, length long, loss_tokens long, sequence_id long, offset long"


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str | None = None, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Pieces of sized examples: ``example_id, start, length, loss_tokens, sequence_id, offset``.

    For instruction data, one row is a conversation with its token count and the count of its loss-bearing tokens (its
    last ones; null or no column: all).  Null, zero and negative token counts give no piece; loss counts are held to
    0..tokens.  Repeated rows are separate examples.  Ties go to the place in the pool that was filled first.
    """
    sized = df.select(
        F.col(id_col).cast("long").alias("example_id"),
        F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"),
        (F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")).alias("loss"),
    ).select("example_id", "n", F.least(F.col("n"), F.greatest(F.coalesce("loss", "n"), F.lit(0))).alias("loss"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(limits, cut, TaskContext.get().partitionId() << 33)
        ids: dict[int, tuple[int | None, int]] = {}
        n = 0

        def rows(sequences: Iterator[list[Piece]]) -> list[tuple]:
            out = []
            for p in (p for s in sequences for p in s):
                which, rest = ids[p.key]
                out.append((which, p.start, p.length, p.loss, p.sequence, p.offset))
                ids[p.key] = (which, rest - p.length)
                if rest == p.length:
                    del ids[p.key]
            return out

        names = ["example_id", "start", "length", "loss_tokens", "sequence_id", "offset"]
        for batch in batches:
            found = []
            for i, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tokens:
                    ids[n] = (i, tokens)
                    found += rows(packer.add(n, tokens, loss))
                    n += 1
            yield _batch(found, names)
        yield _batch(rows(packer.end()), names)

    return sized.mapInArrow(pack, "example_id long, " + SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)


class Parts(WordTable):
    """A run of characters that the pre-tokenizer leaves whole -> its ids by the BPE model, as bytes."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}

    def make(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(self.byte[b] for b in part.encode())
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


class TokenIds(WordTable):
    """Token ids of whole texts by a tokenizer file, then ``end_id``, as unsigned little-endian 32-bit numbers.

    If the file's normaliser and pre-tokenizer are those of ``NORMALISER`` and ``SPLITTER``, text is cut at ASCII white
    space, which they drop, and the ids of each stretch are kept in a bounded table.  Stretches of printable ASCII and
    Latin-1 letters, on which they only lower-case, go straight to the BPE model; all others go through the whole
    tokenizer.  For any other file the whole tokenizer takes each whole text.
    """

    #: What the fast path stands for.
    NORMALISER = ["NFC", "Replace \\s+ by ' '", "Lowercase"]
    SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, end_id: int, words: int) -> None:
        from tokenizers import Tokenizer

        super().__init__(words)
        self.tokenizer, self.end = Tokenizer.from_file(path), array("I", [end_id]).tobytes()
        self.parts, self.fast = Parts(self.tokenizer.model), self.known(path)
        self.plain = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+").fullmatch  # without <, which begins the special tokens
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall

    def known(self, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("normalizer") or {}).get("normalizers") or []
        shown = [f"Replace {s['pattern'].get('Regex')} by {s['content']!r}" if s["type"] == "Replace" else s["type"] for s in steps]
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        levels = [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex", True)
        split = cuts[0].get("pattern", {}).get("Regex") == self.SPLITTER and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed"
        special = all(t["content"].startswith("<") for t in told.get("added_tokens") or [])
        return bool(shown == self.NORMALISER and levels and split and special and told["model"]["type"] == "BPE")

    def make(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone: one part
            return self.parts[word.decode().lower()]
        text = word.decode("utf-8", "replace")
        if self.plain(text):
            return b"".join(map(self.parts.__getitem__, self.cut(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: bytes) -> np.ndarray:
        if not self.fast:
            found = array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        else:
            found = b"".join(map(self.__getitem__, text.split()))
        return np.frombuffer(found + self.end, dtype="<u4")


#: Words of one generation of a worker's table; fewer cost time and save memory, results are the same.
MOST_WORDS = 300_000
_encoders: dict[tuple, TokenIds] = {}


def encoder(path: str, end_id: int, words: int = MOST_WORDS) -> TokenIds:
    """One for each Python worker, so that its table serves all tasks."""
    key = path, end_id, words
    if key not in _encoders:
        _encoders[key] = TokenIds(path, end_id, words)
    return _encoders[key]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, limits: Limits = Limits(), words: int = MOST_WORDS) -> DataFrame:
    """Tokenise whole texts and pack every id into exactly one piece.

    Returns per piece ``doc_id, start, length, ids (binary: unsigned little-endian 32-bit), doc_tokens, loss_tokens, sequence_id, offset``.  All
    ids of a document bear loss.  Null and empty texts are one id (``end_id``); null ids stay null; repeated rows are
    packed each; an empty table gives no piece.  Texts of any length are tokenised whole and cut at the limit.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id, words)
        claim(_encoders, encode, encode.parts)  # another operator frees the tokenizer too
        packer = VectorPacker(limits, True, TaskContext.get().partitionId() << 33)
        waiting: dict[int, list] = {}
        n = 0

        def rows(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            for p in (p for s in sequences for p in s):
                which, ids, rest = held = waiting[p.key]
                yield which, p.start, p.length, ids[p.start : p.start + p.length].tobytes(), len(ids), p.loss, p.sequence, p.offset
                held[2] = rest - p.length
                if not held[2]:
                    del waiting[p.key]

        for batch in batches:
            sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(1)).to_pylist()], dtype=np.int64)
            for a, b in runs(sizes + 64, 1 << 20):
                part, found = batch.slice(a, b - a), []
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    tokens = encode(text)
                    waiting[n] = [doc_id, tokens, len(tokens)]
                    found += rows(packer.add(n, len(tokens), len(tokens)))
                    n += 1
                yield _pieces(found)
        yield _pieces(list(rows(packer.end())))

    return id_text(docs, id_col, text_col).mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    arrays = [pa.array(c, type=pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
