"""Encoding and decoding with a sentence-piece BPE model (operator 12).

All new words of a batch lie one behind the other in one flat numpy array of symbols.
Every round finds the least pair rank of each word (a segmented minimum), merges the
leftmost pairs of that rank in all words at once, compacts the arrays and looks up only
the pairs that changed; words without a pair leave. So the number of numpy calls follows
the merges of the longest word, not the number of words.

What may merge in one round, so that the result is that of merging one pair at a time:

* A rank whose new symbol takes part in no pair of the same or a lower rank: all its
  pairs, in runs of overlapping pairs every second one from the left.
* Any other rank: the leftmost pair of the word, and those pairs that lie further from the
  pair of this rank before them than two of the longest pieces reach. What a merge
  makes possible at a lower rank always contains the new symbol, so it ends there.
* Several pieces of one score (runs of blanks) with nothing lower behind them: the
  word's pairs of that rank from left to right, as a stack.

Words: blanks start a word if no piece has a blank behind another character. Inside a word
the array is also cut wherever two neighbouring characters are neighbours in no piece, since
no merge crosses such a place; a long text without blanks is no special case.

Each distinct word of up to ``MEMO_WORD`` characters is merged once and remembered; the
memory is bounded in bytes and emptied when a task ends.

The model file is the protocol-buffer file of a BPE model with byte fallback and identity
normalisation; others raise ``ValueError``. Its path is a parameter, read in each worker.

Defined cases: null and empty texts have no ids and decode to the empty text; a blank
(U+0020) and U+2581 are the same character, as in the library; a column of the input that
has the name of an output column is replaced; rows and other columns are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, text_or_empty
from .keytable import KeyTable

NONE = np.int32(2**31 - 1)
BLANK = "▁"
MEMO_WORD = 64
MEMO_BYTES = 64 << 20
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at:at + size]
        at += size


def read_model(raw: bytes) -> tuple[list[tuple[str, float, int]], dict[int, object], dict[int, object]]:
    """Pieces (text, score, kind), trainer fields and normaliser fields of a model file."""
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
            pieces.append((f.get(1, b"").decode("utf-8"), score, f.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    return pieces, trainer, normal


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, raw: bytes):
        pieces, trainer, normal = read_model(raw)
        kinds = {kind for _, _, kind in pieces}
        if (trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1)
                or trainer.get(24) or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.prefix = bool(normal.get(3, 1))
        texts = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.longest = max(map(len, texts))
        self._symbols(pieces, texts)
        self._pairs(pieces, texts)
        self._decoder(pieces, trainer)
        inside = any(BLANK in text.lstrip(BLANK) for text in texts)
        self.words = re.compile("(?s).+" if inside else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _symbols(self, pieces, texts) -> None:
        """The symbol of each character: its piece, a number above all pieces, or minus one."""
        self.char = np.full(0x110000, -1, np.int32)
        names = list(range(len(pieces)))
        for c in sorted({c for text in texts for c in text}):
            if c in texts:
                self.char[ord(c)] = texts[c]
            else:  # only a part of longer pieces
                self.char[ord(c)] = len(names)
                names.append(c)
        self.spare = {c: len(pieces) + i for i, c in enumerate(names[len(pieces):])}
        self.size = len(names)
        self.bytes_from = np.full(256, -1, np.int64)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.bytes_from[int(text[3:5], 16)] = i

    def _pairs(self, pieces, texts) -> None:
        """Sorted pair keys with rank and new symbol; per rank, how it may be merged."""
        scores = sorted({pieces[i][1] for text, i in texts.items() if len(text) > 1}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        symbol = self.spare | texts
        keys, ranks, made, near = [], [], [], set()
        for text, i in texts.items():
            near.update(zip(text, text[1:], strict=False))
            for k in range(1, len(text)):
                a, b = symbol.get(text[:k]), symbol.get(text[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank_of[pieces[i][1]])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.made = np.array(made, np.int32)[order]
        at = self.char
        self.near = KeyTable(np.sort(np.array([int(at[ord(a)]) << 32 | int(at[ord(b)]) for a, b in near], np.int64)))
        self.pairs = KeyTable(self.keys)
        # the least rank of a pair in which a symbol takes part, against the rank that makes it
        least = np.full(self.size, NONE, np.int32)
        np.minimum.at(least, (self.keys >> 32).astype(np.int64), self.ranks)
        np.minimum.at(least, (self.keys & 0xFFFFFFFF).astype(np.int64), self.ranks)
        behind = np.full(len(scores) + 1, NONE, np.int32)
        np.minimum.at(behind, self.ranks, least[self.made])
        several = np.zeros(len(scores) + 1, bool)
        first = np.full(len(scores) + 1, -1, np.int64)
        for r, m in zip(self.ranks.tolist(), self.made.tolist(), strict=True):
            several[r] |= first[r] not in (-1, m)
            first[r] = m
        numbers = np.arange(len(scores) + 1)
        self.free = (behind > numbers) & ~several
        self.stacked = several & (behind >= numbers)

    def _decoder(self, pieces, trainer) -> None:
        unknown = trainer.get(44, " ⁇ ".encode())
        self.surface: list[bytes] = []
        self.kind = np.array([kind for _, _, kind in pieces])
        for text, _, kind in pieces:
            if kind == _BYTE:
                self.surface.append(bytes([int(text[3:5], 16)]))
            elif kind == _NORMAL:
                self.surface.append(text.replace(BLANK, " ").encode())
            else:
                self.surface.append(unknown if kind == _UNKNOWN else b"")

    # --- merging -------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and new symbol of each pair."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.pairs.find(key)
        known = at >= 0
        return np.where(known, self.ranks[at], NONE), np.where(known, self.made[at], -1)

    def _stack(self, symbols: list[int], rank: int) -> list[int]:
        """Merge the pairs of one rank from the left, each new symbol at once with what stands before it."""
        out: list[int] = []
        for s in symbols:
            out.append(s)
            while len(out) > 1:
                r, m = self._one(out[-2], out[-1])
                if r != rank:
                    break
                out[-2:] = [m]
        return out

    @lru_cache(maxsize=4096)  # noqa: B019 - codecs live as long as their worker
    def _one(self, left: int, right: int) -> tuple[int, int]:
        r, m = self._rank(np.array([left]), np.array([right]))
        return int(r[0]), int(m[0])

    def _choose(self, hits: np.ndarray, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of all pairs of their words' least rank, those that merge in this round."""
        gap = np.empty(len(hits), np.int64)
        gap[0] = 1 << 40
        gap[1:] = np.where(word[hits[1:]] == word[hits[:-1]], np.diff(hits), 1 << 40)
        run = np.maximum.accumulate(np.where(gap > 1, np.arange(len(hits)), 0))
        every_second = (np.arange(len(hits)) - run) % 2 == 0
        return hits[np.where(self.free[rank[hits]], every_second, gap > 2 * self.longest)]

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and the word of each, in order; ``word`` ascends."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, new = self._rank(symbols[:-1], symbols[1:])
        rank[word[1:] != word[:-1]] = NONE
        rank, new = np.append(rank, NONE), np.append(new, -1)
        while len(symbols):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(start, len(word)))
            low = np.minimum.reduceat(rank, start)
            stacked = (low < NONE) & self.stacked[np.minimum(low, len(self.stacked) - 1)]
            if stacked.any():
                symbols, word, rank, new = self._stack_words(symbols, word, start, size, low, stacked)
                continue
            ended = low == NONE
            if ended.any():
                out = np.repeat(ended, size)
                done.append((word[out], symbols[out]))
                left = ~out
                symbols, word, rank, new = symbols[left], word[left], rank[left], new[left]
                if not len(symbols):
                    break
                low, size = low[~ended], size[~ended]
            merge = self._choose(np.flatnonzero(rank == np.repeat(low, size)), word, rank)
            symbols[merge] = new[merge]
            keep = np.ones(len(symbols), bool)
            keep[merge + 1] = False
            place = (np.cumsum(keep) - 1)[merge]
            symbols, word, rank, new = symbols[keep], word[keep], rank[keep], new[keep]
            touched = np.zeros(len(symbols), bool)
            touched[place] = True
            touched[:-1] |= touched[1:]
            changed = np.flatnonzero(touched)
            last = changed[-1] == len(symbols) - 1
            inner = changed[:-1] if last else changed
            r, m = self._rank(symbols[inner], symbols[inner + 1])
            r[word[inner] != word[inner + 1]] = NONE
            rank[inner], new[inner] = r, m
            if last:
                rank[-1] = NONE
        if not done:
            return word, symbols
        words, out = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(words, kind="stable")
        return words[order], out[order]

    def _stack_words(self, symbols, word, start, size, low, stacked):
        parts, words = [], []
        for k in range(len(start)):
            own = symbols[start[k]:start[k] + size[k]]
            if stacked[k]:
                own = np.array(self._stack(own.tolist(), int(low[k])), np.int32)
            parts.append(own)
            words.append(np.full(len(own), word[start[k]], word.dtype))
        symbols, word = np.concatenate(parts), np.concatenate(words)
        rank, new = self._rank(symbols[:-1], symbols[1:])
        rank[word[1:] != word[:-1]] = NONE
        return symbols, word, np.append(rank, NONE), np.append(new, -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers, all words in common rounds."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols = self.char[points]
        key = symbols[:-1].astype(np.int64) << 32 | symbols[1:].astype(np.int64)
        cut = (self.near.find(key) < 0) | (owner[1:] != owner[:-1])
        part = np.concatenate([[0], np.cumsum(cut)])
        first = np.flatnonzero(np.append(True, cut))
        # a character that no piece has stays a part of its own, minus its code point
        symbols = np.where(symbols < 0, -points.astype(np.int64) - 1, symbols).astype(np.int32)
        part, merged = self.merge_rounds(symbols, part)
        owner = owner[first][part]
        odd = (merged < 0) | (merged >= len(self.kind))
        if odd.any():
            merged, owner = self._as_bytes(merged, owner, odd)
        ends = np.searchsorted(owner, np.arange(len(words)), side="right") * 4
        flat = merged.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _as_bytes(self, merged, owner, odd):
        """Symbols that are no piece become the ids of their UTF-8 bytes."""
        back = {i: c for c, i in self.spare.items()}
        raw = [(back[s] if s >= 0 else chr(-s - 1)).encode("utf-8", "surrogatepass") for s in merged[odd].tolist()]
        count = np.ones(len(merged), np.int64)
        count[odd] = [len(r) for r in raw]
        out, owner = np.repeat(merged, count), np.repeat(owner, count)
        out[np.repeat(odd, count)] = self.bytes_from[np.frombuffer(b"".join(raw), np.uint8)]
        return out, owner

    # --- whole texts ---------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.words.findall(((BLANK if self.prefix else "") + text).replace(" ", BLANK))

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of whole texts, little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        memo = self.memo
        fresh = [w for w in {w for words in split for w in words}.difference(memo) if not self._again(w)]
        ids = {} if fresh else memo
        for w, i in zip(fresh, self.encode_words(fresh), strict=True):
            if len(w) <= MEMO_WORD:
                memo[w] = i
                self.held += 200 + 4 * len(w) + len(i)
            else:
                ids[w] = i
        if ids and ids is not memo:
            long = ids.get
            out = [b"".join([long(w) or memo[w] for w in words]) for words in split]
        else:
            out = [b"".join([memo[w] for w in words]) for words in split]
        if self.held > MEMO_BYTES // 2:  # words not met since the last time are forgotten
            self.older, self.memo, self.held = memo, {}, 0
        return out

    def _again(self, word: str) -> bool:
        """Take a word over from the older half of the memory."""
        ids = self.older.get(word)
        if ids is None:
            return False
        self.memo[word] = ids
        self.held += 200 + 4 * len(word) + len(ids)
        return True

    def forget(self) -> None:
        self.memo, self.older, self.held = {}, {}, 0

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The library's decode: the first blank goes if the model adds one, bytes that are no UTF-8 become U+FFFD each."""
        listed = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        raw = b"".join(map(self.surface.__getitem__, listed))
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            out = "".join(self._runs(listed))
        if not self.prefix:
            return out
        lead = next((i for i in listed if self.kind[i] != _CONTROL), None)
        return out[1:] if lead is not None and self.kind[lead] == _NORMAL and self.surface[lead][:1] == b" " else out

    def _runs(self, ids: list[int]) -> Iterator[str]:
        """Surfaces with each run of byte pieces decoded by itself."""
        run = b""
        for i in ids:
            if self.kind[i] == _BYTE:
                run += self.surface[i]
                continue
            yield _bytewise(run)
            run = b""
            yield self.surface[i].decode("utf-8")
        yield _bytewise(run)


def _bytewise(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for size in range(1, 5):
            try:
                out.append(raw[at:at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec_for(path: str) -> PieceCodec:
    """The codec of a model file, read once in each Python worker."""
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _rows(batch: pa.RecordBatch, codec: PieceCodec) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded text of the batch's first column."""
    ids = codec.encode_batch(batch.column(0).to_pylist())
    offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])])
    flat = np.frombuffer(b"".join(ids), "<i4")
    decoded = [codec.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())


def encode_decode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """Add ``token_ids`` (array of int), ``n_tokens`` (long) and ``decoded`` (string).

    ``path`` names the model file on the workers; the public file that is installed
    with the Python environment by default."""
    path = path or model_path()
    bound_batches(docs.sparkSession)
    new = {"token_ids", "n_tokens", "decoded"}
    keep = [c for c in docs.columns if c.lower() not in new]
    given = docs.select(text_or_empty(text_col).alias("__text"), *[F.col(f"`{c}`") for c in keep])
    kinds = T.StructType(given.schema.fields[1:] + [T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                                                    T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        try:
            for batch in batches:
                ids, decoded = _rows(batch, codec)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids, decoded], [*keep, "token_ids", "decoded"])
        finally:
            codec.forget()

    out = given.mapInArrow(run, kinds)
    return out.select(*[F.col(f"`{c}`") for c in keep], "token_ids",
                      F.size("token_ids").cast("long").alias("n_tokens"), "decoded")
