"""BPE encoding and decoding with a given vocabulary file (operator 1).

A pre-token starts as a row of byte symbols. Every adjacent pair has a rank (its place in
the merge list, or none). A segment tree holds the ranks; its root names the lowest rank,
and descending to the left child whenever that holds the minimum finds the leftmost such
pair. The pair is merged, the two neighbouring pairs get new ranks (point updates along
one path to the root, logarithmic), and so on until the root holds no rank. A run of n
bytes without blanks costs n log n, so a megabyte without a space is no special case.

The vocabulary file is the JSON of a word-level BPE tokenizer: NFC, white space to one
blank, lower case, a split pattern, byte symbols, word ends marked with a suffix, and
special tokens found in the raw text. ``Codec`` reads it in every Python worker through
its path (or from the bytes, see ``codec_for``), nothing is copied or trained.

Short words share their rounds: the trees of many words lie in one array, and a round takes
all roots, merges and updates the paths of all words (``MergeTrees``). Long words have a
tree of their own (``merge_all``). Each distinct blank-separated chunk of a batch is encoded
and decoded once; nothing is kept from batch to batch, and a batch is bounded in bytes.

Defined cases: null and empty texts have no ids and decode to the empty text; a column
of the input that has the name of an output column is replaced; rows, other columns and
their order are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, release_memory, text_or_empty
from .keytable import KeyTable

#: New chunks that are learnt together.
LEARN = 20_000
#: Words up to these lengths share trees of one width, this many rows at a time.
WIDTHS, ROWS = (4, 8, 16, 32, 64), 20_000
WIDEST = WIDTHS[-1]
NO_RANK = 1 << 62
_PLACE = (1 << 32) - 1
#: The Unicode White_Space characters.
_SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where visible, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_all(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge until no pair has a rank: ``ranks[left << 32 | right]``, ``made[rank]`` the new id.

    Node k of the tree holds the least ``rank << 32 | place`` below it, so the root is the
    leftmost of the lowest-ranked pairs."""
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    width = 1 << (n - 2).bit_length()
    tree = [NO_RANK] * (2 * width)
    for i in range(n - 1):
        rank = get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[width + i] = rank << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (root := tree[1]) != NO_RANK:
        i = root & _PLACE
        j = after[i]
        ids[i] = made[root >> 32]
        ids[j] = -1
        k = after[i] = after[j]
        changed = [(j, NO_RANK)] if k < n else []
        rank = None
        if k < n:
            before[k] = i
            rank = get(ids[i] << 32 | ids[k])
        changed.append((i, NO_RANK if rank is None else rank << 32 | i))
        h = before[i]
        if h >= 0:
            rank = get(ids[h] << 32 | ids[i])
            changed.append((h, NO_RANK if rank is None else rank << 32 | h))
        for place, value in changed:
            node = place + width
            if tree[node] == value:
                continue
            tree[node] = value
            while node > 1:  # one path up, as far as the minimum changes
                other = tree[node ^ 1]
                node >>= 1
                low = value if value < other else other
                if tree[node] == low:
                    break
                tree[node] = value = low
    return [x for x in ids if x >= 0]


class MergeTrees:
    """The same merging for many short words at once: row r of each array belongs to word r.

    A round takes the root of every tree, merges that pair and updates the three changed leaves
    along their paths to the root, one level of all words in one numpy step."""

    def __init__(self, ranks: dict[int, int], made: list[int]):
        keys = np.array(sorted(ranks), np.int64)
        self.pairs = KeyTable(keys)
        self.ranks = np.array([ranks[k] for k in keys.tolist()] or [0], np.int64)
        self.made = np.array(made or [0], np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = self.pairs.find(left << 32 | right)
        return np.where(at >= 0, self.ranks[at] << 32 | place, NO_RANK)

    def merge(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``ids``: one word a row (a power of two wide) of ``size`` symbols; merged in place, -1 where a symbol went."""
        words, stride = ids.shape
        width = stride  # a power of two; the last place has no pair
        column = np.arange(stride - 1)
        tree = np.full((words, 2 * width), NO_RANK, np.int64)
        inside = column[None, :] < (size - 1)[:, None]
        first = self._leaf(ids[:, :-1][inside], ids[:, 1:][inside], np.broadcast_to(column, inside.shape)[inside])
        tree[:, width:width + stride - 1][inside] = first
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        after = np.tile(np.arange(1, stride + 1), (words, 1)).reshape(-1)
        before = np.tile(np.arange(-1, stride - 1), (words, 1)).reshape(-1)
        flat, nodes = ids.reshape(-1), tree.reshape(-1)
        live = np.arange(words)
        while True:
            root = nodes[live * (2 * width) + 1]
            more = root != NO_RANK
            live, root = live[more], root[more]
            if not len(live):
                return ids
            base, top, n = live * stride, live * (2 * width), size[live]
            i = root & _PLACE
            j = after[base + i]
            k = after[base + j]
            flat[base + i] = self.made[root >> 32]
            flat[base + j] = -1
            after[base + i] = k
            right = k < n
            leaf = np.full(len(live), NO_RANK, np.int64)
            b, at = base[right], i[right]
            before[b + k[right]] = at
            leaf[right] = self._leaf(flat[b + at], flat[b + k[right]], at)
            nodes[top + width + j] = NO_RANK
            nodes[top + width + i] = leaf
            h = before[base + i]
            left = h >= 0
            b, at = base[left], h[left]
            nodes[top[left] + width + at] = self._leaf(flat[b + at], flat[b + i[left]], at)
            h = np.where(left, h, i)
            step = width
            paths = [h + width, i + width, j + width]
            while step > 1:
                step //= 2
                paths = [p >> 1 for p in paths]
                for p in paths:
                    below = top + 2 * p
                    nodes[top + p] = np.minimum(nodes[below], nodes[below + 1])


def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    """Ids one after the other, names with one blank between them."""
    return b"".join([ids for ids, _ in parts]), " ".join([text for ids, text in parts if ids])


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab.get(s, -1) for s in symbols]
        self.last = [vocab.get(s + self.suffix, -1) for s in symbols]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split.replace(r"\s", _SPACE))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.space = regex.compile(f"[{_SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")  # blanks for str.split, not for Unicode
        self.trees = MergeTrees(self.ranks, self.made)
        self.starts = sorted({name[0] for name in self.special if name})
        self.whole = min(self.inner) >= 0 and min(self.last) >= 0
        self.letters = r"[\p{L}]+" in split  # then a run of letters is one piece

    def merge_bytes(self, raw: bytes) -> list[int]:
        """Ids of one pre-token's bytes, by the segment tree."""
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        return merge_all(ids, self.ranks, self.made)

    def encode_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Ids and names of each pre-token; short ones by trees over many words, long ones by a tree of their own."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[tuple[bytes, str]] = [(b"", "")] * len(words)
        for own, ids, ends in self.merge_words(raw):
            flat, names = ids.astype("<u4").tobytes(), list(map(self.names.__getitem__, ids.tolist()))
            for r, a, b in zip(own.tolist(), [0, *ends], ends, strict=False):
                out[r] = flat[4 * a:4 * b], names[a] if b - a == 1 else " ".join(names[a:b])
        for r, w in enumerate(raw):
            if self.alone(w):
                flat = np.array(self.merge_bytes(w), "<u4").tobytes()
                out[r] = flat, self.decode(flat)
        return out

    def alone(self, raw: bytes) -> bool:
        """Whether a word is merged by ``merge_bytes`` only."""
        return len(raw) > WIDEST or not self.whole

    def merge_words(self, raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        """Of the words that need no tree of their own, some at a time: their places in ``raw``, their ids
        one after the other, and where each word's ids end."""
        size = np.array([len(r) for r in raw], np.int64)
        if not self.whole:
            size[:] = WIDEST + 1
        low = 0
        for most in WIDTHS:
            chosen = np.flatnonzero((size > low) & (size <= most))
            low = most
            for at in range(0, len(chosen), ROWS):
                own = chosen[at:at + ROWS]
                n = size[own]
                inside = np.arange(most)[None, :] < n[:, None]
                ids = np.full((len(own), most), -1, np.int64)
                symbols = np.frombuffer(b"".join([raw[r] for r in own.tolist()]), np.uint8)
                ids[inside] = self.inner_ids[symbols]
                rows = np.arange(len(own))
                ids[rows, n - 1] = self.last_ids[symbols[np.cumsum(n) - 1]]
                ids = self.trees.merge(ids, n)
                kept = ids >= 0
                yield own, ids[kept], np.cumsum(kept.sum(1)).tolist()

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids and decoded text of chunks, all their new words merged together."""
        normal, find, letters = unicodedata.normalize, self.pieces.findall, self.letters
        lower = [c.lower() if c.isascii() else normal("NFC", c).replace("Σ", "σ").lower() for c in chunks]
        pieces = [(c,) if letters and c.isalpha() else find(c) for c in lower]
        words = list({w for p in pieces for w in p})
        coded = dict(zip(words, self.encode_words(words), strict=True))
        made = {c: coded[p[0]] if len(p) == 1 else _joined([coded[w] for w in p])
                for c, p in zip(chunks, pieces, strict=True)}
        return made | {c: self._special(c) for c in self.special.keys() & made.keys()}

    def _chunks(self, text: str) -> list[str]:
        """Blank-separated chunks; special tokens stand by themselves."""
        if self.special_split is None or not any(s in text for s in self.starts):
            return self._split(text)
        out: list[str] = []
        for k, part in enumerate(self.special_split.split(text)):
            out += [part] if k % 2 else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        return [c for c in self.space.split(text) if c] if self.odd.search(text) else text.split()

    def encode_batch(self, texts: Iterable[str | None]) -> list[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text."""
        new: set[str] = set()
        for t in texts:
            new.update(self._chunks(t or ""))
        ordered = list(new)
        coded = {}
        for at in range(0, len(ordered), LEARN):
            coded |= self._learn(ordered[at:at + LEARN])
        return [_joined([coded[c] for c in self._chunks(t or "")]) for t in texts]

    def _special(self, name: str) -> tuple[bytes, str]:
        ids = np.array([self.special[name]], "<u4").tobytes()
        return ids, self.decode(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0][0]

    def decode(self, ids: bytes) -> str:
        """Names of the ids, joined by one blank (the file names no other decoder)."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec_for(path: str) -> Codec:
    """The codec of a vocabulary file, read once in each Python worker."""
    with open(path, encoding="utf-8") as f:
        return Codec(json.load(f))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_decode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """Add ``token_ids`` (binary, little-endian u32), ``n_tokens`` (long) and ``decoded`` (string).

    ``path`` names the vocabulary file on the workers; the public file that is installed
    with the Python environment by default."""
    path = path or vocabulary_path()
    bound_batches(docs.sparkSession)
    new = {"token_ids", "n_tokens", "decoded"}
    keep = [c for c in docs.columns if c.lower() not in new]
    given = docs.select(text_or_empty(text_col).alias("__text"), *[F.col(f"`{c}`") for c in keep])
    kind = T.StructType(given.schema.fields[1:] + [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            made = codec.encode_batch(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([i for i, _ in made], pa.binary()),
                                              pa.array([t for _, t in made], pa.string())], kind.names)
        release_memory()

    out = given.mapInArrow(run, kind)
    ids = F.col("token_ids")
    return out.select(*[F.col(f"`{c}`") for c in keep], ids, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), "decoded")


def ids_array(token_ids: bytes) -> list[int]:
    """The stored binary as a list of ids."""
    return np.frombuffer(token_ids, "<u4").tolist()
