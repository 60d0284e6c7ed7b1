"""Scoring texts with a language model (operator 2).

Tokens are the words of a text (lower-cased A-Z) and one end. What is learned:

* the count of every word over all training documents, by a shuffle (``word_counts``);
* a causal self-attention model over subword ids (``attention.Attention``), trained in Spark
  tasks on the whole of every training document (``train_everywhere``). Its ids are the
  ``PIECES`` most frequent pieces of a public vocabulary file over all training words,
  counted by a shuffle (``piece_counts``); a word is cut into the longest pieces that match
  from the left; a byte without a piece costs the escape id and 1/256.

Training goes in rounds. In each, every task makes Adam steps from the shared weights over
its share of the documents; the weights and moments are summed by a shuffle, weighted by
steps, and the next round starts from their mean. Only vectors of a fixed size reach the
driver. There are ``passes`` passes over every training document, each in ``ROUNDS`` rounds over
a part of them by a hash of the id, whatever the table's size. Long texts are trained on in
sections. The weights depend a little on how rows are dealt to tasks.

A word's probability is ``MIX`` times the product of its pieces' probabilities (each
given everything before it within the window) plus ``1 - MIX`` times its share in the
counts, (c + 1) / (N + V + 1): both are proper, so the mixture is.

Words with a high count, at most ``HOT_WORDS`` of them, are known to every task; the
others leave the scoring pass as (document, word hash, log probability) rows and meet
their counts in a shuffle join, so the count table may have any size. A rare word has few
rows by its very count, so no join key is hot.

Defined cases: a null text is empty: one token, the end; a null id counts as the empty
text for the fold; without training documents N = V = 0 and the model is its start
values; documents with equal ids are scored each by itself; other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .attention import Attention
from .common import bound_batches, crc_mod, largest, stored, text_or_empty

FOLDS, HELD_OUT = 7, 2
HOT_WORDS = 200_000
PASSES = 1              # over every training document
ROUNDS = 4              # means taken in a pass
SECTION = 20_000        # words of a long text laid out at a time
TASK_WORDS = 1_000_000  # words for a training task, where the table is dealt finer
PART_WORDS = 60_000     # words laid out together
LANES = 64              # numbers in a row of a state that is summed
CLASSES, WIDTH = 32, 32
PIECES = CLASSES * WIDTH - 2
END, ESCAPE = 0, 1
MIX = 0.7
MEMO = 200_000
WIDE_WORD = 4096        # bytes up to which words are cut together
_FLUSH = 500_000
_LOWER = bytes([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a column of texts; the end is the empty word. Summed map-side first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n"])
            seen.clear()
            return out
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[b""] += 1
                if len(seen) >= _FLUSH:
                    yield flush()
        if seen:
            yield flush()
    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Cutter:
    """Cuts words into the longest matching pieces; ids by (bytes, ends the word)."""

    def __init__(self, inner: dict[bytes, int], last: dict[bytes, int]):
        self.inner, self.last = inner, last
        self.longest = max(map(len, [*inner, *last, b"x"]))
        # the same as a tree over bytes for many words at once: node 0 is none, node 1 the root
        nodes = {b"": 1}
        for piece in [*inner, *last]:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes) + 1)
        self.below = np.zeros((len(nodes) + 1, 256), np.int32)
        self.found = np.full((2, len(nodes) + 1), -1, np.int32)  # within a word, at its end
        for piece, node in nodes.items():
            if piece:
                self.below[nodes[piece[:-1]], piece[-1]] = node
        for k, ids in enumerate((inner, last)):
            for piece, i in ids.items():
                self.found[k, nodes[piece]] = i

    def cut(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            for k in range(min(self.longest, n - at), 0, -1):
                found = (self.last if at + k == n else self.inner).get(word[at:at + k])
                if found is not None:
                    out.append(found)
                    at += k
                    break
            else:
                out.append(ESCAPE)
                at += 1
        return out

    def cut_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words one after the other, and their number in each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(len(words), np.int64)
        stops = np.cumsum(sizes)
        left = np.repeat(stops, sizes) - np.arange(len(raw))  # bytes up to the word's end
        best, length = np.full(len(raw), ESCAPE, np.uint16), np.ones(len(raw), np.int64)
        place, node = np.arange(len(raw)), self.below[1].take(raw)
        for k in range(1, self.longest + 1):
            going = np.flatnonzero(node)
            place, node = place.take(going), node.take(going)
            if not len(place):
                break
            rest = left.take(place)
            ids = self.found[(rest == k).view(np.int8), node]
            hit = np.flatnonzero(ids >= 0)
            best[place.take(hit)], length[place.take(hit)] = ids.take(hit), k
            going = np.flatnonzero(rest > k)
            place = place.take(going)
            node = self.below[node.take(going), raw.take(place + k)]
        used = np.zeros(len(raw) + 1, np.int64)
        full = np.flatnonzero(sizes)
        at, end = (stops - sizes).take(full), stops.take(full)
        while len(at):  # the next piece of every word that has one
            used[at] = 1
            at = at + length.take(at)
            going = np.flatnonzero(at < end)
            at, end = at.take(going), end.take(going)
        before = np.concatenate([[0], np.cumsum(used)])
        return best[used[:-1] > 0], before.take(stops) - before.take(stops - sizes)


def piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """(a, b, n) over all counted words (word, c): uses of piece a (b = -1) and of the pair a, b in a word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec_for(path)
        keys, uses, held = [], [], 0  # a << 32 | b + 1

        def add(ids: np.ndarray, ends: np.ndarray, n: np.ndarray):
            each = np.repeat(n, np.diff(ends, prepend=0))
            same = np.ones(len(ids), bool)  # the next id belongs to the same word
            same[ends[np.diff(ends, prepend=0) > 0] - 1] = False
            pair = np.flatnonzero(same)
            keys.extend([ids << 32, ids[pair] << 32 | ids[pair + 1] + 1])
            uses.extend([each, each[pair]])
            return len(ids) + len(pair)

        def summed():
            flat, n = np.concatenate(keys), np.concatenate(uses)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.diff(flat, prepend=-1))
            return flat[first], np.add.reduceat(n[order], first)

        def rows(flat: np.ndarray, n: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array((flat >> 32).astype(np.int32)), pa.array(((flat & 0xFFFFFFFF) - 1).astype(np.int32)),
                                               pa.array(n)], names=["a", "b", "n"])
        for batch in batches:
            raw, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for own, ids, ends in codec.merge_words(raw):
                held += add(ids, np.array(ends, np.int64), n[own])
            for r, word in enumerate(raw):
                if word and codec.alone(word):
                    ids = np.array(codec.merge_bytes(word), np.int64)
                    if len(ids):
                        held += add(ids, np.array([len(ids)]), n[r:r + 1])
            if held >= _FLUSH:
                flat, n = summed()
                if len(flat) >= _FLUSH // 2:
                    yield rows(flat, n)
                    keys, uses, held = [], [], 0
                else:
                    keys, uses, held = [flat], [n], len(flat)
        if held:
            yield rows(*summed())
    return counts.select("word", "c").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def choose_pieces(counts: DataFrame, path: str, most: int = PIECES) -> Cutter:
    """The pieces of the vocabulary file that the counted words use most, as model ids.

    Ids lie in classes of WIDTH: pieces are ordered by whether they end a word and by the
    leading direction of which words they occur in, so a class holds pieces of a kind.
    The driver sees a row per piece of the file and per pair of chosen pieces."""
    codec = bpe.codec_for(path)
    found = stored(piece_counts(counts, path), "pieces")
    use = {r["a"]: r["n"] for r in found.filter("b = -1").collect()}
    top = [i for i, _ in sorted(use.items(), key=lambda x: (-x[1], x[0]))[:most]]
    pairs = {(r["a"], r["b"]): r["n"] for r in found.filter(F.col("a").isin(top) & F.col("b").isin(top)).collect()} if top else {}
    symbols = {s: b for b, s in enumerate(bpe.byte_symbols())}
    place = {i: k for k, i in enumerate(top)}
    near = np.zeros((len(top), len(top)))
    for (a, b), n in pairs.items():
        near[place[a], place[b]] += n
        near[place[b], place[a]] += n
    rows = np.sqrt(near / np.maximum(1, near.sum(1, keepdims=True)))
    lead = np.linalg.svd(rows - rows.mean(0))[0][:, 0] if len(top) > 1 else np.zeros(len(top))
    ends = np.array([codec.names[i].endswith(codec.suffix) for i in top], bool)
    inner, last = {}, {}
    for k, j in enumerate(np.lexsort((lead, ends))):
        name = codec.names[top[j]]
        raw = bytes(symbols[c] for c in (name.removesuffix(codec.suffix) if ends[j] else name))
        (last if ends[j] else inner)[raw] = k + 2
    return Cutter(inner, last)


class Scorer:
    """Scores texts: pieces and counts of words are kept in a bounded table."""

    def __init__(self, model: Attention, cutter: Cutter, hot: dict[bytes, int], n: int, v: int, mix: float = MIX):
        self.model, self.cutter, self.hot, self.mix = model, cutter, hot, mix
        self.floor = n + v + 1
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.pieces, self.offset, self.count = array("H"), array("q", [0]), array("q")

    def _add(self, words: list[bytes]) -> None:
        size = np.ones(len(words), np.int64)
        many = np.array([0 < len(w) <= WIDE_WORD for w in words], bool)
        cut, n = self.cutter.cut_many([w for w, short in zip(words, many.tolist(), strict=True) if short])
        size[many] = n
        alone = {i: np.array(self.cutter.cut(words[i]) if words[i] else [END], np.uint16) for i in np.flatnonzero(~many).tolist()}
        for i, ids in alone.items():
            size[i] = len(ids)
        stops = np.cumsum(size)
        pieces = np.empty(int(stops[-1]), np.uint16)
        inside = np.repeat(many, size)
        pieces[inside] = cut
        for i, ids in alone.items():
            pieces[stops[i] - size[i]:stops[i]] = ids
        self.offset.frombytes((stops + len(self.pieces)).tobytes())
        self.pieces.frombytes(pieces.tobytes())
        self.count.extend([self.hot.get(w, -1) for w in words])  # -1: not among the words known here
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))

    def laid(self, texts: list[list[bytes]]):
        """Texts as lists of words, each ending with b"", laid end to end: ids, starts, lengths and
        targets of their pieces, then the place of each word in the table and where its pieces end."""
        if len(self.index) > MEMO:
            self._reset()
        flat = [w for words in texts for w in words]
        new = list(set(flat).difference(self.index))
        if new:
            self._add(new)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        offset = np.array(self.offset, np.int64)
        sizes = (offset[1:] - offset[:-1])[at]
        stops = np.cumsum(sizes)
        goal = np.array(self.pieces, np.uint16)[
            np.arange(stops[-1]) - np.repeat(stops - sizes, sizes) + np.repeat(offset[at], sizes)].astype(np.int64)
        last_word = np.cumsum([len(w) for w in texts]) - 1
        lengths = np.diff(stops[last_word], prepend=0)
        starts = stops[last_word] - lengths
        ids = np.roll(goal, 1)
        ids[starts] = END  # a text begins as if after an end
        return ids, starts, lengths, goal, at, stops - sizes

    def score(self, texts: list[list[bytes]]):
        """For texts as lists of words, each ending with b"": log10 model probability of each
        word's pieces, count of each word (-1 unknown here), words per text."""
        ids, starts, lengths, goal, at, first = self.laid(texts)
        lp = self.model.log_probs(ids, starts, lengths, goal).astype(np.float64) / np.log(10)
        lp[goal == ESCAPE] -= np.log10(256)
        return np.add.reduceat(lp, first), np.array(self.count, np.int64)[at], np.array([len(w) for w in texts])


def train_everywhere(learn: DataFrame, model: Attention, cutter: Cutter, n_texts: int, n_words: int,
                     passes: int = PASSES, rate: float = 0.01) -> int:
    """Train ``model`` on every text of ``learn`` (doc_id, text); returns the positions trained on.

    ``n_words`` sets only the size of a task."""
    state, done, seen = model.start(), 0.0, 0
    if not n_texts:
        return 0
    size = state.size
    lanes = [f"v{i}" for i in range(LANES)]
    learn = learn.coalesce(int(max(4, n_words // TASK_WORDS)))

    def task(state: np.ndarray, done: float, step: float, seed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model, cutter, {}, 0, 0)
            own, made, positions = state.copy(), 0, 0
            for part in _parts(batches):
                ids, starts, lengths, goal = scorer.laid(part)[:4]
                made += model.train(own, done + made, ids, starts, lengths, goal, step, seed=seed + made)
                positions += len(goal)
            if made:
                rows = np.zeros(-(-size // LANES) * LANES)
                rows[:size] = own.ravel() * made
                rows = rows.reshape(-1, LANES)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, made)), pa.array(np.full(n, made * made)),
                     pa.array(np.full(n, positions)), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]],
                    names=["slot", "w", "ww", "positions", *lanes])
        return run

    kind = ", ".join(["slot int, w long, ww long, positions long", *[f"{v} double" for v in lanes]])
    total = passes * ROUNDS
    for r in range(total):
        part = learn.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(ROUNDS)) == r % ROUNDS)
        sums = part.select("text").mapInArrow(task(state, done, rate * (1 - 0.9 * r / total), 1000 * r), kind) \
            .groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("w", "ww", "positions", *lanes)]).toPandas().sort_values("slot")
        if not len(sums):
            continue  # no text has fallen into this slice
        w = sums["w"].iloc[0]
        state = (sums[lanes].to_numpy(np.float64).ravel()[:size] / w).reshape(state.shape)
        done += sums["ww"].iloc[0] / w  # the mean number of steps, weighted as the weights are
        seen += int(sums["positions"].iloc[0])
    model.load(state)
    return seen


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """The texts of a task as word lists, long ones in sections, about PART_WORDS at a time."""
    part, held = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = [*words_of(text), b""]
            for at in range(0, len(words), SECTION):
                part.append(words[at:at + SECTION])
                held += len(part[-1])
                if held >= PART_WORDS:
                    yield part
                    part, held = [], 0
    if part:
        yield part


_SCORED = ("doc_id long, n_tokens long, known long, base double, score double, "
           "rare array<struct<h: long, lp: double>>")


def _score_rows(docs: DataFrame, scorer_args: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*scorer_args)
        kind = pa.list_(pa.struct([("h", pa.int64()), ("lp", pa.float64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < 60_000:  # words scored together
                    part.append([*words_of(texts[at]), b""])
                    size += len(part[-1])
                    at += 1
                lp, count, per = scorer.score(part)
                hot = count >= 0
                share = np.log10((np.maximum(count, 0) + 1) / scorer.floor)
                mixed = np.logaddexp(np.log(scorer.mix) + lp * np.log(10),
                                     np.log1p(-scorer.mix) + share * np.log(10)) / np.log(10)
                first = np.cumsum(per) - per
                total = lambda x: np.add.reduceat(np.where(hot, x, 0.0), first)  # noqa: E731, B023
                flat = [w for words in part for w in words]
                rare = np.flatnonzero(~hot)
                h = np.fromiter((xxhash.xxh64_intdigest(flat[i], 42) for i in rare), np.uint64, len(rare)).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat((~hot).astype(np.int64), first))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(h), pa.array(lp[rare])], names=["h", "lp"]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at - len(part), len(part)), pa.array(per.astype(np.int64)),
                     pa.array(total((count > 0).astype(float)).astype(np.int64)), pa.array(total(share)),
                     pa.array(total(mixed)), lists.cast(kind)], names=["doc_id", "n_tokens", "known", "base", "score", "rare"])
    return docs.mapInArrow(run, _SCORED)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
          hot_words: int = HOT_WORDS, mix: float = MIX, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    fold = crc_mod("doc_id", FOLDS)
    learn = texts.filter(fold != HELD_OUT)
    counts = stored(word_counts(learn.select("text")).withColumn("h", F.xxhash64("word")), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    top = largest(counts, "c", hot_words).select("word", "c").toPandas().sort_values(
        ["c", "word"], ascending=[False, True]).itertuples(index=False)
    top = [(bytes(w), int(c)) for w, c in top]
    path = path or bpe.vocabulary_path()
    cutter = choose_pieces(counts, path)
    model = Attention(CLASSES, WIDTH)
    ends = counts.filter(F.length("word") == 0).first()  # an end a text
    train_everywhere(learn, model, cutter, ends["c"] if ends else 0, n, passes)
    rows = _score_rows(texts, (model, cutter, dict(top), n, v, mix)).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc_id", "n_tokens", "known", "base", "score", F.explode_outer("rare").alias("r"))
    each = each.join(counts.select("h", "c"), F.col("r.h") == F.col("h"), "left")
    share = (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1))
    rare = F.col("r").isNotNull()
    mixed = F.log10(F.lit(mix) * F.pow(F.lit(10.0), F.col("r.lp")) + F.lit(1 - mix) * share)
    out = each.groupBy("row", "doc_id", "n_tokens", "known", "base", "score").agg(
        F.sum(F.when(rare & F.col("c").isNotNull(), 1).otherwise(0)).alias("k"),
        F.sum(F.when(rare, F.log10(share)).otherwise(0.0)).alias("b"), F.sum(F.when(rare, mixed).otherwise(0.0)).alias("s"))
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
                      (F.col("known") + F.col("k")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") + F.col("b")).alias("base_score"), (F.col("score") + F.col("s")).alias("score"))
