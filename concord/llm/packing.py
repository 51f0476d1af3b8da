"""Concatenate tokenised documents and cut the stream into fixed windows.

Two passes.  The first tokenises every document where it lies and writes its
ids with their offset in its partition.  Prefix sums over the partitions' token
totals, a row for each partition, then give global offsets, and the second pass
cuts each document at the window borders it meets.  No document is shuffled,
and the only padding is at the end of the last sequence.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.shared import hold, materialise
from concord.llm.vocabulary import HashTable, byte_symbols, pair_keys

#: Strings between spaces, and words, that a worker keeps; a store is emptied beyond that, so memory is bounded.
KEPT_PARTS, KEPT_WORDS = 500_000, 200_000


class WordEncoder:
    """Ids of whole texts for a vocabulary of words with an end mark; white space is dropped.

    Lowest-rank merges are applied to all new words of a batch at once, as
    matrices; the ids of every string between spaces are kept as bytes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, symbol = spec["model"], byte_symbols()
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.inner, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for char, byte in symbol.items():
            self.inner[byte], self.final[byte] = self.vocab[char], self.vocab[char + end]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = self.vocab.__getitem__
        left, right = (np.array([ids(m[k]) for m in merges]) for k in (0, 1))
        self.made = np.array([ids(a + b) for a, b in merges], np.int32)
        self.merge = HashTable(pair_keys(left, right), np.arange(len(merges)), slack=8)
        self.store: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _matrix(self, n: int, joined: bytes, width: int) -> list[bytes]:
        """Ids of ``n`` words of one width."""
        raw = np.frombuffer(joined, np.uint8).reshape(n, width)
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        size, rows = np.full(n, width), np.arange(n)
        work = ids.copy()
        none = len(self.made)
        rank = self._ranks(work)
        while len(rows) and work.shape[1] > 1:
            best = rank.argmin(1)
            low = rank[np.arange(len(rows)), best]
            live = low < none
            done = rows[~live]
            ids[done, : work.shape[1]] = work[~live]
            size[done] = (work[~live] >= 0).sum(1)
            rows, work, rank, best, low = rows[live], work[live], rank[live], best[live], low[live]
            if not len(rows):
                break
            at, last = np.arange(len(rows)), work.shape[1] - 1
            work[at, best] = self.made[low]
            keep = np.arange(last)
            source = keep + (keep > best[:, None])
            work = np.take_along_axis(work, source, 1)
            # only the pairs beside the merged piece have new ranks
            rank = np.take_along_axis(rank, source[:, : last - 1] if last > 1 else source[:, :0], 1)
            for shift in (-1, 0):
                own = np.nonzero((best + shift >= 0) & (best + shift < last - 1))[0]
                p = best[own] + shift
                rank[own, p] = self._pair(work[own, p], work[own, p + 1])
        if len(rows):
            ids[rows, : work.shape[1]] = work
            size[rows] = (work >= 0).sum(1)
        flat, step = ids.astype("<u2").tobytes(), 2 * ids.shape[1]
        return [flat[at : at + n] for at, n in zip(range(0, len(flat), step), (2 * size).tolist(), strict=True)]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        got = self.merge.get(pair_keys(np.maximum(left, 0), np.maximum(right, 0)))
        return np.where((got < 0) | (left < 0) | (right < 0), len(self.made), got)

    def _ranks(self, work: np.ndarray) -> np.ndarray:
        left, right = work[:, :-1], work[:, 1:]
        return self._pair(left.ravel(), right.ravel()).reshape(left.shape)

    def _long(self, word: bytes) -> bytes:
        """One long word: a heap of merges over a linked list."""
        import heapq

        ids = [*self.inner[list(word[:-1])].tolist(), int(self.final[word[-1]])]
        after, before, heap = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], []
        found = self._pair(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(found.tolist()) if r < len(self.made)]
        heapq.heapify(heap)

        def push(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                r = int(self._pair(np.array([ids[k]]), np.array([ids[after[k]]]))[0])
                if r < len(self.made):
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))

        while heap:
            r, k, a, b = heapq.heappop(heap)
            if ids[k] != a or after[k] < 0 or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = int(self.made[r]), -1, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            push(before[k])
            push(k)
        return np.array([i for i in ids if i >= 0], "<u2").tobytes()

    def _learn_words(self, words: set[str]) -> None:
        if len(self.words) + len(words) > KEPT_WORDS:
            self.words.clear()
        groups: dict[int, list[str]] = {}
        for w in words - self.words.keys():
            if (n := len(w) if w.isascii() else len(w.encode())) in groups:
                groups[n].append(w)
            else:
                groups[n] = [w]
        for width, own in groups.items():
            if width > 40:
                self.words.update((w, self._long(w.encode())) for w in own)
                continue
            for start in range(0, len(own), 20_000):
                part = own[start : start + 20_000]
                self.words.update(zip(part, self._matrix(len(part), "".join(part).encode(), width), strict=True))

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def learn(self, parts: set[str]) -> None:
        """Store the ids of strings without spaces."""
        if len(self.store) + len(parts) > KEPT_PARTS:
            self.store.clear()
        store, split, normal, cut, bare, marked = self.store, self.pattern.findall, self._normal, {}, {}, {}
        for s in parts - store.keys():
            # most parts are a word, or a word and a mark; these need no pattern
            if s.isalpha():
                word = s.lower() if s.isascii() else normal(s)
                if s.isascii() or word.isalpha():  # lower-casing can leave a mark that is no letter
                    bare[s] = word
                    continue
            elif s[-1:] in _MARKS and s[:-1].isalpha():
                word = s[:-1].lower() if s.isascii() else normal(s[:-1])
                if s.isascii() or word.isalpha():
                    marked[s] = word
                    continue
            elif "<|" in s and self.specials.search(s):
                cut[s] = [x if x in self.special else split(normal(x)) for x in self.specials.split(s)]
                continue
            cut[s] = [split(normal(s))]
        self._learn_words({*bare.values(), *marked.values(), *_MARKS, *(w for own in cut.values() for x in own if not isinstance(x, str) for w in x)})
        words = self.words
        store.update(zip(bare, map(words.__getitem__, bare.values()), strict=True))
        mark = {m: words[m] for m in _MARKS}
        for s, w in marked.items():
            store[s] = words[w] + mark[s[-1]]
        for s, own in cut.items():
            store[s] = b"".join(self.special[x].to_bytes(2, "little") if isinstance(x, str) else b"".join(words[w] for w in x) for x in own)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as unsigned little-endian 16-bit numbers."""
        parts = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        self.learn({s for own in parts for s in own})
        get = self.store.__getitem__
        return [b"".join(map(get, own)) for own in parts]


#: marks that are one word each
_MARKS = frozenset(".,;:!?")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    return WordEncoder(path)


def tokenise(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, at, id_col, n, ids)``: every row's ids with ``end_id`` appended, and their offset in the partition."""

    def run(batches):
        gc.disable()  # the stores hold no cycles, and walking them takes a third of the time
        hold("packing", encoder.cache_clear)
        own, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(2, "little")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start in range(0, len(texts), 500):
                ids = [x + end for x in own.encode(texts[start : start + 500])]
                n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
                begin = at + n.cumsum() - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part), pa.int32()), pa.array(begin), batch.column(0).slice(start, len(ids)), pa.array(n), pa.array(ids, pa.binary())],
                    names=["part", "at", id_col, "n", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"part int, at long, `{id_col}` {kind}, n long, ids binary")


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids, each lying in one sequence.

    Returns ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, ids)`` for each piece; ``ids`` are unsigned little-endian 16-bit
    numbers.  Sequence ``s`` holds stream positions ``[s * window, (s + 1) *
    window)``; all but the last are full, and the last is to be padded to
    ``window`` (see :func:`pad`).  A null text is empty and gives the end id
    alone.  Rows with equal or null ids each give their own pieces; an empty
    table gives none.  Other columns are neither read nor returned.
    """
    stream = materialise(tokenise(docs, vocabulary, end_id, id_col, text_col), "ids")
    # one row for each partition of the scan, so its size is bounded by their number
    totals = stream.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = stream.join(F.broadcast(base), "part").select(id_col, "n", (F.col("base") + F.col("at")).alias("begin"), "ids")

    def run(batches):
        for batch in batches:
            rows, start, length, crc, total, sequence, offset, cut = [], [], [], [], [], [], [], []
            n_all, begin_all, ids_all = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for row, (n, begin, ids) in enumerate(zip(n_all, begin_all, ids_all, strict=True)):
                wide, at = np.frombuffer(ids, "<u2").astype("<u4"), 0
                while at < n:
                    seq, off = divmod(begin + at, window)
                    take = min(n - at, window - off)
                    rows.append(row)
                    start.append(at)
                    length.append(take)
                    crc.append(zlib.crc32(wide[at : at + take]))
                    total.append(n)
                    sequence.append(seq)
                    offset.append(off)
                    cut.append(ids[2 * at : 2 * (at + take)])
                    at += take
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total, sequence, offset)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *numbers, pa.array(cut, pa.binary())],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(run, schema)


def padded_length(n: int, window: int = 4096) -> int:
    """Length a sequence of ``n`` ids is stored at: ``window``, except at a power of two."""
    return n if n & (n - 1) == 0 else window


def pad(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n, ids)`` with each sequence's pieces joined in order and padded."""
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n"),
        F.expr("aggregate(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"),
    )
    size = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, F.col("n")).otherwise(F.lit(window))
    filler = F.expr(f"unhex('{pad_id.to_bytes(2, 'little').hex()}')")
    return joined.select("sequence_id", "n", F.rpad("ids", (size * 2).cast("int"), filler).alias("ids"))
