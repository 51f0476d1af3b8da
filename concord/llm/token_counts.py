"""Exact byte-pair token counts at every prefix of a text.

Method: prefix dynamic programming.  The encoding of the first ``i`` bytes of a
pre-token ends in exactly one vocabulary piece ``t`` that is compatible with
the last piece of the encoding of the ``i - len(t)`` bytes before it; so one
pass over the positions stores the count, and the last piece, for every prefix,
and no prefix is ever encoded again.  Two neighbouring pieces are compatible
when no merge across their border precedes the merges that made them.
"""

from __future__ import annotations

import bisect
import functools
import gc
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from concord.llm.shared import hold, map_arrow
from concord.llm.vocabulary import HashTable, PieceTable, PrefixForest, byte_symbols, forests, pair_keys

#: The pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments a worker keeps; the store is emptied beyond that, so memory is bounded.
KEPT_SEGMENTS = 1_000_000
#: Pre-tokens up to this width are handled as matrices, longer ones one by one.
WIDE = 48

_SAFE_SPACE = regex.compile(r" (?=\S)(?<=\S )")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: marks that are one token each
_MARKS = frozenset(".,;:!?")
_ADD = [bytes((i + k) & 255 for i in range(256)) for k in range(256)]


class PrefixCounter:
    """Token counts of every prefix of texts, for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbol, model = byte_symbols(), spec["model"]
        raw = lambda piece: bytes(symbol[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {piece: i for piece, i in model["vocab"].items() if piece not in self.special}
        self.pieces = PieceTable((raw(p), i) for p, i in vocab.items())
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges]) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges])
        #: rank of the merge that makes a piece; single bytes come first
        self.rank = np.full(max(vocab.values()) + 1, -1, np.int64)
        self.first, self.second = (np.arange(len(self.rank)) for _ in range(2))
        self.rank[made], self.first[made], self.second[made] = np.arange(len(merges)), left, right
        self.merge = HashTable(pair_keys(left, right), np.arange(len(merges)))
        self.pattern = regex.compile(PATTERN)
        self.has_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[int, bool] = {}
        self.store: dict[str, bytes | array] = {}
        self.words: dict[bytes, bytes | array] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the joined bytes gives back exactly the two pieces."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        #: merges at the border count only before this rank
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            met = self.merge.get(pair_keys(a, b)).astype(np.int64)
            bad = (met >= 0) & (met < limit)
            ok[live[bad]] = False
            # undo the later of the two merges: before it, its inner piece stood at the border
            undo_left = self.rank[a] > self.rank[b]
            limit = np.where(undo_left, self.rank[a], self.rank[b] + 1)
            going = ~bad & (np.maximum(self.rank[a], self.rank[b]) >= 0)
            a = np.where(undo_left, self.second[a], a)[going]
            b = np.where(undo_left, b, self.first[b])[going]
            live, limit = live[going], limit[going]
        return ok

    def count_words(self, words: list[bytes]) -> dict[bytes, bytes | array]:
        """For each distinct pre-token the counts after 1, 2, .. bytes."""
        out: dict[bytes, bytes | array] = {w: self._count_long(w) for w in words if len(w) > WIDE}
        for own, forest in forests(words):
            flat, width = self._count_forest(forest).tobytes(), forest.matrix.shape[1]
            out.update((w, flat[k : k + len(w)]) for w, k in zip(own, range(0, len(flat), width), strict=True))
        return out

    def _count_forest(self, forest: PrefixForest) -> np.ndarray:
        n, width = forest.matrix.shape
        last, count = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.uint8)
        for i in range(1, width + 1):
            rows, node = forest.level(i)
            if not len(rows):
                break
            pieces, counts = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.uint8)
            left = np.arange(len(rows))
            for length in range(min(i, self.pieces.longest), 0, -1):
                piece = self.pieces.ending(forest.hashes, i, length, rows[left])
                found = np.nonzero(piece >= 0)[0]
                if not len(found):
                    continue
                at, piece = left[found], piece[found]
                if length < i:
                    good = self.compatible(last[i - length][rows[at]], piece)
                    found, at, piece = found[good], at[good], piece[good]
                pieces[at], counts[at] = piece, count[i - length][rows[at]] + 1
                left = np.delete(left, found)
                if not len(left):
                    break
            node = np.maximum(node, 0)
            last[i], count[i] = pieces[node], counts[node]
        return np.ascontiguousarray(count[1:].T)

    def _fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self.known.get(key)) is None:
            if len(self.known) > KEPT_SEGMENTS:
                self.known.clear()
            known = self.known[key] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return known

    def _count_long(self, word: bytes) -> array:
        ids, lengths = self.pieces.ids, self.pieces.lengths
        last, count = [0], array("I", [0])
        for i in range(1, len(word) + 1):
            for length in lengths:
                if length > i:
                    raise AssertionError("every single byte is a piece")
                piece = ids.get(word[i - length : i])
                if piece is not None and (length == i or self._fits(last[i - length], piece)):
                    last.append(piece)
                    count.append(count[i - length] + 1)
                    break
        return count[1:]

    def _word(self, word: bytes) -> bytes | array:
        if (got := self.words.get(word)) is None:
            if len(self.words) > KEPT_SEGMENTS:
                self.words.clear()
            got = self.words[word] = self.count_words([word])[word]
        return got

    def _total(self, text: str) -> int:
        return sum(self._word(w.encode())[-1] for w in self.pattern.findall(text))

    def segments(self, text: str) -> list[str]:
        """Cut before single spaces between words: no pre-token reaches over such a cut."""
        if "  " in text or "\n " in text or " \n" in text or "\0" in text or " " in (text[0], text[-1]) or _OTHER_SPACE.search(text):
            cuts = _SAFE_SPACE.split(text)
            return [cuts[0], *(" " + c for c in cuts[1:])]
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, segments: set[str]) -> None:
        """Store the prefix counts of segments not yet known, all their pre-tokens at once."""
        if len(self.store) + len(segments) > KEPT_SEGMENTS:
            self.store.clear()
        store, split = self.store, self.pattern.findall
        one, two, more = [], [], {}
        for s in segments - store.keys():
            # most segments are a word, or a word and a mark; these need no pattern
            if s[:1].strip(" ").isalpha() is (s[:1] != " ") and s[1:].isalpha():
                one.append(s)
            elif s[-1:] in _MARKS and s[1:-1].isalpha() and s[:1].strip(" ").isalpha() is (s[:1] != " "):
                two.append(s)
            elif self.has_special and "<|" in s:
                store[s] = self._irregular(s)
            else:
                more[s] = split(s)
        words = {*one, *(s[:-1] for s in two), *_MARKS, *(w for own in more.values() for w in own)}
        table = dict(zip(words, map(self.count_words([w.encode() for w in words]).__getitem__, map(str.encode, words)), strict=True))
        store.update((s, table[s]) for s in one)
        for s in two:
            counts = table[s[:-1]]
            store[s] = counts + bytes([counts[-1] + 1]) if isinstance(counts, bytes) else self._irregular(s)
        for s, own in more.items():
            total, out = 0, b""
            for w in own:
                counts = table[w]
                if total + counts[-1] > 255 or not isinstance(counts, bytes):
                    out = self._irregular(s)
                    break
                out += counts.translate(_ADD[total])
                total += counts[-1]
            store[s] = out

    def _irregular(self, segment: str) -> array:
        """Counts by bytes of a segment that holds long words, or special strings, each one token."""
        out, total, at = array("I"), 0, 0
        for m in [*(self.has_special.finditer(segment) if self.has_special else ()), None]:
            part = segment[at : m.start() if m else len(segment)]
            for w in self.pattern.findall(part):
                counts = self._word(w.encode())
                out.extend(total + c for c in counts)
                total += counts[-1]
            if m:
                total += 1
                out.extend([total] * len(m[0]))
                at = m.end()
        return out

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        own = self.segments(text)
        self.learn(set(own))
        return sum(self.store[s][-1] for s in own)

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:k]`` for k = 0 .. len(text), each as if encoded alone.

        Three kinds of prefix are split into pre-tokens otherwise than the text
        is: those that end inside a contraction, just after a run of white
        space, or inside a special string.  They are counted from the start of
        the pre-token they end in.
        """
        out, total, at = [0], 0, 0
        parts = [(m.start(), m.end()) for m in self.has_special.finditer(text)] if self.special else []
        for lo, hi in [*parts, (len(text), len(text))]:
            chunk, spans = text[at:lo], []
            for m in self.pattern.finditer(chunk):
                word, begun = m[0], at + m.start()
                spans.append((begun, total))
                if word in ("'re", "'ve", "'ll"):
                    out += [total + 1, total + 1 + self._total(word[1]), total + self._total(word)]
                else:
                    counts, b = self._word(word.encode()), 0
                    for c in word:
                        b += len(c.encode())
                        out.append(total + counts[b - 1])
                    if word[0] == " " and len(word) > 1 and begun > at and text[begun - 1].isspace():
                        # the prefix that ends with this space has the whole run as one pre-token
                        before, base = spans[-2]
                        out[begun + 1] = base + self._total(text[before : begun + 1])
                    elif word.isspace() and len(spans) > 1 and text[begun - 1].isspace():
                        before, base = spans[-2]
                        out[begun + 1 :] = [base + self._total(text[before : begun + k + 1]) for k in range(len(word))]
                total += self._word(word.encode())[-1]
            if lo < hi:
                before, base = spans[-1] if spans else (lo, total)
                if spans and len(spans) > 1 and text[spans[-1][0]].isspace() and text[spans[-2][0]].isspace():
                    before, base = spans[-2]
                out += [base + self._total(text[before:k]) for k in range(lo + 1, hi)]
                total += 1
                out.append(total)
            at = hi
        return out

    def cut_at(self, text: str, budget: int) -> int:
        """The most leading characters whose tokens fit the budget."""
        counts = self.prefix_counts(text)
        if counts[-1] <= budget:
            return len(text)
        # counts are not quite monotone, so the last that fits is looked for from the right
        return max(k for k, c in enumerate(counts) if c <= budget)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows with equal or null
    ids each give their own row; an empty table gives an empty one.  Other
    columns are neither read nor returned.
    """

    def run(batches):
        gc.disable()  # the stores hold no cycles, and walking them takes a third of the time
        hold("token counts", counter.cache_clear)
        own = counter(vocabulary)
        for batch in batches:
            n_bytes, n_tokens = [], []
            texts = batch.column(1).to_pylist()
            for start in range(0, len(texts), 1000):
                cut = [own.segments(t) if t else [] for t in texts[start : start + 1000]]
                own.learn({s for segs in cut for s in segs})
                get = own.store.__getitem__
                n_tokens += [sum([get(s)[-1] for s in segs]) for segs in cut]
                n_bytes += [len(t.encode()) if t else 0 for t in texts[start : start + 1000]]
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), tokens, pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncate_to_budget(docs: DataFrame, vocabulary: str, budget: int, text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to the most characters within the token budget; nulls stay null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        own = counter(vocabulary)
        for batch in batches:
            cut = [t if t is None else t[: own.cut_at(t, budget)] for t in batch.column(at).to_pylist()]
            columns = [pa.array(cut, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def first_over(counts: list[int], budget: int) -> int:
    """Where a stored, monotone count list first exceeds the budget."""
    return bisect.bisect_right(counts, budget)
