"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces, by
the forward algorithm; a text's is the product over its words, as no piece
reaches over white space.  The probabilities are fitted by expectation
maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

import gc
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import hold, map_arrow
from concord.llm.vocabulary import PieceTable, PrefixForest, forests, prefix_hashes

#: Strings between blanks that a worker keeps, those of at most so many characters; the store is emptied beyond that.
KEPT, SHORT = 300_000, 64
#: Words that are summed at a time: their sums are kept for each byte and language.
ROWS = 15_000
#: Words up to this many bytes are summed as matrices, longer ones one by one in logarithms; the sums are the same.
WIDE = 48
#: Each byte's factor in the matrices, so that products over 48 bytes stay within doubles; it is taken out of the sums.
BYTE = 1e4
_LETTER = regex.compile(r"\p{L}")
_EDGE = regex.compile(r"^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$")
_MARK = "▁"


def vocabulary_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model that stand for text, single bytes last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    text = {model.id_to_piece(i).encode() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return sorted(p for p in text if len(p) > 1) + [bytes([b]) for b in range(256)]


def arcs(table: PieceTable, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(end, length, piece)`` of every piece inside a word, by end."""
    hashes = prefix_hashes(np.frombuffer(word, np.uint8)[None])
    found = []
    for length in table.lengths:
        if length <= len(word):
            piece = table.table.get((hashes[length:] - hashes[:-length] * table.powers[length])[:, 0])
            at = np.nonzero(piece >= 0)[0]
            found.append(np.stack([at + length, np.full(len(at), length), piece[at]]))
    ends, lengths, pieces = np.concatenate(found, 1).astype(np.int64)
    order = np.argsort(ends, kind="stable")
    return ends[order], lengths[order], pieces[order]


def log_forward(ends: np.ndarray, lengths: np.ndarray, logs: np.ndarray, size: int) -> np.ndarray:
    """Log sums over all segmentations of each prefix, ``[size + 1, languages]``; ``logs`` are those of the arcs' pieces."""
    alpha = np.full((size + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0
    firsts = np.searchsorted(ends, np.arange(size + 2))
    for i in range(1, size + 1):
        own = slice(firsts[i], firsts[i + 1])
        terms = alpha[i - lengths[own]] + logs[own]
        top = terms.max(0)
        alpha[i] = top + np.log(np.exp(terms - top).sum(0))
    return alpha


class PieceModel:
    """Log probability of words under every language."""

    def __init__(self, pieces: list[bytes], languages: list[str], probability: np.ndarray):
        self.pieces, self.languages, self.probability = pieces, languages, probability
        self.table = PieceTable((p, i) for i, p in enumerate(pieces))
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.store: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def __getstate__(self):
        return self.pieces, self.languages, self.probability

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.store, self.rows = {}, self.rows[:0].copy()

    def forward(self, forest: PrefixForest, scaled: np.ndarray) -> np.ndarray:
        """Log probability of each row's word, ``[rows, languages]``, each prefix summed once."""
        n, width = forest.matrix.shape
        k = scaled.shape[1]
        alpha = np.zeros((width + 1, n, k))
        alpha[0] = 1.0
        out = np.zeros((n, k))
        for i in range(1, width + 1):
            rows, node = forest.level(i)
            if not len(rows):
                break
            sums = np.zeros((len(rows), k))
            for length in self.table.lengths:
                if length > i:
                    break
                piece = self.table.ending(forest.hashes, i, length, rows)
                at = np.nonzero(piece >= 0)[0]
                if len(at):
                    sums[at] += alpha[i - length][rows[at]] * scaled[piece[at]]
            alpha[i] = sums[np.maximum(node, 0)]
            ends = forest.lengths == i
            out[ends] = np.log(alpha[i][ends]) - i * np.log(BYTE)
        return out

    def words(self, parts: list[str]) -> np.ndarray:
        """Log probabilities of strings between blanks; those without letters count nothing."""
        out = np.zeros((len(parts), len(self.languages)))
        pieces: dict[bytes, list[int]] = {}
        for at, part in enumerate(parts):
            if raw := word_bytes(part):
                pieces.setdefault(raw, []).append(at)
        scaled = self.probability * BYTE ** self.sizes[:, None]
        for own, forest in forests(list(pieces), (10, 16, 24, WIDE), chunk=ROWS):
            scores = self.forward(forest, scaled)
            spots = [pieces[w] for w in own]
            np.add.at(out, np.concatenate(spots), np.repeat(scores, [len(x) for x in spots], axis=0))
        logs = np.log(self.probability)
        for raw, spots in pieces.items():
            if len(raw) > WIDE:
                ends, lengths, own = arcs(self.table, raw)
                out[spots] += log_forward(ends, lengths, logs[own], len(raw))[-1]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Summed log probability of each text under each language."""
        cut = [t.split() if t else [] for t in texts]
        new = {p for own in cut for p in own}
        # long strings are rarely met again: they are not kept
        long = [p for p in new if len(p) > SHORT]
        if len(self.store) + len(new) > KEPT:
            self.forget()
        fresh = list(new - self.store.keys() - set(long))
        self.store.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
        self.rows = np.concatenate([self.rows, self.words(fresh)])
        rows, get = self.rows, self.store.__getitem__
        if long:
            own = dict(zip(long, range(len(rows), len(rows) + len(long)), strict=True))
            rows = np.concatenate([rows, self.words(long)])
            get = lambda p: own[p] if p in own else self.store[p]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((get(p) for parts in cut for p in parts), np.int64, int(sizes.sum()))
        total = np.concatenate([np.zeros((1, len(self.languages))), rows[flat].cumsum(0)])
        ends = sizes.cumsum()
        return total[ends] - total[ends - sizes]


def word_bytes(part: str) -> bytes:
    """The lower-cased word of a string between blanks, marked at its start; empty without a letter."""
    word = part.lower() if part.isalpha() else _EDGE.sub("", part.lower())
    return (_MARK + word).encode() if word and (word.isalpha() or _LETTER.search(word)) else b""


def fit(labelled: list[tuple[str, str]], pieces: list[bytes], rounds: int = 4, smoothing: float = 0.05) -> PieceModel:
    """Piece probabilities from ``(text, language)`` by expectation maximisation.

    Expected counts come from a forward and a backward pass over each distinct
    word; every piece keeps ``smoothing`` counts, so no text has probability 0.
    """
    languages = sorted({lang for _, lang in labelled})
    counts = {lang: Counter() for lang in languages}
    for text, lang in labelled:
        counts[lang].update(w for part in text.split() if (w := word_bytes(part)))
    sizes = np.array([len(p) for p in pieces], float)
    start = np.exp(-1.5 * sizes)
    probability = np.repeat((start / start.sum())[:, None], max(1, len(languages)), 1)
    model = PieceModel(pieces, languages, probability)
    for _ in range(rounds):
        expected = np.full_like(probability, smoothing)
        for k, lang in enumerate(languages):
            own = model.probability[:, k]
            for words, forest in forests(list(counts[lang]), (10, 16, 24, WIDE)):
                _expect(model.table, forest, own * BYTE**sizes, np.array([counts[lang][w] for w in words], float), expected[:, k])
            for word, n in counts[lang].items():
                if len(word) > WIDE:
                    _expect_long(model.table, word, np.log(own), n, expected[:, k])
        model.probability = expected / expected.sum(0)
    return model


def _expect(table: PieceTable, forest: PrefixForest, p: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
    n, width = forest.matrix.shape
    found, alpha, beta = [], np.zeros((width + 1, n)), np.zeros((width + 1, n))
    alpha[0] = 1
    for i in range(1, width + 1):
        rows = np.nonzero(forest.lengths >= i)[0]
        for length in table.lengths:
            if length > i:
                break
            piece = table.ending(forest.hashes, i, length, rows)
            at = np.nonzero(piece >= 0)[0]
            if len(at):
                found.append((i, length, rows[at], piece[at]))
                alpha[i][rows[at]] += alpha[i - length][rows[at]] * p[piece[at]]
    beta[forest.lengths, np.arange(n)] = 1
    total = alpha[forest.lengths, np.arange(n)]
    for i, length, rows, piece in reversed(found):
        beta[i - length][rows] += beta[i][rows] * p[piece]
    for i, length, rows, piece in found:
        np.add.at(into, piece, weight[rows] * alpha[i - length][rows] * p[piece] * beta[i][rows] / total[rows])


def _expect_long(table: PieceTable, word: bytes, log_p: np.ndarray, weight: float, into: np.ndarray) -> None:
    ends, lengths, pieces = arcs(table, word)
    logs, size = log_p[pieces][:, None], len(word)
    alpha = log_forward(ends, lengths, logs, size)[:, 0]
    # the word from its end: an arc that begins at b ends, so seen, at size - b
    turned = np.argsort(size - ends + lengths, kind="stable")
    beta = log_forward((size - ends + lengths)[turned], lengths[turned], logs[turned], size)[::-1, 0]
    np.add.at(into, pieces, weight * np.exp(alpha[ends - lengths] + logs[:, 0] + beta[ends] - alpha[-1]))


def learnable(id_col: str = "doc_id"):
    """Rows a model may learn from: crc32 of the id as text leaves no remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, vocabulary: str, per_language: int = 200, longest: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PieceModel | None:
    """Fit on about ``per_language`` labelled documents of each language.

    The documented bound: documents are taken where a hash of the id falls
    under ``per_language`` divided by the language's count, and only texts of
    at most ``longest`` characters.  Rows with a null text or language are not
    used, a null id may be learned from, and repeated rows are drawn together;
    with no labelled row at all, or an empty table, the result is None.
    """
    own = docs.where(learnable(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = {r["l"]: r["n"] for r in own.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.coalesce(*(F.when(F.col("l") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(sizes.items())))
    luck = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit("")), F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    rows = own.where((luck < share) & F.col("t").isNotNull() & (F.length("t") <= longest)).select("t", "l").collect()
    labelled = [(r["t"], r["l"]) for r in rows if _LETTER.search(r["t"])]
    return fit(sorted(labelled), vocabulary_pieces(vocabulary)) if labelled else None


def identify(docs: DataFrame, model: PieceModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` after its columns.

    ``und`` with score 0 where the text is null, empty or has no letter, or
    nothing was learned.  The score is the probability of the language given
    the text, all languages being equally likely before; of equally likely
    languages the first by name is taken.  Words of any length are summed
    whole, also in scripts without blanks.  Every row is kept, repeated ones
    too, and those with a null id; only the text decides.  Columns named
    ``lang_pred`` or ``score`` are replaced, all others stay as they are; an
    empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text_col)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # some tens of thousands of pieces for each language

    def run(batches):
        gc.disable()
        own = shipped.value
        if own is not None:
            hold(f"language {id(own)}", own.forget)
        for batch in batches:
            texts, langs, scores = batch.column(at).to_pylist(), [], []
            for start in range(0, len(texts), 1000):
                part = texts[start : start + 1000]
                if own is None:
                    langs += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                logs = own.score(part)
                best = logs.argmax(1)
                odds = np.exp(logs - logs.max(1, keepdims=True))
                sure = odds.max(1) / odds.sum(1)
                for text, b, s in zip(part, best.tolist(), sure.tolist(), strict=True):
                    known = bool(text) and _LETTER.search(text) is not None
                    langs.append(own.languages[b] if known else "und")
                    scores.append(s if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return map_arrow(docs.select(*(f"`{c}`" for c in names)), run, ", ".join([*kinds, "lang_pred string", "score double"]))
