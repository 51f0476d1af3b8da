"""SimHash fingerprints and their near-duplicate groups.

Fingerprints that differ in at most ``budget`` bits agree in all but ``budget``
of any number of blocks, so each is dealt once for each choice of the others;
more fingerprints take more and smaller blocks, hence longer keys.  Within a
key's group a binary trie is joined with itself: pairs of nodes go down
together, differing bits add up, and a pair is dropped once they exceed the
budget, or where all rows below it are connected already.  Groups above ``HOT``
rows are dealt by pairs of parts.  A task gives a spanning forest of the links
it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import Scratch, connected_components, discard, free_names, hold

#: Rows that a key's group has on average at most, and rows above which one is dealt by pairs of parts.
GROUP, HOT = 65_536, 200_000
#: Rows a task joins at a time, and node pairs that it holds at a time.
ROWS, PAIRS = 100_000, 400_000
#: Links after which a task looks again at what is connected.
SETTLE = 200_000
#: Hot keys that are broadcast; more are joined by a shuffle.
FEW_KEYS = 10_000
#: Members of a candidate group that are compared in one task; larger groups are dealt by pairs of parts.
PART = 512


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    joined, one = b" ".join(own), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = sizes.cumsum() + np.arange(len(own))
    starts = ends - sizes
    k = min(words, len(own))
    return np.array([one(joined[a:b], seed) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """Of each array the bits set in over half its hashes; 0 for an empty one."""
    out = np.zeros(len(hashes), np.uint64)
    own = [k for k, h in enumerate(hashes) if len(h)]
    for lo in range(0, len(own), 64):
        part = own[lo : lo + 64]
        sizes = np.array([len(hashes[k]) for k in part])
        # a byte for each bit, eight in a word: 255 rows add up without a carry
        lanes = np.unpackbits(np.concatenate([hashes[k] for k in part]).view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        ends = sizes.cumsum()
        cuts = [np.arange(e - n, e, 255) for e, n in zip(ends, sizes, strict=True)]
        sums = np.add.reduceat(lanes, np.concatenate(cuts), axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
        firsts = np.cumsum([0, *(len(c) for c in cuts[:-1])])
        counts = np.add.reduceat(sums, firsts, axis=0)
        out[part] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of each shingle for each k > 0, by multiplying and folding."""
    if not k:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(text: str | None) -> bytes:
    """128 bits of the word sequence; zeros where there is no word."""
    words = (text or "").encode().lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else bytes(16)


def fingerprints(docs: DataFrame, words: int = 3, parts: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """``(id_col, sig, text_hash, first)``; with ``distinct``, repeats of a shingle do not count.

    ``sig`` joins ``parts`` little-endian 64-bit fingerprints, ``first`` is the
    first of them, and ``text_hash`` a 128-bit hash of the word sequence.

    A null or empty text, or one without words, has fingerprint 0 and a text
    hash of zeros.  Every row gives a row, whatever its id.
    """

    def run(batches):
        hold("fingerprints", lambda: None)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = part.column(1).to_pylist()
                hashes = [np.unique(h) if distinct else h for h in (shingle_hashes(t, words) for t in texts)]
                sig = np.stack([majorities([mixed(h, k) for h in hashes]) for k in range(parts)], 1)
                whole = list(map(word_hash, texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(whole, pa.binary()), pa.array(sig[:, 0].view(np.int64))], names=[id_col, "sig", "text_hash", "first"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, sig binary, text_hash binary, first long")


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest connected row of each of ``n`` rows."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def trie_join(values: np.ndarray, frames: list[tuple[int, np.ndarray]], budget: int, near: Callable | None = None, settled: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within the budget, below pairs of trie nodes.

    ``values`` are sorted within each node.  A frame is a bit position and an
    array ``[5, pairs]``: both nodes' row ranges, and bits that differ above.
    ``near(a, b)`` may reject row pairs further, ``settled(lo1, hi1, lo2, hi2)``
    node pairs that need no look.
    """
    ones: dict[int, np.ndarray] = {}
    stack = list(frames)
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > PAIRS:
            stack += [(bit, pairs[:, k : k + PAIRS]) for k in range(0, pairs.shape[1], PAIRS)]
            continue
        if settled is not None:
            pairs = pairs[:, ~settled(*pairs[:4])]
        lo1, hi1, lo2, hi2, differ = pairs
        n1, n2, same = hi1 - lo1, hi2 - lo2, lo1 == lo2
        small = (n1 * n2 <= 36) | (bit < 0)
        if small.any():
            rows = np.nonzero(small)[0]
            each = (n1 * n2)[rows]
            # a pair of nodes without bits left can be large: its left rows are taken some at a time
            steps = np.maximum(1, (1 << 20) // np.maximum(n2[rows], 1))
            for lo in range(0, len(rows), 1 << 16):
                own, size = rows[lo : lo + (1 << 16)], each[lo : lo + (1 << 16)]
                large = size > 1 << 20
                yield from _checked(values, lo1, lo2, n2, same, own[~large], size[~large], budget, near)
                for at, step in zip(own[large].tolist(), steps[lo : lo + (1 << 16)][large].tolist(), strict=True):
                    for first in range(int(lo1[at]), int(hi1[at]), step):
                        last = min(first + step, int(hi1[at]))
                        if settled is not None and settled(*(np.array([x]) for x in (first, last, lo2[at], hi2[at])))[0]:
                            continue
                        a = np.repeat(np.arange(first, last), n2[at])
                        b = np.tile(np.arange(lo2[at], hi2[at]), len(a) // int(n2[at]))
                        yield from _links(values, a, b, a < b if same[at] else slice(None), budget, near)
            keep = ~small
            lo1, hi1, lo2, hi2, differ, same = lo1[keep], hi1[keep], lo2[keep], hi2[keep], differ[keep], same[keep]
        if not len(lo1):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64).cumsum()])
        count = ones[bit]
        m1, m2 = hi1 - (count[hi1] - count[lo1]), hi2 - (count[hi2] - count[lo2])
        below = [(lo1, m1, lo2, m2, differ), (m1, hi1, m2, hi2, differ), (lo1, m1, m2, hi2, differ + 1)]
        cross = ~same
        below.append((m1[cross], hi1[cross], lo2[cross], m2[cross], differ[cross] + 1))
        down = np.concatenate([np.stack(x) for x in below], 1)
        lone = (down[0] == down[2]) & (down[1] - down[0] < 2)
        down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= budget) & ~lone]
        if down.shape[1]:
            stack.append((bit - 1, down))


def _checked(values, lo1, lo2, n2, same, own, size, budget, near):
    """Linked row pairs below small pairs of nodes."""
    ends = size.cumsum()
    for lo, hi in _runs(ends, 1 << 21):
        part, n = own[lo:hi], size[lo:hi]
        at = np.repeat(part, n)
        step = np.arange(len(at)) - np.repeat(n.cumsum() - n, n)
        a, b = lo1[at] + step // n2[at], lo2[at] + step % n2[at]
        yield from _links(values, a, b, ~same[at] | (a < b), budget, near)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to some ``most``."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _links(values, a, b, wanted, budget, near):
    a, b = a[wanted], b[wanted]
    good = np.bitwise_count(values[a] ^ values[b]) <= budget
    a, b = a[good], b[good]
    if near is not None and len(a):
        good = near(a, b)
        a, b = a[good], b[good]
    if len(a):
        yield a, b


def join_groups(key: np.ndarray, cell: np.ndarray, part: np.ndarray, values: np.ndarray, bit: int, budget: int, near: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each (key, cell) group of rows sorted by part and value.

    A cell of two parts has pairs across them only.
    """
    n = len(key)
    starts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))[0] + 1])
    ends = np.append(starts[1:], n)
    # a negative cell is a whole group; others name their two parts
    two = (cell[starts] >= 0) & (cell[starts] >> 20 != cell[starts] & (1 << 20) - 1)
    first = np.concatenate([[0], (part == np.repeat(part[starts], ends - starts)).astype(np.int64).cumsum()])
    mid = np.where(two, starts + first[ends] - first[starts], ends)
    useful = ~two | (mid < ends)
    frame = np.stack([starts, mid, np.where(two, mid, starts), ends, np.zeros(len(starts), np.int64)])[:, useful]
    label = np.arange(n)
    change = np.arange(n)

    def settled(lo1, hi1, lo2, hi2):
        return (label[lo1] == label[lo2]) & (change[hi1 - 1] == change[lo1]) & (change[hi2 - 1] == change[lo2])

    def apart(a, b):
        open_ = label[a] != label[b]
        if near is not None:
            open_[open_] = near(a[open_], b[open_])
        return open_

    found_a, found_b, held = [], [], 0

    def connect():
        rows = np.nonzero(label != np.arange(n))[0]
        label[:] = spanning(n, np.concatenate([rows, *found_a]), np.concatenate([label[rows], *found_b]))
        change[1:] = (label[1:] != label[:-1]).cumsum()
        change[:1] = 0
        found_a.clear()
        found_b.clear()

    for a, b in trie_join(values, [(bit, frame)] if frame.shape[1] else [], budget, apart, settled):
        found_a.append(a)
        found_b.append(b)
        held += len(a)
        if held > SETTLE:
            connect()
            held = 0
    connect()
    rows = np.nonzero(label != np.arange(n))[0]
    return rows, label[rows]


def block_sizes(n: int, width: int, budget: int) -> list[int]:
    """Bits of the blocks that ``n`` fingerprints are dealt by: the fewest whose keys leave ``GROUP`` rows each."""
    for count in range(budget + 1, width // 2 + 1):
        sizes = [width // count + (k < width % count) for k in range(count)]
        if n >> sum(sorted(sizes)[: count - budget]) <= GROUP:
            break
    return sizes


def deal(nodes: DataFrame, sizes: list[int], width: int, tables: int, budget: int, carry: int | None = None, carried: bool = False) -> DataFrame:
    """``(key, node, value)``, a row for each table and choice of blocks, the chosen ones first in ``value``; with ``carried`` also ``sig``."""
    lows = [width - sum(sizes[: k + 1]) for k in range(len(sizes))]
    choices = list(combinations(range(len(sizes)), len(sizes) - budget))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw = batch.column(1).to_pylist()
            short = [pa.array([x[:carry] for x in raw], pa.binary())] if carried else []
            sig = np.frombuffer(b"".join(raw), f"<u{width // 8}").reshape(len(batch), -1)[:, :tables].astype(np.uint64)
            for t in range(tables):
                blocks = [(sig[:, t] >> np.uint64(low)) & np.uint64((1 << size) - 1) for low, size in zip(lows, sizes, strict=True)]
                for c, chosen in enumerate(choices):
                    value, key = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.int64)
                    for k in (*chosen, *(k for k in range(len(sizes)) if k not in chosen)):
                        value = value << np.uint64(sizes[k]) | blocks[k]
                        if k == chosen[-1]:
                            key = (value + np.uint64((t * len(choices) + c) << 44)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), pa.array(value.view(np.int64)), *short], names=["key", "node", "value", *["sig"] * carried])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long, value long" + ", sig binary" * carried)


def links(nodes: DataFrame, width: int, tables: int, budget: int = 3, sig_budget: int | None = None, carry: int | None = None) -> DataFrame:
    """``(src, dst)`` edges that connect nodes with a fingerprint within the budget.

    ``nodes`` has ``node`` (long, unique) and ``sig``; table ``t`` is bits
    ``[t * width, (t + 1) * width)`` of the signature.  With ``sig_budget`` the
    whole signatures, or their first ``carry`` bytes, must also differ in at
    most so many bits.
    """
    carried = sig_budget is not None
    sizes = block_sizes(nodes.count(), width, budget)
    dealt = deal(nodes, sizes, width, tables, budget, carry, carried)
    choices = list(combinations(range(len(sizes)), len(sizes) - budget))
    # the first bit below the key differs with the choice, so each is joined at its own
    below = np.array([width - sum(sizes[k] for k in chosen) - 1 for chosen in choices])

    def join(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(table: pa.Table) -> pa.RecordBatch:
            key, cell, part, value = (table.column(c).to_numpy() for c in ("key", "cell", "part", "value"))
            near = None
            if carried:
                whole = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(key), -1)

                def near(a, b):
                    out = np.zeros(len(a), bool)
                    for lo in range(0, len(a), 1 << 18):
                        i, j = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
                        out[lo : lo + len(i)] = np.bitwise_count(whole[i] ^ whole[j]).sum(1) <= sig_budget
                    return out

            bits, pairs = below[(key >> 44) % len(choices)], []
            for bit in np.unique(bits):
                own = np.nonzero(bits == bit)[0]
                mine = (lambda a, b, own=own: near(own[a], own[b])) if near else None
                a, b = join_groups(key[own], cell[own], part[own], value[own].view(np.uint64), int(bit), budget, mine)
                pairs.append((own[a], own[b]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            node = table.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["src", "dst"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= ROWS:
                table = pa.Table.from_batches(held)
                key, cell = table.column("key").to_numpy(), table.column("cell").to_numpy()
                ends = np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))[0]
                if len(ends):  # the last group may go on in the next batch
                    whole = int(ends[-1]) + 1
                    yield work(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    rows = len(table) - whole
        if rows:
            yield work(pa.Table.from_batches(held))

    counted = deal(nodes, sizes, width, tables, budget).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    scratch = Scratch()
    hot = scratch.write(counted.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "hot")
    many = hot.count()
    if many:
        sized = dealt.join(F.broadcast(hot) if many <= FEW_KEYS else hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: (F.least("part", q) * (1 << 20) + F.greatest("part", q)).cast("long"))
        placed = sized.withColumn("cell", F.explode(F.coalesce(pairs, F.array(F.lit(-1).cast("long"))))).drop("parts").repartition("key", "cell")
    else:
        placed = dealt.withColumns({"part": F.lit(0), "cell": F.lit(-1).cast("long")}).repartition("key")
        scratch.clear()
    order = [F.col("key"), F.col("cell"), F.col("part"), F.shiftrightunsigned("value", 1), F.col("value")]
    return placed.select("key", "cell", "part", "node", "value", *["sig"] * carried).sortWithinPartitions(*order).mapInArrow(join, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row.

    Fingerprints of 64 bits link at ``budget`` or fewer differing bits; the
    component is the smallest id reachable, itself included.  Texts without
    words, and null texts, have fingerprint 0 and link like any other.  A row
    with a null id takes part; a component of null ids alone has a null id.
    Equal rows give equal rows; an empty table gives an empty one.
    """
    scratch = Scratch()
    prints = scratch.write(fingerprints(docs, words, 1, id_col, text_col).select(F.col(id_col).alias("id"), F.col("first").alias("node"), "sig"), "prints")
    nodes = scratch.write(prints.groupBy("node").agg(F.first("sig").alias("sig"), F.min("id").alias("low")), "nodes")
    labels = connected_components(links(nodes, 64, 1, budget))
    owned = scratch.write(nodes.select("node", "low").join(labels, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component")), "owned")
    lowest = scratch.write(owned.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    named = scratch.write(owned.select(F.col("node").alias("own"), "component").join(lowest, "component").select("own", "component_id"), "named")
    scratch.clear(prints, named)
    discard(labels)
    return prints.join(named, F.col("node") == F.col("own")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def exact_links(sets: list[np.ndarray], sigs: np.ndarray, side: np.ndarray, least: float, sig_budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose sets have a Jaccard similarity of at least ``least``.

    ``side`` is 0 or 1; where both occur, only pairs across are linked.  Pairs
    whose signatures differ in over ``sig_budget`` bits are not compared.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    both = side.any() and not side.all()
    found_a, found_b = [], []
    rows = np.nonzero(side == 0)[0] if both else np.arange(n)
    for lo in range(0, len(rows), 64):
        own = rows[lo : lo + 64]
        differ = np.bitwise_count(sigs[own][:, None] ^ sigs).sum(2, dtype=np.int64)
        good = (differ <= sig_budget) & (np.minimum(sizes[own][:, None], sizes) >= least * np.maximum(sizes[own][:, None], sizes) - 1e-9) & (sizes > 0)
        good &= (side == 1) if both else np.arange(n) > own[:, None]
        i, j = np.nonzero(good)
        found_a.append(np.stack([own[i], j, differ[i, j]]))
    a, b, differ = np.concatenate(found_a, 1)
    order = np.argsort(differ, kind="stable")
    a, b = a[order], b[order]
    label, found_a = np.arange(n), []
    while len(a):
        # of each row the nearest open pair; what this joins needs no comparison any more
        first = np.unique(a, return_index=True)[1]
        hit = np.zeros(len(first), bool)
        for k, (i, j) in enumerate(zip(a[first].tolist(), b[first].tolist(), strict=True)):
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            hit[k] = shared >= least * (sizes[i] + sizes[j] - shared) - 1e-9
        found_a.append(a[first[hit]])
        found_b.append(b[first[hit]])
        label = spanning(n, np.concatenate(found_a), np.concatenate(found_b))
        open_ = label[a] != label[b]
        open_[first] = False
        a, b = a[open_], b[open_]
    rows = np.nonzero(label != np.arange(n))[0]
    return rows, label[rows]


def confirmed(docs: DataFrame, nodes: DataFrame, groups: DataFrame, scratch: Scratch, words: int, least: float, sig_budget: int, id_col: str, text_col: str) -> DataFrame:
    """``(src, dst)`` edges that connect nodes of a group by exact Jaccard similarities of their shingle sets.

    ``groups`` has ``node`` and ``component``.  A group of more than ``PART``
    nodes is dealt by pairs of its parts.
    """
    sized = scratch.write(groups.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "sized")
    members = groups.join(sized, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = scratch.write(nodes.join(members, "node"), "members")
    texts = _with_word_hash(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")), "text", "h")
    rows = texts.join(members, (F.col("h") == F.col("text_hash")) & F.col("i").eqNullSafe(F.col("low")))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("x"), F.greatest("part", q).alias("y"))))
    cells = rows.select("component", "node", "sig", "part", "text", pairs.alias("c")).select("component", "c.x", "c.y", "part", "node", "sig", "text")

    def compare(batches):
        hold("near copies", lambda: None)
        group, held = None, {}

        def answer() -> pa.RecordBatch:
            part, sigs, sets = zip(*held.values(), strict=True)
            node = np.fromiter(held, np.int64, len(held))
            sigs = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(held), -1)
            a, b = exact_links(list(sets), sigs, (np.array(part) != group[1]).astype(np.int64), least, sig_budget) if group[1] == group[2] or len(set(part)) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(node[a] if len(a) else [], pa.int64()), pa.array(node[b] if len(b) else [], pa.int64())], names=["src", "dst"])

        for batch in batches:
            for component, x, y, part, node, sig, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, x, y) != group:
                    if len(held) > 1:
                        yield answer()
                    group, held = (component, x, y), {}
                if node not in held:
                    held[node] = (part, sig, np.unique(shingle_hashes(text, words)))
        if len(held) > 1:
            yield answer()

    dealt = cells.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    return dealt.mapInArrow(compare, "src long, dst long")


def deduplicate(docs: DataFrame, words: int = 5, parts: int = 10, tables: int = 20, sig_budget: int = 152, carry_budget: int = 50, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id.

    Near copies have a Jaccard similarity of at least ``least`` between their
    sets of five-word shingles (a shorter text is one shingle).  For
    similarities of about 0.8, 64 bits within a budget of three are too few:
    copies that similar differ in some nine.  So ``parts`` fingerprints are
    joined to a signature; the trie join runs over ``tables`` tables of 32 of
    its bits, with at most ``carry_budget`` of its first 192 bits differing, and gives candidate groups.  In them
    pairs whose signatures differ in at most ``sig_budget`` bits of 640 are
    confirmed by their exact similarity: only those link, and a link is missed
    only where the signatures miss it.

    Texts with equal word sequences are one node; so are all texts without
    words, null ones among them.  Texts of any length are compared whole.  A
    null id counts as the largest; of texts that share the smallest id the one
    with the smallest hash stays, and of equal rows one, whatever their other
    columns hold.  Other columns keep their names and values; an empty table
    gives an empty one.
    """
    scratch = Scratch()
    prints = scratch.write(fingerprints(docs, words, parts, id_col, text_col, distinct=True).select(F.col(id_col).alias("id"), "sig", "text_hash"), "prints")
    low = F.min_by("id", F.coalesce(F.col("id"), F.lit((1 << 63) - 1)))
    # numbered once, as written: each distinct text is a node of its own
    distinct_texts = prints.groupBy("text_hash").agg(F.first("sig").alias("sig"), low.alias("low"))
    nodes = scratch.write(distinct_texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = connected_components(links(nodes, 32, tables, 3, carry_budget, 24))
    labels = connected_components(confirmed(docs, nodes, groups, scratch, words, least, sig_budget, id_col, text_col))
    owned = nodes.select("node", "text_hash", "low").join(labels, "node", "left").select("text_hash", "low", F.coalesce("component", "node").alias("component"))
    winner = F.min_by(F.struct("text_hash", "low"), F.struct(F.col("low").isNull(), "low", "text_hash"))
    h, n, i, c = free_names(docs, "h", "n", "i", "c")
    kept = owned.groupBy("component").agg(winner.alias("w")).select(F.col("w.text_hash").alias(n), F.col("w.low").alias(i))
    # rows equal in id and words: one of them stays
    copies = prints.groupBy(F.col("id").alias("ri"), F.col("text_hash").alias("rn")).agg(F.count("*").alias(c))
    kept = scratch.write(kept.join(copies, (F.col(n) == F.col("rn")) & F.col(i).eqNullSafe(F.col("ri"))).select(n, i, c), "kept")
    scratch.clear(kept)
    discard(groups)
    discard(labels)
    keyed = _with_word_hash(docs, text_col, h)
    rows = keyed.join(kept, (F.col(h) == F.col(n)) & F.col(f"`{id_col}`").eqNullSafe(F.col(i)))
    names = [f"`{x}`" for x in docs.columns]
    single = rows.where(F.col(c) == 1).select(*names)
    several = rows.where(F.col(c) > 1).dropDuplicates([n]).select(*names)
    return single.union(several)


def _with_word_hash(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(word_hash, batch.column(at).to_pylist())), pa.binary())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{name}` binary")
