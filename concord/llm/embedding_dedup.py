"""Near-duplicate embeddings by product quantisation with exact reranking.

Coarse centroids give inverted lists; residuals are coded by subspace.  A link
is at most the link radius long, and where its ends lie in two lists it crosses
the bisector between their centroids: the ends' distances from the bisector add
up to the radius at most, so one of them is at most half of it.  A vector
therefore probes each list whose bisector is within half the radius, and every
link is found from one of its ends at least; where only one end finds it, it is
counted for both.  Asymmetric table lookups give distances to the coded
members; those within the radius plus the member's coding error are reranked by
exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import Scratch, connected_components, discard
from concord.llm.simhash import spanning

#: The index is fitted on about so many different vectors for each list, at least and at most so many in all.
PER_LIST, SAMPLE, MOST_SAMPLE = 8, 8192, 131_072
#: Members of a list that one task compares, and queries it takes at a time.
BLOCK, CHUNK = 2048, 256


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, parts: int = 8, codes: int = 64, rounds: int = 6, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = -(-sample.shape[1] // parts) * parts
        sample = np.pad(sample, ((0, 0), (0, self.width - sample.shape[1])))
        self.centroids = two_levels(sample, lists, rounds, rng)
        residual = sample - self.centroids[nearest(sample, self.centroids)]
        step = self.width // parts
        self.books = [kmeans(residual[:, k : k + step], codes, rounds, rng) for k in range(0, self.width, step)]
        self.step = step

    def place(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and which lists have a bisector with it within ``reach``; its own is among them."""
        square = (x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        home = square.argmin(1)
        own, at = np.unique(home, return_inverse=True)
        between = (self.centroids[own] ** 2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * self.centroids[own] @ self.centroids.T
        between = np.sqrt(np.maximum(between, 1e-30))[at]
        probes = (square - square[np.arange(len(home)), home][:, None]) <= 2 * between * reach
        probes[np.arange(len(home)), home] = True
        return home, probes

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each residual and its decoded form."""
        codes = np.stack([nearest(residual[:, k * self.step : (k + 1) * self.step], b) for k, b in enumerate(self.books)], 1)
        decoded = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((residual - decoded) ** 2).sum(1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, centroids: np.ndarray | None = None) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centroids = x[rng.choice(len(x), k, replace=False)].copy() if centroids is None else centroids[:k].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def two_levels(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Some ``k`` centroids: clusters, split again by their sizes, and settled together once."""
    first = kmeans(x, math.isqrt(k), rounds, rng)
    own = nearest(x, first)
    parts = [x[own == j] for j in range(len(first))]
    centroids = np.concatenate([kmeans(part, max(1, round(k * len(part) / len(x))), rounds, rng) for part in parts if len(part)])
    return kmeans(x, len(centroids), 1, rng, centroids)


def units(column: pa.Array, kind: str, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a binary column as rows, filled with 0 to the width or the longest, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets) // np.dtype(kind).itemsize
    width = max(width, int(sizes.max(initial=0)))
    if len(column) and (sizes == sizes[0]).all():
        own = np.ascontiguousarray(data).view(kind).reshape(len(column), -1).astype(np.float64)
        x = np.pad(own, ((0, 0), (0, width - own.shape[1])))
    else:
        x = np.zeros((len(column), width))
        flat, starts = np.ascontiguousarray(data).view(kind), np.cumsum(sizes) - sizes
        for k, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            x[k, :n] = flat[at : at + n]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], sizes


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """The rows cut or filled to a width."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys, raws = [], []
            for v in batch.column(1).to_pylist():
                raw = None
                if v and None not in v:
                    x = np.asarray(v, np.float64) + 0.0
                    peak = np.abs(x).max()
                    if np.isfinite(peak) and peak > 0:
                        # far from 1, squares over- or underflow
                        raw = (x / peak if not 1e-100 < peak < 1e100 else x).astype(kind).tobytes()
                raws.append(raw)
                keys.append(raw and xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["id", "key", "raw"])

    ids = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInArrow(run, f"id {ids}, key binary, raw binary")


def near_embeddings(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row.

    Rows link at a cosine of at least ``threshold``, in double precision.
    Vectors that are null, empty, zero, or hold null or non-finite numbers link
    with nothing, and vectors of different lengths do not link.  Equal vectors
    are one node that counts as many rows, so copies are never paired.  A row
    with a null id takes part; it is kept only where no other row of its
    component has an id.  Repeated ids are rows of their own.  Other columns
    are neither read nor returned; an empty table gives an empty one.

    The index has about twice the square root of the different vectors as
    lists, fitted on a sample of ``PER_LIST`` vectors a list (``SAMPLE`` to
    ``MOST_SAMPLE`` in all); beyond that lists grow longer, and are compared by
    blocks.  Every vector is indexed, and every link is found.
    """
    scratch = Scratch()
    kind = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    keyed = scratch.write(_keyed(vectors, id_col, vector_col, kind), "vectors")
    classes = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("low"), F.first("raw").alias("raw"))
    # numbered once, as written: each different vector is a node of its own
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    if not n:
        return keyed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    lists = 2 * math.isqrt(n) + 1
    wanted = min(MOST_SAMPLE, max(SAMPLE, PER_LIST * lists))
    share = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < max(1, math.ceil(1_000_003 * min(1.0, wanted / n)))
    drawn = [bytes(r["raw"]) for r in classes.where(share).select("raw").collect()] or [bytes(classes.select("raw").first()["raw"])]
    index = Quantiser(units(pa.array(drawn, pa.binary()), kind)[0], lists=min(lists, max(1, len(drawn) // 2)))
    radius = math.sqrt(2 - 2 * threshold) + 1e-9
    shipped = vectors.sparkSession.sparkContext.broadcast(index)  # centroids, fewer than half the bounded sample, and 8 code books of 64

    def assign(batches):
        own = shipped.value
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                x = fitted(units(part.column("raw"), kind)[0], own.width)
                # what a longer vector has beyond the index's width adds to no distance below
                home, probes = own.place(x, radius / 2 + 1e-9)
                codes, error = own.encode(x - own.centroids[home])
                bits = np.packbits(probes, axis=1)
                members = [c.tobytes() for c in codes], [b.tobytes() for b in bits]
                row, at = np.nonzero(probes)
                for rows, lists, role in ((np.arange(len(home)), home, 0), (row, at, 1)):
                    take = part.take(pa.array(rows))
                    empty = pa.nulls(len(rows), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists.astype(np.int32)), pa.array(np.full(len(rows), role, np.int32)), take.column("node"), take.column("m"), take.column("raw"), empty if role else pa.array(members[0], pa.binary()), empty if role else pa.array(members[1], pa.binary()), pa.array(error[rows]), pa.array(home[rows].astype(np.int32))],
                        names=["list", "role", "node", "m", "raw", "codes", "probes", "error", "home"],
                    )

    probed = classes.select("node", "m", "raw").mapInArrow(assign, "list int, role int, node long, m long, raw binary, codes binary, probes binary, error double, home int")
    probed = scratch.write(probed, "probes")
    # a row for each list
    sizes = probed.where("role = 0").groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = probed.join(F.broadcast(sizes), "list")
    each = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("block", F.explode(each)).drop("blocks").repartition("list", "block").sortWithinPartitions("list", "block", "role", "node")

    def compare(batches):
        own = shipped.value

        def prepare(parts: list) -> dict:
            node, m, error, sizes, codes, probes = (np.concatenate([p[k] for p in parts]) for k in ("node", "m", "error", "sizes", "codes", "probes"))
            width = max(p["x"].shape[1] for p in parts)
            return {"node": node, "m": m, "error": error, "sizes": sizes, "codes": codes, "probes": probes, "x": np.concatenate([fitted(p["x"], width) for p in parts])}

        def answer(data: dict, centroid: np.ndarray, q: dict) -> pa.RecordBatch:
            x, node, m, home = q["x"], q["node"], q["m"], q["home"]
            residual = fitted(x, own.width) - centroid
            near = np.zeros((len(x), len(data["node"])))
            for k, book in enumerate(own.books):
                part = residual[:, k * own.step : (k + 1) * own.step]
                table = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
                near += np.take(table, data["codes"][:, k], axis=1)
            reach = (radius + data["error"] + 1e-6) ** 2
            a, b = np.nonzero(near <= reach)
            width = max(data["x"].shape[1], x.shape[1])
            wide, other = fitted(x, width), fitted(data["x"], width)
            good = np.zeros(len(a), bool)
            for lo in range(0, len(a), 1 << 16):
                i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                good[lo : lo + len(i)] = (np.einsum("ij,ij->i", wide[i], other[j]) >= threshold) & (q["sizes"][i] == data["sizes"][j]) & (node[i] != data["node"][j])
            a, b = a[good], b[good]
            # a member that probes the query's list finds the link itself
            alone = (data["probes"][b, home[a] >> 3] >> (7 - (home[a] & 7)) & 1) == 0
            links = np.bincount(a, weights=data["m"][b], minlength=len(x)).astype(np.int64)
            back = np.bincount(b[alone], weights=m[a[alone]], minlength=len(data["node"])).astype(np.int64)
            asked, told = np.nonzero(links)[0], np.nonzero(back)[0]
            n = len(data["node"])
            label = spanning(n + len(x), b, n + a)
            every = np.concatenate([data["node"], node])
            joined = np.nonzero(label != np.arange(len(label)))[0]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 1], [len(asked) + len(told), len(joined)]).astype(np.int32)), pa.array(np.concatenate([node[asked], data["node"][told], every[joined]])), pa.array(np.concatenate([links[asked], back[told], every[label[joined]]]))],
                names=["kind", "a", "b"],
            )

        group, parts, data = None, [], None
        for batch in batches:
            lists, block, role, node, m, error, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "block", "role", "node", "m", "error", "home"))
            cuts = np.nonzero((lists[1:] != lists[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1]))[0] + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if lo == hi:
                    continue
                if (lists[lo], block[lo]) != group:
                    group, parts, data = (lists[lo], block[lo]), [], None
                if role[lo] == 0:
                    x, sizes = units(batch.column("raw").slice(lo, hi - lo), kind)
                    codes, probes = (np.frombuffer(b"".join(batch.column(c).slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1) for c in ("codes", "probes"))
                    parts.append({"node": node[lo:hi], "m": m[lo:hi], "error": error[lo:hi], "x": x, "sizes": sizes, "codes": codes, "probes": probes})
                elif parts:
                    data = data or prepare(parts)
                    for at in range(lo, hi, CHUNK):
                        to = min(at + CHUNK, hi)
                        x, sizes = units(batch.column("raw").slice(at, to - at), kind)
                        yield answer(data, own.centroids[group[0]], {"x": x, "sizes": sizes, "node": node[at:to], "m": m[at:to], "home": home[at:to]})

    found = scratch.write(placed.mapInArrow(compare, "kind int, a long, b long"), "found")
    labels = connected_components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    owned = classes.select("key", "node", "m", "low").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    owned = owned.join(links, F.col("node") == F.col("a"), "left").select(F.col("key").alias("own"), "low", "component", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    owned = scratch.write(owned, "owned")
    lowest = scratch.write(owned.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    named = scratch.write(owned.join(lowest, "component").select("own", "n_links", "component_id"), "named")
    scratch.clear(keyed, named)
    discard(labels)
    joined = keyed.select("id", "key").join(named, F.col("key") == F.col("own"), "left")
    component = F.when(F.col("own").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
