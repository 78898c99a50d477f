"""Operator 3, embedding near-dedup by an epsilon grid order join.

Vectors of one label link where their cosine (of the stored components, in double precision) is at least COSINE, which
for unit vectors is a distance of at most EPS. They are rotated to their principal axes (from the second moments of all
of them), and sorted by the cells of a grid of width EPS on the leading axes. The sorted sequence is dealt by range into
blocks of at most BLOCK vectors. Pairs of blocks whose boxes lie within EPS are found by joining the cells they span;
each such pair is joined by halving the sequences again and again and skipping halves whose boxes are too far apart.
A pair of blocks gives link counts and a spanning forest of its links, never the links themselves.

Equal vectors of a label are one entry with a multiplicity; n_links counts the copies. Vectors that are null, empty or
zero, or hold null or non-finite components, and vectors without a label link with nothing; so do vectors of different
lengths. Repeated rows, and rows that share a vec_id, are vectors of their own. A null vec_id counts in others' n_links
and is no component's id unless the component has no other. Ties: vectors at a cosine of exactly COSINE link. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, connected_components, map_batches, materialize, read_table, tasks

COSINE = 0.93
BLOCK = 256
LEAF = 64
#: Axes of the grid's order, and of the boxes.
SORTED, BOXED = 4, 12
#: What rounding may add to a distance.
SLACK = 1e-5


def radius(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(entries: DataFrame, size: int) -> np.ndarray:
    """The eigenvectors (columns, largest first) of the second moments of all vectors of that size."""
    out = pa.schema([("at", pa.int64()), ("value", pa.float64())])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b["v"]))
                total += x.T @ x
        yield batch(out, np.arange(size * size), total.ravel())

    rows = map_batches(entries.filter(F.col("size") == size).select("v"), moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # size * size rows
    total = np.zeros(size * size)
    for r in rows:
        total[r["at"]] = r["value"]
    total = total.reshape(size, size)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


BLOCKS = pa.schema([("block", pa.int64()), ("grp", pa.string()), ("size", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("copies", pa.binary()), ("vectors", pa.binary())])
BLOCK_SQL = "block long, grp string, size int, low array<double>, high array<double>, k1 array<long>, k2 array<long>, copies binary, vectors binary"


def blocks(entries: DataFrame, axes: dict[int, np.ndarray], eps: float, real: type) -> DataFrame:
    """Runs of the grid order of each group (label and size), with their boxes on the leading axes. real: the type of
    the components. The k-th entry of a block has the id block * BLOCK + k from here on."""
    cells_of = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("grp", pa.string()), ("size", pa.int32()), ("v", pa.list_(pa.from_numpy_dtype(real))), ("n", pa.int64()), ("cells", pa.list_(pa.int32()))])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["size"].to_numpy()
            out: list = [None] * b.num_rows
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                c = np.floor(unit(matrix(b["v"].take(pa.array(at)))) @ axes[size][:, :SORTED] / eps).astype(np.int32)
                for k, row in zip(at.tolist(), c, strict=True):
                    out[k] = row
            yield batch(cells_of, b["k1"], b["k2"], b["grp"], b["size"], b["v"], b["n"], out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        name = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            x = np.array([r["v"] for r in held], real)
            turned = unit(x.astype(np.float64)) @ axes[held[0]["size"]][:, :BOXED]
            n = np.array([r["n"] for r in held], np.int64)
            return batch(BLOCKS, [name], [held[0]["grp"]], [held[0]["size"]], [turned.min(axis=0)], [turned.max(axis=0)], *([[r[k] for r in held]] for k in ("k1", "k2")), [n.tobytes()], [x.tobytes()])

        for b in batches:
            for r in b.to_pylist():
                if held and (held[0]["grp"] != r["grp"] or len(held) == BLOCK):
                    yield block()
                    name, held = name + 1, []
                held.append(r)
        if held:
            yield block()

    found = map_batches(entries, cells, f"k1 long, k2 long, grp string, size int, v array<{'float' if real is np.float32 else 'double'}>, n long, cells array<int>")
    ordered = found.repartitionByRange(tasks(entries.sparkSession), "grp", "cells", "k1", "k2").sortWithinPartitions("grp", "cells", "k1", "k2")
    return map_batches(ordered.drop("cells"), pack, BLOCK_SQL)


def near_blocks(found: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of blocks of a group, a <= b, whose boxes lie within eps."""
    span = lambda k, more: F.sequence(F.floor(F.get("low", F.lit(k)) / eps) - more, F.floor(F.get("high", F.lit(k)) / eps) + more)
    boxes = found.select("block", "grp", "low", "high")
    # cells of the first two axes; a vector of one axis has no second one
    second = lambda more: F.coalesce(span(1, more), F.array(F.lit(0).cast("long")))
    spread_out = lambda more: boxes.withColumn("c", F.explode(span(0, more))).withColumn("d", F.explode(second(more)))
    left = spread_out(0).select(F.col("block").alias("a"), "grp", "c", "d", F.col("low").alias("la"), F.col("high").alias("ha"))
    right = spread_out(1).select(F.col("block").alias("b"), "grp", "c", "d", F.col("low").alias("lb"), F.col("high").alias("hb"))
    gap = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps
    return left.join(right, ["grp", "c", "d"]).filter((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def joined(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, cosine: float, eps: float) -> np.ndarray:
    """Which rows of x and y have at least that cosine; rx and ry are their leading coordinates. Halves whose boxes are
    too far apart are skipped."""
    out = np.zeros((len(x), len(y)), bool)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)

    def go(a: int, b: int, c: int, d: int) -> None:
        gap = np.maximum(np.maximum(rx[a:b].min(axis=0) - ry[c:d].max(axis=0), ry[c:d].min(axis=0) - rx[a:b].max(axis=0)), 0)
        if gap @ gap > eps * eps:
            return
        if b - a <= LEAF and d - c <= LEAF:
            out[a:b, c:d] = x[a:b] @ y[c:d].T / (nx[a:b, None] * ny[None, c:d]) >= cosine
        elif b - a >= d - c:
            m = (a + b) // 2
            go(a, m, c, d)
            go(m, b, c, d)
        else:
            m = (c + d) // 2
            go(a, b, c, m)
            go(a, b, m, d)

    if len(x) and len(y):
        go(0, len(x), 0, len(y))
    return out


def forest(link: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges from each row to the smallest id reachable over the links among the rows (symmetric)."""
    order = np.argsort(ids, kind="stable")
    link, ids = link[order][:, order], ids[order]
    at = np.arange(len(ids))
    while True:
        low = np.where(link, at[None, :], len(ids)).min(axis=1)
        new = np.minimum(at, low)
        new = new[new]
        if (new == at).all():
            break
        at = new
    own = np.flatnonzero(at != np.arange(len(ids)))
    return ids[own].tolist(), ids[at[own]].tolist()


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def block_links(pairs: DataFrame, axes: dict[int, np.ndarray], cosine: float, eps: float, real: type) -> DataFrame:
    """Of pairs of blocks: (id, null, links to copies in the other block) and edges (a, b, null) of a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                size, one = r["size"], r["a"] == r["b"]
                x, y = (np.frombuffer(r[k], real).reshape(-1, size).astype(np.float64) for k in ("va", "vb"))
                (ia, ca), (ib, cb) = ((r[s] * BLOCK + np.arange(len(n)), n) for s in "ab" for n in [np.frombuffer(r[f"c{s}"], np.int64)])
                turn = axes[size][:, :BOXED]
                link = joined(x, y, unit(x) @ turn, unit(y) @ turn, cosine, eps)
                if one:
                    np.fill_diagonal(link, False)
                    link |= link.T
                    ids, whole, count = ia, link, link @ cb
                else:
                    ids = np.concatenate([ia, ib])
                    whole = np.zeros((len(ids), len(ids)), bool)
                    whole[: len(ia), len(ia) :], whole[len(ia) :, : len(ia)] = link, link.T
                    count = np.concatenate([link @ cb, link.T @ ca])
                some = np.flatnonzero(count)
                if len(some):
                    u, v = forest(whole[np.ix_(some, some)], ids[some])
                    yield batch(FOUND, [*ids[some].tolist(), *u], [*[None] * len(some), *v], [*count[some].tolist(), *[None] * len(u)])

    return map_batches(pairs, run, "a long, b long, n long")


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id of every row of vectors(vec_id, embedding, label). Components are those of array<float>
    as they are stored; any other numeric type is taken in double precision."""
    eps = radius(cosine)
    real, kind = (np.float32, "float") if dict(vectors.dtypes)["embedding"] == "array<float>" else (np.float64, "double")
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label").cast("string").alias("label"))
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # an entry is a label and a vector, known by 96 bits of their hashes: rows of one vec_id and different vectors stay apart
    rows = materialize(rows.select("vec_id", F.when(F.col("fine"), F.col("v")).alias("v"), F.size("v").alias("size"), F.concat_ws(":", F.size("v").cast("string"), "label").alias("grp"), F.when(F.col("fine"), F.xxhash64("label", "v")).alias("k1"), F.when(F.col("fine"), F.hash("v", "label").cast("long")).alias("k2")), "vectors")
    good = rows.filter("k1 is not null")
    entries = materialize(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.first("v").alias("v"), F.first("grp").alias("grp"), F.first("size").alias("size"), F.count("*").alias("n")), "entries")
    axes = {r["size"]: principal_axes(entries, r["size"]) for r in entries.select("size").distinct().collect()}  # as many rows as there are lengths of vectors
    found = materialize(blocks(entries.select("k1", "k2", "grp", "size", "v", "n"), axes, eps, real), "blocks")
    pairs = materialize(near_blocks(found, eps), "pairs")
    side = lambda s: found.select(F.col("block").alias(s), F.col("copies").alias(f"c{s}"), F.col("vectors").alias(f"v{s}"), *(["size"] if s == "a" else []))
    linked = materialize(block_links(pairs.join(side("a"), "a").join(side("b"), "b"), axes, cosine, eps, real), "links")
    counts = linked.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_other"))
    parts = connected_components(linked.filter("n is null").select("a", "b")).withColumnRenamed("node", "id")
    ids = found.select("block", F.posexplode(F.arrays_zip("k1", "k2"))).select((F.col("block") * BLOCK + F.col("pos")).alias("id"), "col.k1", "col.k2")
    named = ids.join(entries.select("k1", "k2", "least", "n"), ["k1", "k2"]).join(counts, "id", "left").join(parts, "id", "left")
    named = materialize(named.select("k1", "k2", "least", F.coalesce("component", "id").alias("part"), (F.coalesce("n_other", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    table = named.join(least, "part").select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "n_links", "component_id")
    out = good.join(table, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).select("vec_id", "n_links", "component_id")
    return out.unionByName(rows.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read_table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
