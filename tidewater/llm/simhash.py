"""Operator 9, SimHash near-dedup by multi-index hashing.

A fingerprint's 64 bits are two segments of 32. Two fingerprints that differ in at most RADIUS = 3 bits differ in at
most one bit of one segment at least, so every segment looks up the 33 values of the Hamming ball of radius 1 around
its own in the table of that segment, and whole distances decide among what is found. Documents of one fingerprint
are one entry there, so that copies cost nothing; links between fingerprints are contracted to components.

Very long texts are fingerprinted whole, CHUNK shingles at a time. Ties: a bit that is set in exactly half the shingles is
0. Nulls: a null text has no words, and so fingerprint zero, which links like any other. A null doc_id stays in the
result and is never a component's smallest id unless the component has no other. Empty tables give no rows; repeated
rows get the same component. Extra columns are ignored by fingerprints and kept by simhash_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, byte_texts, connected_components, map_batches, materialize, read_table, unused

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's word shingles (A-Z lower-cased); 0 without words."""
    words = text.lower().split()  # of bytes: only A-Z change, only \\x20 and \\x09-\\x0D split
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[len(words) - n :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


PRINTED = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("fp", pa.int64())])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(PRINTED, b["doc_id"], b["tid"], [fingerprint(t) for t in byte_texts(b["text"])])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, fp) of every document; tid is a hash of its text."""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text"), _prints, "doc_id long, tid long, fp long")


def links(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints differ in at most RADIUS bits, from entries(id, fp) with one row per
    fingerprint. A pair that both segments find comes twice. The join is a merge of two shuffles: Spark can't see that a probe
    becomes 66 rows, and would take them for small enough to send whole through the driver."""
    halves = lambda x: F.array(F.struct(F.lit(0).alias("seg"), (x.bitwiseAND(F.lit(0xFFFFFFFF))).alias("value")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned(x, 32).alias("value")))
    table = entries.select("id", "fp", F.explode(halves(F.col("fp"))).alias("h")).select(F.col("id").alias("b"), F.col("fp").alias("fb"), "h.seg", "h.value")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(32)))
    probes = entries.select("id", "fp", F.explode(halves(F.col("fp"))).alias("h")).select(F.col("id").alias("a"), F.col("fp").alias("fa"), "h.seg", "h.value", F.explode(flips).alias("flip"))
    probes = probes.select("a", "fa", "seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    return probes.join(table.hint("merge"), ["seg", "value"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS)).select("a", "b")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, tid, fp, part (the smallest fp reachable over links) and component_id (the smallest doc_id there) of every
    document. Fingerprints are the nodes, as ids may be shared or null."""
    prints = materialize(fingerprints(docs), "fingerprints")
    entries = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "entries")
    parts = connected_components(links(entries.select(F.col("fp").alias("id"), "fp")))
    table = materialize(entries.join(parts.hint("merge"), entries.fp == parts.node, "left").select(F.col("fp").alias("of"), "id", F.coalesce("component", "fp").alias("part")), "parts")
    least = table.groupBy(F.col("part").alias("_part")).agg(F.min("id").alias("component_id"))
    table = materialize(table.join(least.hint("merge"), table.part == least._part).select("of", "part", "component_id"), "components")
    return prints.join(table.hint("merge"), prints.fp == table.of).drop("of")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: that with the smallest doc_id among those whose
    id no other text has, or else among those of shared ids, or one without id."""
    parts = simhash_components(docs)
    known = parts.filter("doc_id is not null")
    shared = known.groupBy(F.col("doc_id").alias("_id")).agg((F.min("tid") != F.max("tid")).alias("_shared")).filter("_shared")
    known = known.join(shared, known.doc_id == shared._id, "left").select("part", F.when(F.col("_shared"), 1).otherwise(0).alias("rank"), "doc_id", "tid")
    ranked = known.unionByName(parts.filter("doc_id is null").select("part", F.lit(2).alias("rank"), "doc_id", "tid"))
    i, t = unused(docs, "_id"), unused(docs, "_tid")
    kept = ranked.groupBy("part").agg(F.min(F.struct("rank", "doc_id", "tid")).alias("k")).select(F.col("k.doc_id").alias(i), F.col("k.tid").alias(t))
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t))).dropDuplicates([i, t]).drop(i, t)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash_components(read_table(spark, sf_dir, "documents"))
    return parts.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
