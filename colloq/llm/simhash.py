"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two
embeddings is a lower bound of the fingerprints' Hamming distance, so fingerprints at most ``radius``
(2) bits apart differ in at most two coordinates. Coordinates are split into ``GROUPS`` groups; any
such pair agrees on all but two groups, hence falls in one cell of at least one of the grids that fix
the other groups. Within a cell, pairs are range-joined by the Manhattan bound and then verified.

Cells with more than ``DENSE`` fingerprints (one huge family of near copies) are not paired: their
members meet at the points of Hamming space within one bit of them. Two fingerprints are at most two
bits apart exactly if they share such a point, and no point has more than 65 members, so a family of
any size costs 65 rows a fingerprint. Both ways are exact; together they lose no link.

Defined cases: texts without words (null, empty, blank) have fingerprint 0 and are linked like any
other; equal fingerprints are one class before any join, so copies and repeated rows never form
pairs; a null doc_id is fingerprinted and joins a component but is never its name unless all are
null; an empty table gives an empty result; other columns are kept and never collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.llm.common import fresh, let, sized
from colloq.operators.graph import connected_components
from colloq.session import cut

SEED = 42
SHINGLE = 3
RADIUS = 2
GROUPS = 4
DENSE = 64
CHUNK = 1 << 15


def _hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in chunks so that a text of any length takes bounded memory."""
    words = text.lower().split()  # bytes: lower-cases A-Z and splits at \x20\x09-\x0D only
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        yield np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1]
    stops = ends[SHINGLE - 1 :] - 1
    for i in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK].tolist(), stops[i : i + CHUNK].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Bit b is set if more than half of the shingle hashes (with repeats) have it; unsigned."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes(text or b""):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a (signed) BIGINT."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [_signed(fingerprint(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("t")).mapInArrow(batches, "doc_id bigint, fp bigint")


def embed(x: Column) -> Column:
    """The 32 segment counts in one BIGINT, each in unary (0: 00, 1: 01, 2: 11)."""
    odd, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(x, 1)
    some = x.bitwiseOR(next_bit).bitwiseAND(odd)
    both = x.bitwiseAND(next_bit).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings: in unary it is a bit count."""
    return F.bit_count(a.bitwiseXOR(b))


def _cells(embedding: Column, groups: int) -> Column:
    """The packed embedding with two groups of coordinates blanked, once for each two, with the grid's number."""
    edges = [round(32 * g / groups) * 2 for g in range(groups + 1)]
    masks = [sum(1 << b for b in range(edges[g], edges[g + 1])) for g in range(groups)]
    cells = []
    for k, left_out in enumerate(combinations(range(groups), 2)):
        mask = sum(m for g, m in enumerate(masks) if g not in left_out)
        cells.append(F.struct(F.lit(k).alias("grid"), embedding.bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("cell")))
    return F.array(*cells)


def links(fps: DataFrame, groups: int = GROUPS, dense: int = DENSE) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints whose components are those of Hamming distance <= 2.

    ``fps`` has one row per distinct ``fp``.
    """
    placed = fps.select("fp", F.explode(_cells(embed(F.col("fp")), groups)).alias("g")).select("g.grid", "g.cell", "fp")
    sizes = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    placed = cut(placed.join(sizes, ["grid", "cell"]))

    # at most `dense` members a cell are gathered: a bounded list, paired in place
    small = placed.where(F.col("n") <= dense).groupBy("grid", "cell").agg(F.sort_array(F.collect_list("fp")).alias("m"))

    def near(a: Column, b: Column) -> Column:
        return (a < b) & (manhattan(embed(a), embed(b)) <= RADIUS) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)

    pairs = let(F.col("m"), lambda m: F.flatten(F.transform(m, lambda a: F.transform(F.filter(m, lambda b: near(a, b)), lambda b: F.struct(a.alias("src"), b.alias("dst"))))))
    sparse = small.select(F.explode(pairs).alias("e")).select("e.src", "e.dst")

    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in range(64)])
    around = placed.where(F.col("n") > dense).select("fp").distinct().select("fp", F.explode(points).alias("point"))
    meet = around.groupBy("point").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)  # at most 65
    crowded = meet.select(F.array_min("m").alias("src"), F.explode("m").alias("dst")).where("src <> dst")
    return sparse.unionByName(crowded).distinct()


def _grouped(docs: DataFrame, groups: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and names (fp, component_id, first: the fingerprint of the component's naming document)."""
    rows = cut(fingerprints(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(links(classes.select("fp"), groups, dense))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    named = cut(named.select("fp", "least", "part"))
    first = named.groupBy("part").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("f"))
    return rows, named.join(first, "part").select("fp", F.col("f.least").alias("component_id"), F.col("f.fp").alias("first"))


def near_duplicates(docs: DataFrame, groups: int = GROUPS, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per input row."""
    rows, names = _grouped(docs, groups, dense)
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, groups: int = GROUPS, dense: int = DENSE) -> DataFrame:
    """One document of each component stays, the one that names it; the columns are kept as they were.

    Rows that share doc_id and fingerprint share their fate. Rows are found again by doc_id; where rows of one doc_id
    (or without one) differ in their fate, by their fingerprints, which are then taken once more from these rows alone.
    """
    none, ident, fp = fresh(docs, "none", "id", "fp")
    rows, names = _grouped(docs, groups, dense)
    key = (F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(ident))
    stays = F.col("fp").eqNullSafe(F.col("first")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    fates = rows.join(names, "fp").select(*key, F.col("fp").alias(fp), stays.alias("stays")).distinct()
    fates = cut(fates)
    by_id = cut(fates.groupBy(none, ident).agg(F.bool_or("stays").alias("some"), F.bool_and("stays").alias("all")).where("not all"))
    own = F.col("doc_id").cast("bigint")
    marked = docs.withColumns({none: own.isNull(), ident: F.coalesce(own, F.lit(0))})
    kept = marked.join(sized(by_id.select(none, ident)), [none, ident], "left_anti").select(*docs.columns)
    mixed = by_id.where("some").select(none, ident)
    if mixed.isEmpty():
        return kept

    @F.pandas_udf("bigint")
    def again(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _signed(fingerprint(t)))

    apart = marked.join(mixed, [none, ident], "left_semi").withColumn(fp, again(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return kept.unionByName(apart.join(fates.where("stays").select(none, ident, fp), [none, ident, fp], "left_semi").select(*docs.columns))
