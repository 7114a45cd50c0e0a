"""N-gram Jaccard self-join of documents by a grouped prefix join.

A document is the set of its different word shingles. Shingles are ordered by rarity (document counts of all texts in
``2**SKETCH_BITS`` hashed buckets; any total order is exact, this one decides the speed), and two sets of similarity ``percent``
or more share one of the first few in that order, their prefixes. Documents of equal sets are one class, classes
of equal prefix and size one group, and it is groups that are posted under the shingles of their prefix and
paired, by length and by the position of the shared shingle. Group pairs are then expanded to their members, these are filtered by how
their shingles spread over ``SPREAD`` buckets (what two sets share is no more than the smaller counts add up to), and the rest are
verified on the words of the texts, read again.

Components need no more links than hold them together, so work goes where links are missing. First every group is verified
against one other, which of the earliest groups of its shingles shares most of them, and every member of a group against the group's
first; this is linear in the postings. What that links is one component, and of a posting list, the pairs inside its main
component are never formed: only the rest is paired with all others, so a family of near copies costs no square of its size.
Nothing is left out: every pair that passes the filters is either within a component by then or verified.

Shingles have 128-bit ids, made of the hashes of their words; half of an id is what is posted. Sets are equal if the
digests of their ids are; similar ones are counted word by word.

Defined cases: texts of fewer words than a shingle are one shingle of all their words; texts without words (null, empty,
blank) have an empty set, linked with nothing; repeated rows and doc_ids are judged row by row; a null
doc_id never names a component unless all its documents have none; very long texts are taken whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.llm.common import sized
from colloq.operators.graph import connected_components
from colloq.session import cut, drop_table, release, write_table

PERCENT = 90
SKETCH_BITS = 18
#: Buckets in which the shingles of a set are counted: two sets share no more than the smaller counts add up to.
SPREAD = 64
#: Bytes of text whose words are numbered together.
SLICE = 1 << 20


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One hash of three, in order (wrapping arithmetic)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9) + c
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _different(a: np.ndarray, b: np.ndarray, c: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different triples of numbers below ``base``."""
    if base**3 < 1 << 63:
        u = np.unique((a * base + b) * base + c)
        pair, c = np.divmod(u, base)
    else:
        pairs, at = np.unique(a * base + b, return_inverse=True)
        at, c = np.divmod(np.unique(at.astype(np.int64) * base + c), base)
        pair = pairs[at]
    a, b = np.divmod(pair, base)
    return a, b, c


def shingle_ids(texts: list[bytes], halves: int = 2) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each text the halves (one or both) of the ids of its different shingles of three words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    # bytes: lower() changes A-Z only and split() splits at \x20\x09-\x0D only
    rows = [np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)) for words in (t.lower().split() for t in texts)]
    none = len(numbers)  # stands behind the words of a text that is too short
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)) + bytes(16), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    hashes = [np.ascontiguousarray(digests[:, k]) for k in range(halves)]
    for row in rows:
        if not len(row):
            yield tuple(h[:0] for h in hashes)
            continue
        if len(row) < 3:
            row = np.concatenate((row, np.full(3 - len(row), none)))
        a, b, c = _different(row[:-2], row[1:-1], row[2:], none + 1)
        yield tuple(_mixed(h[a], h[b], h[c]) for h in hashes)


def _slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch, about ``SLICE`` bytes at a time."""
    some, size = [], 0
    for text in texts:
        value = text.as_py() or b""
        some.append(value)
        size += len(value)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _sets(texts: pa.Array, halves: int = 2) -> Iterator[tuple[np.ndarray, ...]]:
    for some in _slices(texts):
        yield from shingle_ids(some, halves)


def _bucket(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank (0 to 255, logarithmic in the count) of each bucket of shingles, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for some in _slices(batch.column(0)):
                found += np.bincount(_bucket(np.concatenate([ids for (ids,) in shingle_ids(some, 1)])), minlength=len(found))
        some = np.flatnonzero(found)
        for at in range(0, len(some), 1 << 14):
            part = some[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(found[part], pa.int64())], names=["bucket", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most 2**SKETCH_BITS rows
    ranks = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    ranks[found["bucket"].to_numpy()] = np.minimum(255, np.log(found["n"].to_numpy() + 1.0) * 8)
    return ranks


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _key_of(ids: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The ids in order and the digest of the set."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    return ids, blake2b(ids.tobytes() + more[order].tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, ranks: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, n (size of the set), key (the set's digest), start (digest of its prefix), prefix (ids in order), spread (shingles
    by the low bits of their ids)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, starts, prefixes, spreads = [], [], [], [], []
            for low, high in _sets(batch.column(2)):
                ids, key = _key_of(low, high)
                first = np.argsort(ranks[_bucket(ids)], kind="stable")[: prefix_length(len(ids), percent)] if len(ids) else []
                prefix = ids[first].view(np.int64) if len(ids) else np.zeros(0, np.int64)
                sizes.append(len(ids))
                keys.append(key)
                starts.append(blake2b(prefix.tobytes(), digest_size=16).digest())
                prefixes.append(prefix)
                spreads.append(np.bincount((ids % np.uint64(SPREAD)).astype(np.int64), minlength=SPREAD).astype(np.int32))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(starts, pa.binary()), listed, pa.array(spreads, pa.list_(pa.int32()))], names=["row", "doc_id", "n", "key", "start", "prefix", "spread"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(signed, "row bigint, doc_id bigint, n bigint, key binary, start binary, prefix array<bigint>, spread array<int>")


def _may_link(percent: int, a: str, b: str) -> Column:
    """The length and position filters for two postings of one shingle."""
    (na, ra), (nb, rb) = ([F.col(f"{x}.{c}") for c in ("n", "rest")] for x in (a, b))
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return length & ((100 + percent) * F.least(ra, rb) >= percent * (na + nb))


def _alike(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) of classes whose spreads leave room for the similarity."""
    pairs = cut(pairs)
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    found = cut(rows.join(sized(ends), "row", "left_semi").select("row", "n", "spread"))
    x, y = (found.select(F.col("row").alias(k), F.col("n").alias(f"n_{k}"), F.col("spread").alias(f"s_{k}")) for k in ("a", "b"))
    shared = F.aggregate(F.zip_with("s_a", "s_b", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    both = pairs.join(x, "a").join(y, "b")
    return both.where((100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))).select(*pairs.columns)


def _shared(groups: DataFrame) -> DataFrame:
    """(token, g, n, rest, hub): the postings of shingles that several groups have, with the earliest of these."""
    each = groups.select("g", "n", F.posexplode("prefix").alias("at", "token")).select("token", "g", "n", (F.col("n") - F.col("at")).alias("rest"))
    several = each.groupBy("token").agg(F.min("g").alias("hub"), F.count("*").alias("members")).where("members > 1").select("token", "hub")
    return each.join(several, "token")


def _first_pairs(shared: DataFrame, members: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each group with the hub that it shares most prefix shingles with, each member with its group's first class."""
    hubs = shared.where(F.col("g") == F.col("hub")).select("token", "g", "n", "rest").alias("b")
    near = shared.where(F.col("g") != F.col("hub")).alias("a").join(hubs, (F.col("a.token") == F.col("b.token")) & _may_link(percent, "a", "b"))
    common = near.groupBy(F.col("a.g").alias("a"), F.col("b.g").alias("b")).agg(F.count("*").alias("common"))
    inside = members.where("c <> g").select(F.col("c").alias("a"), F.col("g").alias("b"), F.lit(0).cast("bigint").alias("common"))
    # a class that is not the first of its group has its group's first class alone
    return _alike(common.unionByName(inside), rows, percent).groupBy("a").agg(F.max_by("b", F.struct("common", -F.col("b"))).alias("b"))


def group_pairs(shared: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """(x, y): groups that pass the filters and are not within one component.

    ``spans`` (g, lo, hi) has the least and greatest component of each group's members. In each posting list the component of the
    hub is the main one; groups that are wholly in it are paired with the others only.
    """
    placed = shared.join(spans, "g")
    # a list whose groups are all in one component is done
    open_ = placed.groupBy("token").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.max(F.when(F.col("g") == F.col("hub"), F.col("lo"))).alias("main")).where("least < most")
    left = cut(placed.join(open_.select("token", "main"), "token").withColumn("inside", (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("main"))).drop("hub", "main"))
    a, b = left.where(~F.col("inside")).alias("a"), left.alias("b")
    once = F.col("b.inside") | (F.col("a.g") < F.col("b.g"))
    apart = (F.col("a.lo") != F.col("a.hi")) | (F.col("b.lo") != F.col("b.hi")) | (F.col("a.lo") != F.col("b.lo"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & once & apart & _may_link(percent, "a", "b"))
    return pairs.select(F.least("a.g", "b.g").alias("x"), F.greatest("a.g", "b.g").alias("y")).distinct()


def _expanded(pairs: DataFrame, spans: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): members of paired groups, and of one group, that are in different components."""
    inside = spans.where("lo <> hi").select(F.col("g").alias("x"), F.col("g").alias("y"))
    x = members.select(F.col("g").alias("x"), F.col("c").alias("a"), F.col("part").alias("pa"))
    y = members.select(F.col("g").alias("y"), F.col("c").alias("b"), F.col("part").alias("pb"))
    both = pairs.unionByName(inside).join(x, "x").join(y, ["y"]).where((F.col("pa") != F.col("pb")) & ((F.col("x") != F.col("y")) | (F.col("a") < F.col("b"))))
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, text) of the classes ``wanted`` (c, doc_id, key): rows of that doc_id whose set has that key."""
    key = (F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    asked = wanted.select(*key, F.col("key").alias("asked"), "c")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key_of(low, high)[1] for low, high in _sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "text"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("t")).select(*key, "t")
    found = rows.join(sized(asked.select("none", "id").distinct()), ["none", "id"], "left_semi").select("t").mapInArrow(keyed, "key binary, text binary")
    return found.join(asked.select(F.col("asked").alias("key"), "c"), "key").select("c", "text").dropDuplicates(["c"])


def _shingles(text: bytes) -> set:
    words = text.lower().split()
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)}


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingles have a Jaccard similarity of ``percent`` / 100 or more, by their words."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = cut(classes.join(ends, "c", "left_semi").select("c", F.col("least").alias("doc_id"), "key"))
    texts = write_table(_texts_of(docs, wanted))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = _shingles(x.as_py()), _shingles(y.as_py())
                both = len(p & q)
                kept.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    x, y = (texts.select(F.col("c").alias(side), F.col("text").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    found = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint"))
    drop_table(texts)
    return found


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to); one row per input row."""
    spark = docs.sparkSession
    rows = write_table(signatures(docs, rarity(docs), percent))
    full = rows.where("n > 0")
    classes = cut(full.groupBy("key", "n", "start").agg(F.min("row").alias("c"), F.min("doc_id").alias("least")))
    groups = write_table(full.groupBy("n", "start").agg(F.min("row").alias("g"), F.first("prefix").alias("prefix")))
    members = cut(classes.join(groups.select("n", "start", "g"), ["n", "start"]).select("c", "g"))
    shared = write_table(_shared(groups))
    release(spark)
    pairs = cut(_first_pairs(shared, members, rows, percent))
    links = verified(docs, classes, pairs, percent)
    release(spark)
    parts = connected_components(links.toDF("src", "dst"))
    named = cut(members.join(parts.withColumnRenamed("node", "c"), "c", "left").select("c", "g", F.coalesce("component", "c").alias("part")))
    spans = cut(named.groupBy("g").agg(F.min("part").alias("lo"), F.max("part").alias("hi")))
    more = cut(_alike(_expanded(group_pairs(shared, spans, percent), spans, named).join(pairs, ["a", "b"], "left_anti"), rows, percent))
    drop_table(shared)
    drop_table(groups)
    release(spark)
    if not more.isEmpty():
        parts = connected_components(links.unionByName(verified(docs, classes, more, percent)).toDF("src", "dst"))
    of = cut(classes.join(parts.withColumnRenamed("node", "c"), "c", "left").select("key", "least", F.coalesce("component", "c").alias("part")))
    least = of.groupBy("part").agg(F.min("least").alias("component_id"))
    # keys are dealt out for this join alone, so a hot class can be split
    found = rows.select("doc_id", "n", "key").join(of.join(least, "part").select("key", "component_id"), "key", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
