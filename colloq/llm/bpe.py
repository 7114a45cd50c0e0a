"""Byte-level BPE encoding and decoding of whole texts.

The words (pre-tokens) that are frequent in the corpus are compiled with their ids into a minimal
acyclic transducer (:mod:`colloq.llm.lexicon`), which every worker memory-maps; a word that is not in
it is merged exactly, lowest merge rank first. A bounded table in each worker keeps the words that it
has met. The lexicon therefore changes speed, never results. Frequent words are counted over all
documents by a mergeable summary: each task keeps at most ``2 * top`` counters (a word with more than
a ``1 / top`` share of a task's words is always kept), and the summaries are added up.

Defined cases: a null text counts as empty and has no ids; special tokens written out in a text are
recognised first, as in the vocabulary file; rows are encoded one by one, so repeated rows and null
doc_ids need no rule; an empty table gives an empty result; a pre-token of any length is merged in
n log n; other columns are kept by :func:`encode` and never collide.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloq.llm.common import fresh
from colloq.llm.lexicon import Lexicon, compile_lexicon
from colloq.session import checkpoint_dir, cut

#: The pre-token pattern of byte-level vocabularies, with Unicode White_Space written out.
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same pattern for texts of Latin letters, ASCII digits, white space and any ASCII sign: there the
#: classes are short ranges, which the standard library's engine matches faster.
LATIN = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
LATIN_TEXT = re.compile(rf"[\t-\r -~{LATIN}]*")
LATIN_PATTERN = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r 0-9{LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
ANY_PATTERN = regex.compile(PATTERN)
TOP_WORDS = 50_000
MAX_LEXICON_WORD = 64
KEPT_WORDS = 100_000
#: Bytes of text whose results are held at a time.
SLICE = 2 << 20
SHORT = 48


def pretokenizer(text: str) -> re.Pattern:
    """The pre-token pattern, compiled for the letters that the text has."""
    return LATIN_PATTERN if LATIN_TEXT.fullmatch(text) else ANY_PATTERN


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or normal:
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take neighbouring text are not supported")
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in w) for w, i in ids.items() if all(c in letters for c in w)}
        self.bytes |= {i: w.encode() for w, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.first = [ids.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token, by its merges alone."""
        parts = [self.first[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        merges, none = self.merges, (1 << 30, 0)
        ranks = [merges.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], live[j], after[i] = merges[pair][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := (parts[left], parts[right])) in merges:
                    heapq.heappush(heap, (merges[p][0], left, p))
        return [x for x, keep in zip(parts, live) if keep]


class WordTable(dict):
    """What is known of the pre-tokens met lately; bounded, and filled on demand by ``_encoded``.

    Two generations: once the table is full, the words still in use move on to the next one.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.older, self.frequent = vocabulary, {}, {}

    def __missing__(self, word: str):
        found = self.older.get(word) or self._encoded(word)
        if len(word) <= MAX_LEXICON_WORD:
            if len(self) >= KEPT_WORDS + len(self.frequent):
                self.older = dict(self)
                self.clear()
                self.update(self.frequent)
            self[word] = found
        return found

    def _encoded(self, word: str):
        raise NotImplementedError


class _Words(WordTable):
    """Pre-token -> (ids as text, bytes of those ids); from the lexicon, else by merging.

    What the lexicon gave stays: there are at most as many as it has words.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None) -> None:
        super().__init__(vocabulary)
        self.lexicon = lexicon

    def _encoded(self, word: str) -> tuple[str, bytes]:
        raw = word.encode("utf-8", "replace")
        ids = self.lexicon.ids(raw) if self.lexicon else None
        known, vocabulary = ids is not None, self.vocabulary
        if not known:
            ids = vocabulary.merge(raw)
        found = (",".join([vocabulary.names[i] for i in ids]), b"".join([vocabulary.bytes[i] for i in ids]))
        if known:
            self.frequent[word] = found
        return found


class Encoder:
    """Encodes texts with a vocabulary and, if there is one, a lexicon."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.words = vocabulary, _Words(vocabulary, lexicon)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        words = self.words
        if self.special is None or not self.special.search(text):
            return [words[w] for w in pretokenizer(text).findall(text)]
        out = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append((str(self.vocabulary.special[part]), part.encode()))
            else:
                out += [words[w] for w in pretokenizer(part).findall(part)]
        return out

    def ids(self, text: str) -> list[int]:
        return [int(x) for p in self.pieces(text) for x in p[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.vocabulary.bytes[i] for i in ids]).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from them, the joined ids."""
        found = self.pieces(text)
        ids, decoded = ",".join([p[0] for p in found]), b"".join([p[1] for p in found])
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", "replace").encode()
        return (ids.count(",") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids


@lru_cache(maxsize=4)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def _map(path: str | None, payload: bytes):
    """The lexicon as a memory map: of the shared file where workers can open it, else an anonymous one."""
    if path:
        try:
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        except OSError:
            pass
    made = mmap.mmap(-1, len(payload))
    made.write(payload)
    return made


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, shared: Broadcast) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        text, path, payload = shared.value
        _ENCODERS[key] = Encoder(_vocabulary(text), Lexicon(_map(path, payload)) if payload else None)
    return _ENCODERS[key]


def _text(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``SLICE`` bytes of the (binary) column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def frequent_words(docs: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """(word, n): at most ``top`` pre-tokens that are frequent in all of ``docs``."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in it:
            for value in batch.column(0):
                text = _text(value.as_py())
                seen.update(pretokenizer(text).findall(text))
                if len(seen) > 2 * top:
                    floor = sorted(seen.values(), reverse=True)[top]
                    seen = Counter({w: n - floor for w, n in seen.items() if n > floor})
        items = [(w, n) for w, n in seen.items() if n > 1 and len(w) <= MAX_LEXICON_WORD]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(count, "word string, n bigint")
    counts = cut(counts.groupBy("word").agg(F.sum("n").alias("n")))
    # by its share alone: no more than 4 * top words can have it, so that many rows are sorted at most
    least = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) // (4 * top)
    return counts.where(F.col("n") > least).orderBy(F.desc("n"), "word").limit(top)


def build_lexicon(docs: DataFrame, vocabulary: str, top: int = TOP_WORDS) -> bytes:
    """The packed transducer of the corpus's frequent words; at most ``top`` words reach the driver."""
    known = _vocabulary(vocabulary)
    words = [r.word.encode() for r in frequent_words(docs, top).select("word").collect()]
    return compile_lexicon((w, known.merge(w)) for w in words)


def share(spark: SparkSession, vocabulary: str, lexicon: bytes | None) -> tuple[str, Broadcast]:
    """Hand the vocabulary file's text and the lexicon to the workers; both have a fixed bound."""
    path = None
    if lexicon:
        folder = urlparse(checkpoint_dir(spark))
        if folder.scheme in ("", "file"):
            path = os.path.join(folder.path, f"lexicon-{uuid.uuid4().hex}.bin")
            with open(path, "wb") as f:
                f.write(lexicon)
            atexit.register(lambda: os.path.exists(path) and os.remove(path))
    return uuid.uuid4().hex, spark.sparkContext.broadcast((vocabulary, path, lexicon))


def encode(docs: DataFrame, vocabulary: str, top: int = TOP_WORDS, lexicon: bytes | None = None, with_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (ARRAY<INT>; left out without ``with_ids``), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    A column of ``docs`` with one of these names is replaced. Without ``keep_text`` the text is left out,
    so that it crosses to the workers once and does not come back.
    """
    key, shared = share(docs.sparkSession, vocabulary, build_lexicon(docs, vocabulary, top) if lexicon is None else lexicon)
    (raw,) = fresh(docs, "t")
    added = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    kept = [c for c in docs.columns if c.lower() not in added and (keep_text or c.lower() != "text")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        for batch in (part for whole in it for part in _slices(whole, len(kept))):
            found = [encoder.digests(_text(x.as_py())) for x in batch.column(len(kept))]
            columns = [pa.array(x, t) for x, t in zip(([f[i] for f in found] for i in range(3)), added.values())]
            if with_ids:
                columns.append(pa.array([np.fromstring(f[3], np.int32, sep=",") if f[3] else [] for f in found], added["ids"]))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + columns, names=[*kept, *added])

    schema = docs.select(*kept).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*kept, F.col("text").cast("binary").alias(raw)).mapInArrow(batches, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``text`` decoded from ``ids`` (null ids: null)."""
    key, shared = share(encoded.sparkSession, vocabulary, None)
    kept = [c for c in encoded.columns if c.lower() != "text"]
    at = kept.index("ids")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        for batch in it:
            texts = [None if x.as_py() is None else encoder.decode(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return encoded.select(*kept).mapInArrow(batches, encoded.select(*kept).schema.add("text", "string"))
