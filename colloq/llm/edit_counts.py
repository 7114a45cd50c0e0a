"""Edit-aware token counting.

Per document a segment tree is kept over its pre-tokens: leaves of ``LEAF`` pre-tokens with their start
offsets and token counts, and the sums above them. An edit re-encodes only from the last leaf that it
cannot have reached (the pre-token pattern looks one character ahead) up to the first old leaf boundary
behind it that is a pre-token boundary again; from there on the old leaves hold, moved by the change of
length. Sums are updated along the paths of the changed leaves, or rebuilt from the counts (never from
the text) when their number changes.

Defined cases: a null text counts as empty, with no leaves and 0 tokens; edits are (start, stop, new)
in characters of the old text, sorted, not overlapping, and clipped to the text; null edits are none; a
text that spells out a special token, before or after its edits, is counted anew as a whole, as such
tokens cut the text before the pre-token pattern does; repeated rows and null doc_ids are counted row
by row; an empty table gives an empty result; only doc_id and text are read, so other columns never
collide.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.llm.bpe import Encoder, Vocabulary, WordTable, pretokenizer

LEAF = 32
Edit = tuple[int, int, str]
STATE = "doc_id bigint, text string, starts array<int>, counts array<int>, sums array<bigint>"

# What the scrubbing edits of the query replace, and by what.
SCRUB = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]))"
    r"|(?P<phone>(?<![\w+])\+?\d[\d ()-]{7,14}\d(?!\w))"
    r"|(?P<license>^(?:Licensed under|Copyright \(c\)|All rights reserved)[^\n]*$)",
    re.MULTILINE,
)
PLACEHOLDERS = {"email": "[email]", "ip": "[address]", "phone": "[phone]", "license": ""}


class _Counts(WordTable):
    """Pre-token -> number of ids."""

    def _encoded(self, word: str) -> int:
        return len(self.vocabulary.merge(word.encode("utf-8", "replace")))


class Counter:
    """Counts the tokens of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        encoder = Encoder(vocabulary)
        self.special, self.words = encoder.special, _Counts(vocabulary)

    def has_special(self, text: str) -> bool:
        return self.special is not None and self.special.search(text) is not None

    def leaves(self, words: list[str], at: int) -> tuple[list[int], list[int]]:
        starts, counts, known = [], [], self.words
        for k in range(0, len(words), LEAF):
            part = words[k : k + LEAF]
            starts.append(at)
            counts.append(sum([known[w] for w in part]))
            at += sum(map(len, part))
        return starts, counts

    def whole(self, text: str) -> tuple[list[int], list[int], int]:
        """Leaf starts, leaf counts, pre-tokens of a text; a special token is a leaf of its own."""
        if not self.has_special(text):
            words = pretokenizer(text).findall(text)
            return *self.leaves(words, 0), len(words)
        starts, counts, n, at = [], [], 0, 0
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                starts.append(at)
                counts.append(1)
                n += 1
            else:
                words = pretokenizer(part).findall(part)
                more = self.leaves(words, at)
                starts, counts, n = starts + more[0], counts + more[1], n + len(words)
            at += len(part)
        return starts, counts, n


def tree_sums(counts: list[int]) -> list[int]:
    """Heap-ordered sums: [1] is the total, [size + i] leaf i."""
    size = 1
    while size < len(counts):
        size *= 2
    sums = [0] * size + counts + [0] * (size - len(counts))
    for i in range(size - 1, 0, -1):
        sums[i] = sums[2 * i] + sums[2 * i + 1]
    return sums


@dataclass
class Tree:
    """The segment tree of one text."""

    text: str
    starts: list[int]
    counts: list[int]
    sums: list[int] = field(default_factory=list)
    encoded: int = 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        starts, counts, n = counter.whole(text)
        return cls(text, starts, counts, tree_sums(counts), n)

    @property
    def n_tokens(self) -> int:
        return self.sums[1] if len(self.sums) > 1 else 0

    def edited(self, edits: list[Edit], counter: Counter) -> Tree:
        """The tree after ``edits``; ``encoded`` says how many pre-tokens were encoded for it."""
        size = len(self.text)
        edits = [(max(0, min(a, size)), max(0, min(b, size)), new or "") for a, b, new in edits]
        if not edits:
            return Tree(self.text, self.starts, self.counts, self.sums, 0)
        pieces, at = [], 0
        for a, b, new in edits:
            if a < at or b < a:
                raise ValueError("edits must be sorted and must not overlap")
            pieces += [self.text[at:a], new]
            at = b
        text = "".join([*pieces, self.text[at:]])
        if counter.has_special(self.text) or counter.has_special(text):
            return Tree.of(text, counter)

        old, starts, counts, encoded = self.starts, [], [], 0
        leaf, moved, k = 0, 0, 0  # old leaves below `leaf` are settled; `moved`: shift of the old text at `leaf`
        while k < len(edits):
            restart = max(leaf, bisect_left(old, edits[k][0] - 1) - 1)  # last start with start + 1 < edit
            starts += [s + moved for s in old[leaf:restart]]
            counts += self.counts[leaf:restart]
            begin = (old[restart] if restart < len(old) else 0) + moved if old else 0
            words, q, leaf = [], begin, len(old)
            behind = edits[k][0] + moved + len(edits[k][2])
            moved += len(edits[k][2]) - (edits[k][1] - edits[k][0])
            k += 1
            for m in pretokenizer(text).finditer(text, begin):
                q = m.start()
                while k < len(edits) and q - moved + 1 >= edits[k][0]:  # the next edit is within reach
                    behind = edits[k][0] + moved + len(edits[k][2])
                    moved += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                    k += 1
                if q >= behind:
                    i = bisect_left(old, q - moved)
                    if i < len(old) and old[i] == q - moved and old[i] >= edits[k - 1][1]:
                        leaf = i
                        break
                words.append(m[0])
            else:
                k = len(edits)
            more = counter.leaves(words, begin)
            starts, counts, encoded = starts + more[0], counts + more[1], encoded + len(words)
        starts += [s + moved for s in old[leaf:]]
        counts += self.counts[leaf:]
        return Tree(text, starts, counts, self._sums(counts), encoded)

    def _sums(self, counts: list[int]) -> list[int]:
        if len(counts) != len(self.counts):
            return tree_sums(counts)
        sums, size = list(self.sums), len(self.sums) // 2
        for i, (new, old) in enumerate(zip(counts, self.counts)):
            node = size + i if new != old else 0
            while node:
                sums[node] += new - old
                node //= 2
        return sums


def scrub_edits(text: str) -> list[Edit]:
    """Edits that take personal data and licence lines out of a text."""
    return [(m.start(), m.end(), PLACEHOLDERS[m.lastgroup]) for m in SCRUB.finditer(text)]


_COUNTERS: dict[str, Counter] = {}


def _counter(key: str, shared: Broadcast) -> Counter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(Vocabulary(shared.value))
    return _COUNTERS[key]


def _text(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


def build(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The trees: doc_id, text, starts, counts, sums."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, shared)
        for batch in it:
            trees = [Tree.of(_text(t.as_py()), counter) for t in batch.column(1)]
            yield _state(batch.column(0), trees)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(batches, STATE)


def _state(ids: pa.Array, trees: list[Tree]) -> pa.RecordBatch:
    kinds = (("text", pa.string()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([ids, *(pa.array([getattr(t, n) for t in trees], k) for n, k in kinds)], names=["doc_id", *(n for n, _ in kinds)])


def apply_edits(state: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """The trees after ``edits`` (doc_id, start, stop, new); documents without edits are passed on as they are."""
    key, shared = uuid.uuid4().hex, state.sparkSession.sparkContext.broadcast(vocabulary)
    own = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "new"))).alias("edits"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, shared)
        for batch in it:
            rows = batch.to_pylist()
            trees = [Tree(r["text"], r["starts"], r["counts"], r["sums"]).edited([(e["start"], e["stop"], e["new"]) for e in r["edits"] or []], counter) for r in rows]
            yield _state(batch.column(0), trees)

    columns = ["doc_id", "text", "starts", "counts", "sums"]
    return state.select(*columns).join(own, "doc_id", "left").select(*columns, "edits").mapInArrow(batches, STATE)


def counted_edits(docs: DataFrame, vocabulary: str, edits: Callable[[str], list[Edit]] = scrub_edits) -> DataFrame:
    """Count each document, apply the edits that ``edits`` finds in it and count again by its tree.

    doc_id, n_tokens_before, n_tokens, n_edits, n_pretokens (before), n_reencoded (pre-tokens). One pass
    over the texts, no shuffle.
    """
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ("n_tokens_before", "n_tokens", "n_edits", "n_pretokens", "n_reencoded")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, shared)
        for batch in it:
            found = []
            for value in batch.column(1):
                tree = Tree.of(_text(value.as_py()), counter)
                wanted = edits(tree.text)
                after = tree.edited(wanted, counter)
                found.append((tree.n_tokens, after.n_tokens, len(wanted), tree.encoded, after.encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.int64()) for i in range(5))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(batches, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))
