"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity (corpus counts of all documents in
``2**SKETCH_BITS`` hashed buckets, so the order needs a table of fixed size; any total order is exact,
rarity makes it fast). Lines with equal sets are one class, named by its first line. Each class is posted
under the first words of its order (prefix filter), and classes that share a posted word are tested by
length, by the position of the shared word and by a 128-bit parity bitmap of their ``HEAD`` rarest words,
whose distance is bounded for similar sets. What remains is verified on the words themselves, read again
from the texts. A line goes if an equal or similar line (Jaccard >= 0.8) stands earlier in (document, line)
order.

Only the existence of an earlier match matters. Of the earlier classes that pass the filters for a class, the
most alike one by its bitmap is verified first, so the texts of a family of similar lines are fetched for a pair per
member; only for classes for which it fails the others are verified too. Classes that share a crowded word are first
compared with the earliest class of that word alone, at a cost linear in their number; only those without a match yet are
compared with every earlier class of the word. Crowded are the words of more than ``CROWD`` classes, and those of fewer that
stand out: how many classes share a word grows with the table where the vocabulary does not, so the bound is the lowest that
leaves few postings above it. Which words are crowded decides where classes meet, not which are found. The cause that
a removed line names is the first line of its own set, or else the most alike earlier line that was verified, and of equally alike ones the
first; it does not depend on the partitions.

Defined cases: lines without a word are never removed, nor are lines of fewer than ``min_words``
different words (1 by default: every line with a word); lines of fewer than four words are similar to
their equals alone; a null text is one empty line; rows are told apart by doc_id, or where doc_ids
repeat or are null by doc_id and text, so rows equal in both keep or lose the same lines; documents stand
in the order of doc_id, nulls last, ties by a hash of the text; very long lines and texts are taken whole;
an empty table gives an empty result; other columns are kept by :func:`clean` and never collide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloq.llm.common import fresh, let, sized
from colloq.session import cut, drop_table, release, write_table

#: A set of fewer words is similar to no set but its equal (4 words may stand in a set of 5: 4/5 = 0.8).
POSTED_WORDS = 4
SKETCH_BITS = 18
RANK_SHIFT = 48
#: Words in the parity bitmap. Unlike sets of over 120 words would pass with 64, as their heads differ by little more than similar ones may.
HEAD = 128
#: Classes that share a posted word and are all compared with each other, at most and at least.
CROWD, FEW = 1024, 64
#: One in so many postings may be of crowded words before the bound rises; counts are those of one in so many classes.
CROWDED_SHARE, COUNTED = 16, 8
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
KEY = ("k1", "k2", "n")
#: Rows of a few numbers that a join may broadcast: 10 MB at 16 bytes, or at 40 bytes for classes.
BROADCAST_PLACES = 600_000
BROADCAST_CLASSES = 250_000


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit((1 << SKETCH_BITS) - 1))


def _odd(text: Column) -> Column:
    """Whether other white space than spaces and line ends is in a text."""
    return F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))


def _each_line(docs: DataFrame, *columns: str) -> DataFrame:
    """line_no, line, odd and the given columns, a row per line."""
    flagged = docs.select(*columns, "text", _odd(F.col("text")).alias("odd"))
    return flagged.select(*columns, "odd", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _words(line: str = "line", odd: str = "odd") -> Column:
    """The words of a line, with empty ones at repeated separators."""
    # a literal separator is split without a regular expression
    return F.when(F.col(odd), F.split(line, SPACE)).otherwise(F.split(line, " "))


def rarity(docs: DataFrame) -> Column:
    """Rank (-128 to 127, logarithmic in the count) of each bucket of words, as a folded array literal."""
    words = _each_line(docs).select(F.explode(_words()).alias("w"))
    counts = words.groupBy(_bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n"))
    rank = F.least(F.lit(255), F.floor(F.log(F.col("n") + 1) * 8)) - 128
    # at most 2**SKETCH_BITS numbers, whatever the corpus
    listed = counts.agg(F.array_join(F.collect_list(F.concat_ws(" ", "b", rank)), " ").alias("r")).first()["r"]
    pairs = listed.split()
    ranks = ["-128"] * (1 << SKETCH_BITS)
    for bucket, found in zip(pairs[::2], pairs[1::2], strict=True):
        ranks[int(bucket)] = found
    return F.split(F.lit(",".join(ranks)), ",").cast("array<bigint>")


def _word_id(ranks: Column, word: Column) -> Column:
    """47 bits of the word's hash under the rank of its bucket: sorting ids sorts by rarity."""
    return F.shiftleft(F.get(ranks, _bucket(word)), RANK_SHIFT).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 17))


def prefix_length(n: Column) -> Column:
    """A set of n words shares one of its first so many with any set that it is similar to."""
    return (n - F.floor((4 * n + 4) / 5) + 1).cast("int")


def _bitmap(high: bool) -> Column:
    """Half of the parity of the ``HEAD`` first ids in 128 bits, by their low seven bits. Spelled out, as a lambda would be
    interpreted; most sets have no second half of a head."""
    half = "" if high else " ^ 1L"
    terms = [f"coalesce(shiftleft((shiftrightunsigned(get(p, {i}), 6) & 1L){half}, int(get(p, {i}) & 63)), 0L)" for i in range(HEAD)]
    while len(terms) > 2:  # a balanced tree is cut into short methods
        terms = [" ^ ".join(terms[i : i + 2]) for i in range(0, len(terms), 2)]
        terms = [f"({t})" for t in terms]
    return F.expr(f"{terms[0]} ^ if(size(p) > {HEAD // 2}, {terms[1]}, 0L)")


def lines_of(docs: DataFrame, ranks: Column) -> DataFrame:
    """Per line with a word: doc, line_no, number of words, bitmap (low, high), 128-bit class key, prefix in rarity order."""
    each = _each_line(docs, "doc").where(F.col("line").rlike(WORD))
    where = (F.col("doc"), F.col("line_no").cast("bigint").alias("line_no"))
    ids = F.sort_array(F.array_distinct(F.transform(_words(), lambda w: _word_id(ranks, w))))
    sets = each.select(*where, F.array_remove(ids, _word_id(ranks, F.lit(""))).alias("p"))
    n = F.size("p")
    prefix = F.slice("p", F.lit(1), F.when(n < POSTED_WORDS, F.lit(0)).otherwise(prefix_length(n)))
    # nothing is added, but a lambda keeps this projection out of whole-stage code, where the bitmaps would be one method
    # that is too long for the JVM to compile
    prefix = F.concat(prefix, F.transform(F.slice("p", 1, 0), lambda x: x))
    return sets.select("doc", "line_no", n.cast("bigint").alias("n"), _bitmap(False).alias("low"), _bitmap(True).alias("high"), F.xxhash64("p").alias("k1"), F.xxhash64(F.lit(1), "p").alias("k2"), prefix.alias("prefix"))


@dataclass(frozen=True)
class Numbered:
    """Documents as (doc, text): ``doc`` is doc_id itself, or a row number where doc_ids don't tell rows apart.

    ``names`` (doc, doc_id, check) says what the numbers stand for; None if they are the doc_ids.
    """

    docs: DataFrame
    names: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, again: bool = False) -> Numbered:
        """``again``: number the rows even if the doc_ids tell them apart."""
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text")
        if not again and rows.where("doc is null").isEmpty() and rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return cls(rows)
        check = F.xxhash64(F.coalesce("text", F.lit("")))
        found = rows.select("doc", check.alias("check")).distinct()
        spread = cut(found.repartitionByRange(F.col("doc").asc_nulls_last(), "check").select("doc", "check", F.spark_partition_id().alias("part")))
        # ranges follow each other, so a rank is the place in the range behind the rows of earlier ranges
        before = spread.groupBy("part").agg(F.count("*").alias("rows"))
        before = before.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # one row per partition
        place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc").asc_nulls_last(), "check")) - 1
        names = cut(spread.withColumn("place", place).join(F.broadcast(before), "part").select((F.col("place") + F.col("before")).alias("doc"), F.col("doc").alias("doc_id"), "check"))
        key = (F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("id"))
        named = names.select("doc", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "check")
        # equal rows are one document
        once = rows.select(*key, check.alias("check"), "text").join(named, ["none", "id", "check"]).groupBy("doc").agg(F.first("text").alias("text"))
        return cls(once, names)


@dataclass(frozen=True)
class Places:
    """(doc, line number) in one BIGINT that keeps their order."""

    low: int
    high: int
    lines: int

    @classmethod
    def of(cls, lines: DataFrame) -> Places:
        s = lines.agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("line_no").alias("l")).first()
        return cls(s.a or 0, s.b or 0, (s.l or 0) + 1)

    @property
    def fit(self) -> bool:
        return (self.high - self.low + 1) * self.lines < 1 << 63

    def of_line(self, doc: Column, line_no: Column) -> Column:
        return (doc - F.lit(self.low)) * F.lit(self.lines) + line_no

    def spot(self, place: Column) -> tuple[Column, Column]:
        return F.call_function("div", place, F.lit(self.lines).cast("bigint")) + F.lit(self.low), F.pmod(place, F.lit(self.lines))


def _posted(classes: DataFrame) -> DataFrame:
    """A row per class and prefix word: word, first, low, high, n (words), rest (words from this one on)."""
    each = classes.select("first", "n", "low", "high", F.posexplode("prefix").alias("at", "word"))
    return each.select("word", "first", "low", "high", "n", (F.col("n") - F.col("at")).alias("rest"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, later, earlier, apart) of the rows of ``b`` and ``a`` that share a word and pass the filters."""
    a, b = a.alias("a"), b.alias("b")
    (na, nb), (ra, rb) = ([F.col(f"{x}.{c}") for x in "ab"] for c in ("n", "rest"))
    apart = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in ("low", "high")), F.lit(0))
    need = 4 * (na + nb)  # nine times the overlap that a similarity of 0.8 takes
    length = 5 * F.least(na, nb) >= 4 * F.greatest(na, nb)
    position = 9 * F.least(ra, rb) >= need
    # of the HEAD first words of two sets, at most as many differ on either side as of the whole larger set
    alike = 9 * apart <= 18 * F.greatest(na, nb) - 2 * need
    near = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.first") < F.col("b.first")) & alike & length & position)
    return near.select("a.word", F.col("b.first").alias("later"), F.col("a.first").alias("earlier"), apart.alias("apart"))


def _crowded(classes: DataFrame, postings: int) -> DataFrame | None:
    """(word): the words that are crowded by the counts of one in ``COUNTED`` classes; None if there are none."""
    counted = _posted(classes.where(F.pmod("k1", F.lit(COUNTED)) == 0))
    counts = cut(counted.groupBy("word").agg(F.count("*").alias("members")).where(F.col("members") > min(CROWD, FEW) // COUNTED))
    bounds, bound = [], FEW
    while bound < CROWD:
        bounds.append(bound)
        bound *= 2
    above = [F.coalesce(F.sum(F.when(F.col("members") > b // COUNTED, F.col("members"))), F.lit(0)) for b in (*bounds, CROWD)]
    shares = counts.agg(*[x.alias(f"b{i}") for i, x in enumerate(above)]).first()
    fits = [b for b, share in zip(bounds, shares, strict=False) if CROWDED_SHARE * COUNTED * share <= postings]
    words = counts.where(F.col("members") > min([*fits, CROWD]) // COUNTED).select("word")
    return None if words.isEmpty() else words


def candidates(classes: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Distinct (later, earlier, apart): all that the filters let through of words that are not crowded, and of a
    crowded word those with its hub; narrow rows, at most ``CROWD`` for a posting."""
    posted = _posted(classes)
    if hot is None:
        return _pairs(posted, posted).drop("word").distinct()
    hubs = cut(hot.groupBy("word").agg(F.min_by(F.struct("first", "low", "high", "n", "rest"), "first").alias("hub")).select("word", "hub.*"))
    cold = posted.join(sized(hubs.select("word"), BROADCAST_PLACES), "word", "left_anti")
    return _pairs(cold, cold).unionByName(_pairs(sized(hubs, BROADCAST_CLASSES), hot)).drop("word").distinct()


def other_candidates(pairs: DataFrame, hot: DataFrame | None, best: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct (later, earlier) for classes without a match: all of ``pairs`` but the ``best``, and of crowded words
    those with every earlier class."""
    settled = cut(matched.select(F.col("later").alias("first")))
    done = sized(settled, BROADCAST_PLACES)
    found = pairs.join(done.withColumnRenamed("first", "later"), "later", "left_anti").select("later", "earlier")
    if hot is not None:
        found = found.unionByName(_pairs(hot, hot.join(done, "first", "left_anti")).select("later", "earlier"))
    return found.distinct().join(best, ["later", "earlier"], "left_anti")


def _texts_of(documents: Numbered, places: Places, wanted: DataFrame) -> DataFrame:
    """(place, line, odd) of the given distinct lines, read again from the documents."""
    docs, where = documents.docs, wanted.select(places.spot(F.col("place"))[0].alias("doc")).distinct()
    if where.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES:  # texts are not exchanged to skip some
        docs = docs.join(F.broadcast(where), "doc", "left_semi")
    each = _each_line(docs, "doc").select(places.of_line(F.col("doc"), F.col("line_no")).alias("place"), "line", "odd")
    return each.join(sized(wanted, BROADCAST_PLACES), "place").select("place", "line", "odd")


def _similar(x: Column, y: Column) -> Column:
    """Whether two lists of words are similar as sets."""

    def of_sets(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["x"], s["y"]))
        return 5 * shared >= 4 * (F.size(s["x"]) + F.size(s["y"]) - shared)

    return let(F.struct(*[F.array_remove(F.array_distinct(w), "").alias(name) for w, name in ((x, "x"), (y, "y"))]), of_sets)


def _verified(documents: Numbered, places: Places, pairs: DataFrame) -> DataFrame:
    """The pairs (later, earlier) whose sets of words have a Jaccard similarity of 0.8 or more."""
    wanted = cut(pairs.select(F.explode(F.array("later", "earlier")).alias("place")).distinct())
    texts = write_table(_texts_of(documents, places, wanted))
    x, y = (texts.select(F.col("place").alias(side), F.col("line").alias(f"{side}_line"), F.col("odd").alias(f"{side}_odd")) for side in ("later", "earlier"))
    both = sized(pairs, BROADCAST_PLACES).join(x, "later").join(y, "earlier")
    # lines take less of an exchange than lists of words
    found = cut(both.where(_similar(_words("later_line", "later_odd"), _words("earlier_line", "earlier_odd"))).select("later", "earlier"))
    drop_table(texts)
    return found


def removed_lines(documents: Numbered, min_words: int = 1) -> DataFrame:
    """(doc, line_no, by_doc, by_line): the lines to remove and the earlier line that each repeats."""
    docs, spark = documents.docs, documents.docs.sparkSession
    lines = write_table(lines_of(docs, rarity(docs)))
    places = Places.of(lines)
    if not places.fit:
        raise OverflowError("doc_id and line numbers span more than 63 bits")
    postings = lines.agg(F.sum(F.size("prefix"))).first()[0] or 0
    table = lines.where(F.col("n") >= min_words).select(places.of_line(F.col("doc"), F.col("line_no")).alias("place"), *KEY, "low", "high", "prefix")
    several = cut(table.groupBy(*KEY).agg(F.min("place").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"))
    release(spark)
    small = several.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    # hot classes are split by adaptive execution: the exchange serves this join alone
    table = table.join(F.broadcast(several) if small else several, list(KEY), "left").select("place", F.coalesce("first", "place").alias("first"), "k1", "n", "low", "high", "prefix")
    if not small:  # a join that costs an exchange is made once
        table = write_table(table)
    classes = table.where((F.col("place") == F.col("first")) & (F.col("n") >= POSTED_WORDS)).select("first", "k1", "n", "low", "high", "prefix")
    crowded = _crowded(classes, postings)
    hot = None if crowded is None else write_table(_posted(classes).join(sized(crowded, BROADCAST_PLACES), "word"))
    pairs = cut(candidates(classes, hot))
    release(spark)  # the exchange of the postings
    best = cut(pairs.groupBy("later").agg(F.min_by("earlier", F.struct("apart", "earlier")).alias("earlier")))
    matched = _verified(documents, places, best)
    rest = cut(other_candidates(pairs, hot, best, matched))
    if hot is not None:
        drop_table(hot)
    release(spark)
    if not rest.isEmpty():
        matched = matched.unionByName(_verified(documents, places, rest))
    equal = table.where("place <> first").select("place", F.col("first").alias("cause"))
    similar = matched.groupBy(F.col("later").alias("place")).agg(F.min("earlier").alias("cause"))
    gone = cut(similar.unionByName(equal))
    for written in {lines} if small else {lines, table}:
        drop_table(written)
    (doc, line_no), (by_doc, by_line) = places.spot(F.col("place")), places.spot(F.col("cause"))
    return gone.select(doc.alias("doc"), line_no.alias("line_no"), by_doc.alias("by_doc"), by_line.alias("by_line"))


def _per_document(docs: DataFrame, min_words: int) -> tuple[Numbered, DataFrame]:
    """The numbered documents, and (doc, removed): the removed lines of a document (as many as it has), if it has any."""
    documents = Numbered.of(docs)
    try:
        gone = removed_lines(documents, min_words)
    except OverflowError:  # very sparse doc_ids
        documents = Numbered.of(docs, again=True)
        gone = removed_lines(documents, min_words)
    if documents.names is None:
        gone = gone.withColumn("by_doc_id", F.col("by_doc"))
    else:
        gone = gone.join(documents.names.select(F.col("doc").alias("by_doc"), F.col("doc_id").alias("by_doc_id")), "by_doc")
    spots = F.struct("line_no", "by_doc_id", F.col("by_line").alias("by_line_no"))
    return documents, gone.groupBy("doc").agg(F.array_sort(F.collect_list(spots)).alias("removed"))


def _with_number(docs: DataFrame, documents: Numbered, name: str) -> DataFrame:
    """``docs`` with the number of each row's document in column ``name``."""
    ident = F.col("doc_id").cast("bigint")
    if documents.names is None:
        return docs.withColumn(name, ident)
    none, key, check = fresh(docs.withColumn(name, F.lit(0)), "none", "key", "check")
    marked = docs.withColumns({none: ident.isNull(), key: F.coalesce(ident, F.lit(0)), check: F.xxhash64(F.coalesce("text", F.lit("")))})
    names = documents.names.select(F.col("doc").alias(name), F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(key), F.col("check").alias(check))
    return marked.join(names, [none, key, check]).drop(none, key, check)


def deduplicated(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """doc_id, n_removed, removed (line number and the doc_id and line number that it repeats); one row per input row."""
    documents, per_doc = _per_document(docs, min_words)
    rows = _with_number(docs.select("doc_id", "text"), documents, "doc").select("doc_id", "doc")
    none = F.array().cast("array<struct<line_no:bigint,by_doc_id:bigint,by_line_no:bigint>>")
    joined = rows.join(per_doc, "doc", "left").withColumn("removed", F.coalesce("removed", none))
    return joined.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed")


def clean(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """``docs`` without the removed lines, other columns as they were; a null text stays null."""
    number, gone = fresh(docs, "number", "gone")
    documents, per_doc = _per_document(docs, min_words)
    per_doc = cut(per_doc.select(F.col("doc").alias(number), F.transform("removed", lambda r: r["line_no"]).alias(gone)))
    if (per_doc.agg(F.sum(F.size(gone) + 2).alias("numbers")).first()["numbers"] or 0) <= BROADCAST_PLACES:
        per_doc = F.broadcast(per_doc)
    marked = _with_number(docs, documents, number).join(per_doc, number, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i.cast("bigint"))), "\n")
    return marked.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
