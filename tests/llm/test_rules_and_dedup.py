"""Quality rules, exact dedup and SimHash against brute force and on awkward rows."""

import hashlib
import random

import pytest
import xxhash
from helpers import AWKWARD, CLASHING, LONG, clashing, lower, table, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloq.llm import exact_dedup, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def measures(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = {}, set()
    for i, x in enumerate(windows):
        seen.setdefault(x, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_match_brute_force(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a ", "b ", "a\n", "#", "c", " ", "\t", " ", "é "]) for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    texts += [t for _, t in AWKWARD]
    rows = quality_rules.ledger(table(spark, list(enumerate(texts)))).collect()
    for r in rows:
        assert tuple(r[c] for c in quality_rules.MEASURES) == measures(texts[r.doc_id])


def test_policies_and_ablations(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    docs = table(spark, [(1, clean), (2, "few words"), (3, " ".join(["a b c d e f g h"] * 9)), (4, clean.replace(" ", " # ")), (5, None)])
    led = quality_rules.ledger(docs)
    kept = {r.doc_id: r.kept for r in quality_rules.apply_policy(led).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    base = {r.doc_id: r.kept for r in quality_rules.apply_policy(led, quality_rules.BASE).collect()}
    assert base == {1: True, 2: False, 3: False, 4: True, 5: False}
    counts = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(led).collect()}
    assert counts["few_words"] == (2, 2) and counts["symbols"] == (1, 1)
    assert [r.doc_id for r in quality_rules.keep_by_policy(docs).collect()] == [1]


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = clashing(table(spark, AWKWARD))
    for f in (quality_rules.keep_by_policy, exact_dedup.drop_copies, simhash.drop_near_copies):
        out = f(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHING)
        assert f(docs.limit(0)).count() == 0
    assert quality_rules.ledger(docs.limit(0)).count() == 0
    assert quality_rules.ablations(quality_rules.ledger(docs.limit(0))).count() == 0


@pytest.mark.parametrize("steps", [1, 4])
def test_exact_groups(spark, steps):
    docs = clashing(table(spark, AWKWARD)).repartition(9)
    rows = exact_dedup.groups(docs, steps=steps).collect()
    assert len(rows) == len(AWKWARD)
    best, size = {}, {}
    for d, t in AWKWARD:
        key = lower(t)
        best[key] = max([x for x in (best.get(key), d) if x is not None], default=None)
        size[key] = size.get(key, 0) + 1
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): k for k in best}
    for r in rows:
        key = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[key], size[key])
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(best) and {r.text_sha256 for r in kept} == set(by_sha)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_min_keeps_the_smallest(spark):
    rows = exact_dedup.groups(table(spark, [(5, "a"), (2, "A"), (9, "a")]), keep="min").collect()
    assert {r.doc_id for r in rows if r.kept} == {2} and {r.keep_id for r in rows} == {2}


def test_drop_copies(spark):
    out = exact_dedup.drop_copies(table(spark, AWKWARD)).collect()
    assert sorted([(-1 if r.doc_id is None else r.doc_id) for r in out]) == [-1, 4, 5, 6, 7, 8, 9, 10]


def test_drop_copies_with_columns_that_have_no_order(spark):
    docs = table(spark, [(1, "Same"), (2, "same"), (2, "SAME"), (3, "other"), (None, "x"), (None, "X")]).withColumn("tags", F.create_map(F.lit("k"), F.col("text")))
    out = exact_dedup.drop_copies(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(((r.doc_id or 0), r.tags["k"].lower()) for r in out.collect()) == [(0, "x"), (2, "same"), (3, "other")]


def test_near_copies_by_row(spark):
    """Rows that share a doc_id, or have none, go or stay each by its own text."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen fifteen"
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, c), (None, c + " "), (5, b), (6, None), (7, "")]
    docs = clashing(table(spark, rows))
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in out.collect()) == [(0, c), (0, c), (1, a), (2, b), (2, b), (6, "")]


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB é\n\t\x0b Z漢", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = LONG[:3000]
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text.encode()) == whole == fingerprint(text)


def components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("dense", [0, 3, 64])
def test_links_give_the_components_of_hamming_two(spark, dense):
    rnd = random.Random(dense)
    fps = set()
    for _ in range(25):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            x = base
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
            if rnd.random() < 0.5:
                base = x
    want = components(list(fps))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    from colloq.operators.graph import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(df, dense=dense)).collect()}
    name = lambda x: got.get(signed(x), signed(x))
    for a in fps:
        for b in fps:
            assert (want[a] == want[b]) == (name(a) == name(b))


def test_near_duplicates_on_awkward_rows(spark):
    rows = simhash.near_duplicates(clashing(table(spark, AWKWARD))).collect()
    assert len(rows) == len(AWKWARD)
    text = dict((d, t) for d, t in AWKWARD)
    for r in rows:
        assert r.fingerprint == f"{fingerprint(text[r.doc_id]):016x}"
    got = {r.doc_id: r.component_id for r in rows}
    assert got[1] == got[2] == got[8] == 1 and got[3] == got[4] == got[5] == 3 and got[None] is None
    assert simhash.near_duplicates(table(spark, AWKWARD).limit(0)).count() == 0


def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: fingerprint(t) for d, t in texts.items()}
    part = components(list(fps.values()))
    least = {}
    for d in sorted(fps):
        least.setdefault(part[fps[d]], d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{f:016x}", least[part[f]]) for d, f in fps.items()}
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).select(F.col("doc_id")).collect()}
    assert kept == set(least.values())
