"""The pipeline: columns, effects of each stage, and agreement of run() with the stages."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
from helpers import AWKWARD, LONG, clashing, lower, table, words
from test_rules_and_dedup import fingerprint, measures
from tokenizers import Tokenizer

from colloq.llm import exact_dedup, mixing, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run_agree(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append((name, docs))
    assert [n for n, _ in held] == ["quality_rules", "exact_dedup", "simhash", "mixing", "bpe"]
    assert all(d.columns == columns for _, d in held[:-1])
    ruled, exact, near, mixed, encoded = (d for _, d in held)
    assert quality_rules.keep_by_policy(ruled).count() == ruled.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert exact_dedup.groups(exact).where("not kept").isEmpty()
    assert simhash.near_duplicates(near).where("component_id <> doc_id").isEmpty()
    assert encoded.count() == mixed.count() > 0
    keys = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    run = cp.run(spark, SF)
    assert sorted(map(tuple, run.select(*keys).collect())) == sorted(map(tuple, encoded.select(*keys).collect()))


def test_empty_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def after_rules(rows):
    """rows: (doc_id, text, source); those that the policy keeps."""

    def fine(text):
        n, chars, symbols, twice, repeated, lines = measures(text)
        return n >= 20 and 100 * repeated <= 30 * n and 10 * symbols <= n and 100 * twice <= 50 * lines and 2 * n <= chars <= 20 * n

    return [r for r in rows if fine(r[1])]


def after_copies(rows):
    best = {}
    for d, t, s in rows:
        key = lower(t)
        best[key] = max(best.get(key, (d, t, s)), (d, t, s), key=lambda r: r[0])
    return sorted(best.values())


def after_near_copies(rows):
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    top = {d: d for d in prints}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def test_stages_match_brute_force(spark, tmp_path):
    """Every stage on its predecessor's rows; the draw by its invariants, the ids by the tokenizers library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    for (name, stage), brute in zip(cp.STAGES[:3], (after_rules, after_copies, after_near_copies), strict=False):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, rows = spark.read.parquet(str(tmp_path / name)), brute(rows)
        assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == rows, name
    drawn = cp.STAGES[3][1](spark, docs, SF)
    copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({d: n for d, n in copies.items() if n})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    texts = {d: t for d, t, _ in rows}
    for r in cp.STAGES[4][1](spark, drawn, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_corpus_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and a very long text."""
    good = " ".join(f"word{i}" for i in range(60))
    varied = " ".join(f"term{i % 9973}x{i}" for i in range(60_000))
    rows = [*AWKWARD, (20, good), (20, good), (21, good.upper()), (22, varied), (None, good + " more"), (23, good.replace("word", "other"))]
    docs = clashing(table(spark, rows))
    columns = docs.columns
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == columns, name
            assert all(r["kept"] == "own kept" for r in docs.collect())
        if name == "exact_dedup":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 21, 22, 23]
    assert len(words(LONG)) > 10_000 and docs.count() > 0
