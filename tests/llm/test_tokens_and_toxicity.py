"""BPE, edit-aware counts and toxicity: exact round trips and held-out accuracy."""

import random

import pytest
import public_tokenizers
from helpers import AWKWARD, CLASHING, clashing, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloq.llm import bpe, edit_counts, lexicon, toxicity
from colloq.llm.queries import op8_toxicity, vocabulary_text

TEXT = vocabulary_text()
VOCABULARY = bpe.Vocabulary(TEXT)
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = st.lists(st.sampled_from(["a", "the ", " x", "'ll", "'s", "é", "漢", "🙂", " ", " ", "\u0085", "\x1c", "9", "²", " ", "  ", "\n", "\t", "!", "_", "<|endoftext|>", "<|endo"]), max_size=30).map("".join)
ALPHABET = ["a", "the ", " x", "'s", "é", "9", " ", "\n", "!", "  "]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_encoder_matches_the_library(text):
    e = bpe.Encoder(VOCABULARY)
    assert e.ids(text) == ids(text)
    assert e.decode(e.ids(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "!" * 999, "the" * 700 + "é" * 300])
def test_long_words(text):
    assert bpe.Encoder(VOCABULARY).ids(text) == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), min_size=1, max_size=4), max_size=40))
def test_lexicon_gives_back_its_entries(entries):
    lex = lexicon.Lexicon(lexicon.compile_lexicon(entries.items()))
    assert all(lex.ids(w) == x for w, x in entries.items())
    assert all(lex.ids(w + b"~") is None for w in entries if w + b"~" not in entries)


def test_lexicon_shares_suffixes():
    entries = [(f"{a}{b}ing".encode(), [1]) for a in "abcdefgh" for b in "xyz"]
    assert lexicon.Lexicon(lexicon.compile_lexicon(entries)).states <= 7


def test_lexicon_does_not_change_ids():
    entries = [(w.encode(), VOCABULARY.merge(w.encode())) for w in ("the", " the", " x", "aa")]
    e = bpe.Encoder(VOCABULARY, lexicon.Lexicon(lexicon.compile_lexicon(entries)))
    assert e.ids("the the x aa bb") == ids("the the x aa bb")


def test_encode_awkward_rows(spark):
    docs = clashing(table(spark, [*AWKWARD, (12, "x <|endoftext|> y")]))
    out = bpe.encode(docs, TEXT, top=50)
    assert [c for c in out.columns if c in CLASHING and c != "ids"] == [c for c in CLASHING if c != "ids"]
    import hashlib

    rows = out.collect()
    assert len(rows) == len(AWKWARD) + 1
    for r in rows:
        want = ids(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and r.n_words == "own n_words"
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = {(r.doc_id, r.n_tokens): r.text for r in bpe.decode(out, TEXT).collect()}
    assert back == {(r.doc_id, r.n_tokens): r.text or "" for r in rows}
    assert bpe.encode(docs.limit(0), TEXT, top=50).count() == 0


def test_frequent_words_cover_all_documents(spark):
    docs = table(spark, [(i, "often " * 3 + f"rare{i}") for i in range(50)])
    got = {r.word: r.n for r in bpe.frequent_words(docs, 100).collect()}
    assert got[" often"] == 100 and got["often"] == 50
    # with few counters the counts are lower bounds, but frequent words stay
    assert [r.word for r in bpe.frequent_words(docs, 2).collect()][0] == " often"


def random_edits(rnd, size, special):
    cuts = sorted(rnd.randint(0, size) for _ in range(2 * rnd.randint(0, 3)))
    extra = ["<|endoftext|>"] if special else []
    return [(cuts[i], cuts[i + 1], "".join(rnd.choice(ALPHABET + extra) for _ in range(rnd.randint(0, 3)))) for i in range(0, len(cuts), 2)]


@pytest.mark.parametrize("leaf", [1, 2, 32])
def test_edited_trees_count_like_fresh_ones(monkeypatch, leaf):
    monkeypatch.setattr(edit_counts, "LEAF", leaf)
    counter, rnd = edit_counts.Counter(VOCABULARY), random.Random(leaf)
    for k in range(250):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 200)))
        tree = edit_counts.Tree.of(text, counter)
        assert tree.n_tokens == len(ids(text))
        for _ in range(3):
            tree = tree.edited(random_edits(rnd, len(tree.text), k % 10 == 0), counter)
            assert tree.n_tokens == len(ids(tree.text)) == sum(tree.counts)
            assert tree.sums == edit_counts.tree_sums(tree.counts)


def test_an_edit_reencodes_little():
    counter = edit_counts.Counter(VOCABULARY)
    tree = edit_counts.Tree.of("some words in a long text. " * 500, counter)
    after = tree.edited([(6000, 6004, "other")], counter)
    assert after.encoded <= 3 * edit_counts.LEAF < tree.encoded / 20


def test_edits_must_be_sorted():
    counter = edit_counts.Counter(VOCABULARY)
    with pytest.raises(ValueError, match="sorted"):
        edit_counts.Tree.of("abcdef", counter).edited([(3, 4, ""), (1, 2, "")], counter)


def test_counts_and_edits_on_tables(spark):
    docs = clashing(table(spark, [*AWKWARD, (20, "mail bob@example.com or 10.0.0.1 now")]))
    state = edit_counts.build(docs, TEXT)
    edits = spark.createDataFrame([(1, 0, 3, "Two"), (1, 4, 4, "and "), (6, 5, 9, "beyond"), (3, 0, 0, "new text")], "doc_id bigint, start int, stop int, new string")
    got = edit_counts.apply_edits(state, edits, TEXT).collect()
    assert len(got) == len(AWKWARD) + 1
    texts = {r.doc_id: r.text for r in got}
    assert texts[1] == "Two and two three four five six seven." and texts[6] == "xbeyond" and texts[3] == "new text"
    assert all((r.sums[1] if len(r.sums) > 1 else 0) == len(ids(r.text)) for r in got)
    counted = {r.doc_id: r for r in edit_counts.counted_edits(docs, TEXT).collect()}
    assert counted[20].n_edits == 2 and counted[20].n_tokens == len(ids("mail [email] or [address] now"))
    assert counted[3].n_tokens == 0 and counted[7].n_reencoded == 0
    assert edit_counts.counted_edits(docs.limit(0), TEXT).count() == 0 and edit_counts.build(docs.limit(0), TEXT).count() == 0


INSULTS = dict.fromkeys(("idiot", "worthless", "pathetic", "scum"), 4.0)


def clause(text):
    return toxicity.Model(INSULTS).clause(toxicity.WORD.findall(text.lower()))


def test_grammar_weighs_whole_clauses():
    plain, targeted = clause("what an idiot"), clause("you idiot")
    assert clause("a nice day") == 0 and clause("kill the process") == 0
    assert targeted > plain > clause("not an idiot") > 0
    assert plain > clause("she wrote that an idiot came") > 0
    assert clause("i will kill you") > 0
    assert clause("idiot you are") > plain


def brute_clause(symbols, weight, threat):
    """The grammar's rules read off positions: distances to the nearest word of a class, no states."""
    total = 0.0
    for i, s in enumerate(symbols):
        back = lambda kind, reach: any(symbols[j] == kind for j in range(max(0, i - reach), i))
        reported = 0.5 if "report" in symbols[:i] else 1.0

        def value(k):
            before = 1.3 if any(symbols[j] == "target" for j in range(max(0, k - 4), k)) else 1.0
            negated = 0.4 if any(symbols[j] == "negation" for j in range(max(0, k - 3), k)) else 1.0
            return weight * before * negated * (0.5 if "report" in symbols[:k] else 1.0)

        if s == "insult":
            total += value(i)
        if s == "target":
            since = max((j for j in range(i) if symbols[j] == "target"), default=-1)
            recent = lambda kind: [j for j in range(max(since + 1, i - 3), i) if symbols[j] == kind]
            total += 0.3 * value(recent("insult")[-1]) * reported if recent("insult") else 0.0
            total += threat * reported if recent("threat") and back("threat", 3) else 0.0
    return total


def test_the_composed_machine_matches_the_rules():
    rnd = random.Random(17)
    said = {"insult": "idiot", "target": "you", "negation": "not", "report": "said", "threat": "kill", "other": "tree"}
    model = toxicity.Model(INSULTS, threat=2.5)
    for _ in range(20_000):
        symbols = rnd.choices(list(said), weights=[3, 3, 2, 1, 2, rnd.choice([1, 6])], k=rnd.randint(0, 12))
        assert abs(model.clause([said[s] for s in symbols]) - brute_clause(symbols, 4.0, 2.5)) < 1e-9, symbols
    assert len(toxicity.composed()) > 100


def test_toxicity_on_awkward_rows(spark):
    docs = clashing(table(spark, [*AWKWARD, (30, "you are a worthless idiot and pathetic scum")]))
    model = toxicity.Model(INSULTS)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(AWKWARD) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    best = max(rows, key=lambda r: r.score)
    assert best.doc_id == 30 and best.predicted == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (2, 1, None), (404, 1, 1)], "doc_id bigint, quality int, toxic int")
    for part in (labels, labels.limit(0)):
        learned = toxicity.fit(docs, part)
        assert not set(INSULTS) & set(learned.entries)  # no word but from the training rows
        assert toxicity.score(docs, learned).count() == len(rows)


def test_the_grammar_beats_a_count_of_words():
    """Clauses with the same insult, half of them negated or reported: a flat count can't tell them apart."""
    rnd = random.Random(23)
    filler = ["tree", "river", "walks", "slowly", "window", "paper"]
    machine, flat, toxic = [], [], []
    for i in range(2000):
        words = [rnd.choice(filler) for _ in range(rnd.randint(2, 6))]
        at = rnd.randrange(len(words) + 1)
        kind = rnd.choice(["target", "plain", "negated", "reported"])
        said = {"target": ["you", "idiot"], "plain": ["idiot"], "negated": ["not", "an", "idiot"], "reported": ["said", "an", "idiot"]}[kind]
        words[at:at] = said
        machine.append(toxicity.Model(INSULTS).clause(words) if i < 300 else None)
        flat.append(sum(w in INSULTS for w in words))
        toxic.append(kind in ("target", "plain"))
    seen = [(m, t) for m, t in zip(machine, toxic, strict=True) if m is not None]
    good, bad = [m for m, t in seen if t], [m for m, t in seen if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert set(flat) == {1} and auc > 0.99


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = op8_toxicity(spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    tp = sum(r.toxic and r.predicted for r in rows)
    assert tp / sum(r.predicted for r in rows) > 0.95 and tp / sum(r.toxic for r in rows) > 0.9
    good, bad = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    wrong = scored.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2))
    assert wrong.isEmpty()
