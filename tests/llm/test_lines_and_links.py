"""Line dedup, URL filters, mixing and preference formatting against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import AWKWARD, CLASHING, clashing, table, words

from colloq.llm import chat_formatting, line_dedup, mixing, url_filters

SF = "/root/testdata/sf0.001"


def removed(rows):
    """rows: (doc_id, text); the removed (doc_id, line) pairs."""
    order = sorted({(math.inf if d is None else d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n"))})
    seen, out = [], set()
    for d, i, x in order:
        w = frozenset(words(x))
        if not w:
            continue
        if any(5 * len(w & y) >= 4 * len(w | y) and (e, j) != (d, i) for e, j, y in seen):
            out.add((d, i))
        seen.append((d, i, w))
    return out


def found(df):
    return {(math.inf if r.doc_id is None else r.doc_id, x.line_no) for r in df.collect() for x in r.removed}


def test_lines_match_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    base = [rnd.sample(vocab, rnd.randint(3, 14)) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            x = list(rnd.choice(base))
            if rnd.random() < 0.6:
                x[rnd.randrange(len(x))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                x.append(rnd.choice(vocab))
            rnd.shuffle(x)
            lines.append(rnd.choice([" ", "\t", "  "]).join(x))
        rows.append((d, "\n".join(lines)))
    got = line_dedup.deduplicated(table(spark, rows))
    assert found(got) == removed(rows)
    assert got.count() == len(rows)


def test_lines_of_a_family_of_variants(spark):
    """A common line in many variants: every variant but the first goes, by whichever earlier one."""
    words_ = [f"w{i}" for i in range(30)]
    rows = [(d, " ".join([*words_[: d % 30], f"v{d}", *words_[d % 30 + 1 :]])) for d in range(120)]
    assert found(line_dedup.deduplicated(table(spark, rows))) == removed(rows)


def test_lines_on_awkward_rows(spark):
    docs = clashing(table(spark, [*AWKWARD, (11, "five six seven. four three two One\nnew line of five words")]))
    got = line_dedup.deduplicated(docs)
    assert got.count() == len(AWKWARD) + 1
    by = {r.doc_id: r for r in got.collect()}
    assert [x.line_no for x in by[8].removed] == [0] and [x.line_no for x in by[11].removed] == [0] and by[7].n_removed == 0
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[8] == "" and texts[11] == "new line of five words" and texts[3] is None and texts[10] == "a\nb\n\n c"
    assert all(r[c] == f"own {c}" for r in cleaned.collect() for c in CLASHING)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0 and line_dedup.clean(docs.limit(0)).count() == 0


def test_lines_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(line_dedup.deduplicated(docs)) == removed(rows)


URLS = [
    (1, "https://WWW.Example.com/en/7x"),
    (2, "http://a.example.com/en/8"),
    (3, "http://www.x.org/fr/1"),
    (4, "https://x.org/fr/1.html?utm=1#a"),
    (5, "https://y.net/de/1"),
    (6, "https://b.example.net/de/81"),
    (7, None),
    (8, "no-scheme.org/es/1"),
    (9, "https://z.org/es/1"),
    (10, "https://other.org/it/1"),
    (11, "https://notexample.com/en"),
    (12, "://"),
]
HTML = {
    10: '<head><link rel="canonical" href="https://z.org/es/1"></head>',
    3: '<link href="https://y.net/de/1" rel=canonical>',
    11: "<meta http-equiv='refresh' content='0;url=https://z.org/es/1'>",
}


def pages(spark, extra=()):
    return spark.createDataFrame([(i, u, HTML.get(i)) for i, u in [*URLS, *extra]], "page_id bigint, url string, html string")


def test_urls(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(clashing(pages(spark))).collect()}
    assert got == {
        1: ("www.example.com", "/en/7x", "example.com/en/7", "allow"),
        2: ("a.example.com", "/en/8", "com/en/", "block"),
        3: ("www.x.org", "/fr/1", None, "allow"),
        4: ("x.org", "/fr/1.html", None, "allow"),
        5: ("y.net", "/de/1", "net/de/", "allow"),
        6: ("b.example.net", "/de/81", "example.net/de/8", "block"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("z.org", "/es/1", "org/es/", "block"),
        10: ("other.org", "/it/1", None, "block"),
        11: ("notexample.com", "/en", None, "block"),
        12: ("", "", None, "allow"),
    }


def test_redirects_and_allow_precedence(spark):
    redirects = spark.createDataFrame([("https://other.org/it/1", "https://y.net/de/1"), (None, "x"), ("a", None)], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages(spark, [(10, "https://other.org/it/1")]), redirects).collect()}
    # 10 is linked to a blocked page and to an allowed one: allow wins, also for 11; ruled pages keep their rule
    assert got[10] == "allow" and got[11] == "allow" and got[9] == "block" and got[5] == "allow"
    assert url_filters.judge(pages(spark).limit(0)).count() == 0


def mix(spark, docs, **target):
    tokens = mixing.cut(mixing.tokens_of(docs))
    plan = mixing.mix_plan(tokens, mixing.MixTarget(**target)).collect()
    return {r.source_key: r for r in plan}, tokens.collect()


@pytest.fixture(scope="module")
def sources(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 30)), "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else "small")) for i in range(600)]
    return table(spark, rows)


def test_entropy_target(spark, sources):
    plan, _ = mix(spark, sources, entropy=0.9, max_epochs=0)
    q = [r.weight for r in plan.values()]
    assert abs(sum(q) - 1) < 1e-9
    assert abs(-sum(x * math.log(x) for x in q) - 0.9 * math.log(3)) < 1e-6


def test_repetition_limit(spark, sources):
    plan, _ = mix(spark, sources, entropy=1.0, max_epochs=1.5)
    total = sum(r.tokens for r in plan.values())
    assert abs(max(r.weight * total / r.tokens for r in plan.values()) - 1.5) < 1e-5


def test_partial_pass_is_the_longest_prefix_within_the_quota(spark, sources):
    plan, tokens = mix(spark, sources)
    by = defaultdict(list)
    for t in tokens:
        by[t.source_key].append((t["at"], t.n_tokens))
    for s, r in plan.items():
        room, used, last = r.quota - r.passes * r.tokens, 0, None
        for at, n in sorted(by[s]):
            if used + n > room:
                break
            used, last = used + n, at
        inside = [n for at, n in by[s] if at <= r.cut_at]
        assert sum(inside) == used and len(inside) == sum(1 for at, _ in by[s] if last is not None and at <= last)


def test_draw_follows_the_plan(spark, sources):
    copies = {r.doc_id: r.copies for r in mixing.mixed(sources).collect()}
    drawn = Counter(r.doc_id for r in mixing.draw(sources).collect())
    assert drawn == Counter({d: c for d, c in copies.items() if c})
    assert max(copies.values()) > 1 and min(copies.values()) == 0
    ordered = mixing.draw(sources, with_order=True)
    assert ordered.columns == [*sources.columns, "epoch", "block", "place"]
    assert ordered.groupBy("doc_id").agg({"epoch": "max", "*": "count"}).where("`max(epoch)` <> `count(1)`").isEmpty()


def test_mixing_awkward(spark):
    docs = clashing(table(spark, [(*r, None if i % 3 == 0 else "s") for i, r in enumerate(AWKWARD)]))
    out = mixing.draw(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mixed(docs).count() == len(AWKWARD)
    assert mixing.draw(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    blank = table(spark, [(1, None, "a"), (2, "", "b")])
    assert {r.copies for r in mixing.mixed(blank).collect()} == {0}


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_preference_pairs(spark):
    conv = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "so"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 1, "assistant", "bad"), (3, 0, "user", None), (None, 0, "user", "x")])
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 1), (9, 1, 99), (10, 3, 2)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    got = {r.pair_id: r for r in chat_formatting.format_preferences(chat_formatting.paired(conv, pairs)).collect()}
    r = got[7]
    assert (r.prompt_turns, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nso<|end|>\n" and r.rejected == "<|assistant|>\nbad<|end|>\n"
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "good<|end|>" and r.rejected[slice(*map(int, r.rejected_mask.split(":")))] == "bad<|end|>"
    assert (got[8].prompt_turns, got[8].chosen, got[8].rejected) == (3, "", "")
    assert (got[9].prompt, got[9].rejected, got[9].rejected_mask) == ("", "", "") and got[9].chosen.count("<|end|>") == 3
    assert got[10].prompt == "" and got[10].chosen == "<|user|>\n<|end|>\n"


def brute_pairs(rows):
    """rows: (conv_id, turn, role, text); pair_id -> (prompt, chosen, rejected, masks), turn by turn."""
    convs = defaultdict(dict)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or ""), reverse=True):
        convs[c][t] = (role or "", text or "")
    ids, out = sorted(convs), {}
    say = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        at, spans = 0, []
        for r, t in turns:
            if r == "assistant":
                spans.append(f"{at + len(r) + 5}:{at + len(r) + 5 + len(t) + 7}")
            at += len(say([(r, t)]))
        return ",".join(spans)

    for k, c in enumerate(ids):
        own, other = convs[c], convs[ids[(k + 1) % len(ids)]]
        start = sorted(own)[((c % len(own)) * 7 + 3) % len(own)]
        crossed = {t: x for t, x in own.items() if t < start} | {t: x for t, x in other.items() if t >= start}
        split = next((t for t in sorted({*own, *crossed}) if t not in own or own[t] != crossed.get(t)), math.inf)
        prompt = [own[t] for t in sorted(own) if t < split]
        a, b = ([side[t] for t in sorted(side) if t >= split] for side in (own, crossed))
        out[c] = (len(prompt), say(prompt), say(a), say(b), mask(a), mask(b))
    return out


def test_crossed_conversations_match_brute_force(spark):
    """Sides that part at any turn, in role or text or length, with gaps, repeated turns, nulls and equal stretches."""
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["a", "bb", "é🙂", None, ""])) for c in (*range(-4, 40), 10**12, 1 << 62) for t in range(rnd.randint(1, 7)) if t == 0 or rnd.random() < 0.8 for _ in range(rnd.choice([1, 1, 2]))]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}") for c in (100, 101) for t in range(3 + c % 100)]
    conv = clashing(turns(spark, rows))
    got = {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) for r in chat_formatting.format_preferences(chat_formatting.crossed(conv)).collect()}
    expected = brute_pairs(rows)
    assert got == expected
    assert len({x[0] for x in expected.values()}) > 3 and any(x[2] and not x[3] for x in expected.values()) and any(x[5].count(",") for x in expected.values())


def test_crossed_cases(spark):
    conv = turns(spark, [(5, 0, "user", "a"), (5, 1, "assistant", "b"), (None, 0, "user", "x"), (6, None, "user", "y")])
    assert [(r.pair_id, r.prompt_turns, r.chosen, r.rejected) for r in chat_formatting.format_preferences(chat_formatting.crossed(conv)).collect()] == [(5, 2, "", "")]
    assert chat_formatting.format_preferences(chat_formatting.crossed(conv.limit(0))).count() == 0
    long = turns(spark, [(c, t, "assistant", f"{c if t > 2500 else 0} " + "word " * 20) for c in (1, 2) for t in range(5000)])
    got = {r.pair_id: r for r in chat_formatting.format_preferences(chat_formatting.crossed(long)).collect()}
    assert got[1].prompt_turns >= 2501 and got[1].prompt_turns + got[1].chosen_mask.count(",") + 1 == 5000
    text, spans = got[1].rejected, [tuple(map(int, x.split(":"))) for x in got[1].rejected_mask.split(",")]
    assert all(text[a:b].endswith("<|end|>") and text[a:b].startswith("2 word") for a, b in spans)


def test_sides_meet_by_place(spark):
    """Two conversations of the same start, one numbered from 0 and one from 1 with gaps."""
    conv = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "a"), (2, 1, "user", "hi"), (2, 5, "assistant", "yes"), (2, 9, "user", "b")])
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id bigint, chosen_id bigint, rejected_id bigint")
    r = chat_formatting.format_preferences(chat_formatting.paired(conv, pairs)).first()
    assert (r.prompt_turns, r.chosen, r.rejected) == (2, "<|user|>\na<|end|>\n", "<|user|>\nb<|end|>\n")


def test_causes_do_not_depend_on_the_partitions(spark):
    """A line with equally alike earlier lines names the first of them."""
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(1, 12)]
    seen = [sorted((r.doc_id, tuple(map(tuple, r.removed))) for r in line_dedup.deduplicated(table(spark, rows).repartition(n)).collect()) for n in (1, 5)]
    assert seen[0] == seen[1] and seen[0][1][1] == ((0, 1, 0),)
