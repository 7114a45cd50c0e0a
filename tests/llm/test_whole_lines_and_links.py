"""Line dedup, URL filters and preference pairs on the cases that they used to leave out."""

import random
import re

from helpers import clashing, table, words

from colloq.llm import chat_formatting, line_dedup, queries, url_filters
from colloq.session import cut

SF = "/root/testdata/sf0.001"


def removed(rows):
    """rows: (doc_id, text); the removed (doc_id, line) pairs, whatever the number of words."""
    seen, out = [], set()
    for d, i, x in sorted({(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n"))}):
        w = frozenset(words(x))
        if any(5 * len(w) >= 4 * len(y) and 5 * len(y) >= 4 * len(w) and 5 * len(w & y) >= 4 * len(w | y) for y in seen if w):
            out.add((d, i))
        seen.append(w)
    return out


def test_short_lines_match_brute_force(spark):
    """Lines of 0 to 7 different words: equal ones go, and four words of five are similar too."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(9)]
    rows = [(d, "\n".join(" ".join(rnd.choices(vocab, k=rnd.randint(0, 7))) for _ in range(rnd.randint(1, 4)))) for d in range(60)]
    rows += [(100, "p q r s"), (101, "s r q p t"), (102, "All rights reserved."), (103, "All rights reserved.\nnew"), (104, "a b c z z z z z"), (105, "c b a")]
    got = line_dedup.deduplicated(table(spark, rows), min_words=1)
    gone = {(r.doc_id, x.line_no) for r in got.collect() for x in r.removed}
    assert gone == removed(rows) and {(101, 0), (103, 0)} <= gone and (103, 1) not in gone


def test_crowded_words_match_brute_force(spark, monkeypatch):
    """With crowds of three, families go through their words' hubs first, and the rest is compared with all."""
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    bases = [rnd.sample(vocab, 12) for _ in range(6)]
    rows = []
    for d in range(70):
        x = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 3)):
            x[rnd.randrange(len(x))] = rnd.choice(vocab)
        rows.append((d, " ".join(x)))
    got = line_dedup.deduplicated(table(spark, rows))
    assert {(r.doc_id, x.line_no) for r in got.collect() for x in r.removed} == removed(rows)


def test_rows_that_ids_do_not_tell_apart(spark):
    """Rows with one doc_id or none are documents of their own; equal rows share their fate."""
    rows = [(1, "a b c d e\nsame line"), (1, "q r s\nsame line"), (None, "e d c b a\nown"), (None, "z z2"), (None, "z z2"), (5, "same line")]
    docs = table(spark, rows)
    got = sorted((r.doc_id or 99, r.n_removed) for r in line_dedup.deduplicated(docs).collect())
    assert got == [(1, 0), (1, 1), (5, 1), (99, 0), (99, 0), (99, 1)]
    texts = sorted(r.text for r in line_dedup.clean(docs).collect())
    assert texts in (sorted(["a b c d e\nsame line", "q r s", "own", "z z2", "z z2", ""]), sorted(["a b c d e", "q r s\nsame line", "own", "z z2", "z z2", ""]))


def test_very_sparse_ids_and_long_texts(spark):
    long = "\n".join(f"line {i} of many different lines" for i in range(3000))
    rows = [(-(1 << 62), "x y"), (3, long), (1 << 62, "y x\n" + "w " * 100_000 + "v"), ((1 << 62) + 1, "v w")]
    got = {r.doc_id: [(x.line_no, x.by_doc_id) for x in r.removed] for r in line_dedup.deduplicated(table(spark, rows)).collect()}
    assert got[-(1 << 62)] == [] and got[1 << 62] == [(0, -(1 << 62))] and got[(1 << 62) + 1] == [(0, 1 << 62)]


def test_the_query_removes_short_lines(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op1_line_dedup(spark, SF).collect()
    assert {(r.doc_id, int(x.split(":")[0])) for r in got for x in r.removed.split(",") if x} == removed(rows)


def test_rules_judge_link_ends_that_are_no_pages(spark):
    """Uncrawled targets of links and redirects carry their rules; relative targets are those of the page."""
    canonical, refresh = '<link rel="canonical" href="{}">'.format, "<meta http-equiv='refresh' content='0; url={}'>".format
    rows = [
        (1, "http://a.it/1", canonical("http://z.org/es/1")),
        (2, "http://b.it/1", None),
        (3, "http://c.it/1", None),
        (4, "http://d.org/fr/1?q=1", canonical("/es/2")),
        (5, "http://e.org/es2/x/1", refresh("../../es/./3")),
        (6, "https://f.it/1", refresh("//z.org/es/9")),
        (7, "http://g.it/1", canonical("mailto:x@z.org")),
        (8, "http://h.it", canonical("1.html")),
        (9, "http://i.it/1", canonical("https://z.org/fr/1")),
        (10, "http://j.it/a/1", canonical("2")),
        (11, "http://j.it/a/2", canonical("http://z.org/es/5")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    redirects = spark.createDataFrame([("http://b.it/1", "http://z.org/es/2"), ("http://c.it/1", "http://z.net/de/1"), ("http://c.it/1", "http://z.org/es/3"), (None, "http://z.org/es/4")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, redirects).collect()}
    assert len(got) == len(rows)
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "block"}


def test_links_match_union_find(spark):
    """Chains, cycles, forks and uncrawled ends over redirects, canonical links and forms; allow beside block."""
    rnd = random.Random(13)
    hosts, paths = ["a.it", "www.b.it", "m.c.org", "z.org", "x.example.com", "example.net", "y.net"], ["/en/7", "/en/8", "/de/8", "/de/1", "/es/1", "/fr/1", "/fr/1.html", "/fr/2/", "/q?x=1", ""]
    urls = [f"http{rnd.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths]
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

    def parts(url):
        rest = url.partition("://")[2]
        host = rest.split("/")[0].split("?")[0]
        return host, rest[len(host) :].split("?")[0]

    def ruled(url):
        host, path = parts(url)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return rules[max(fits, key=len)] if fits else None

    def form(url):
        host, path = parts(url)
        return re.sub(r"^(www|m)\.", "", host) + re.sub(r"\.html?$", "", re.sub(r"/+$", "", path))

    for _ in range(3):
        crawled = rnd.sample(urls, 40)
        links = {u: rnd.choice(urls) for u in rnd.sample(crawled, 12)}
        hops = [(rnd.choice(urls), rnd.choice(urls)) for _ in range(10)]
        chain = rnd.sample(urls, 6)
        hops += list(zip(chain, [*chain[1:], chain[0]], strict=True))
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b in [*links.items(), *hops]:
            top[find(form(a))] = find(form(b))
        flags = {}
        for u in {*crawled, *links.values(), *(x for hop in hops for x in hop)}:
            flags.setdefault(find(form(u)), set()).add(ruled(u))
        expected = {}
        for i, u in enumerate(crawled):
            group = flags[find(form(u))]
            expected[i] = ruled(u) or ("allow" if "allow" in group else "block" if "block" in group else "allow")
        pages = spark.createDataFrame([(i, u, f'<link rel="canonical" href="{links[u]}">' if u in links else None) for i, u in enumerate(crawled)], "page_id bigint, url string, html string")
        redirects = spark.createDataFrame(hops, "src string, dst string")
        assert {r.page_id: r.verdict for r in url_filters.judge(pages, redirects).collect()} == expected


def test_ties_of_rules_and_long_urls(spark):
    rules = tuple(url_filters.UrlRule(v, p) for v, p in (("block", "a.it/xb"), ("allow", "a.it/xa"), ("block", "it/same"), ("allow", "it/same"), ("block", "b.a.it/"), ("allow", "a.it/qq")))
    long = "http://l.it/" + "x" * 200_000
    rows = [(1, "http://a.it/same"), (2, "http://b.a.it/qq"), (3, long), (4, long + "?q"), (None, None)]
    pages = clashing(spark.createDataFrame([(i, u, None) for i, u in rows], "page_id bigint, url string, html string"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules=rules).collect()}
    assert got == {1: ("it/same", "allow"), 2: ("a.it/qq", "allow"), 3: (None, "allow"), 4: (None, "allow"), None: (None, "allow")}


def test_sparse_conversations_make_pairs(spark):
    """Every conversation makes a pair, whatever its id, and the last one goes on with the first."""
    ids = [-(1 << 62), -5000, 3, *range(10_000, 10_000 + 5000 * 40, 5000), 1 << 62]
    rows = [(c, 0, "assistant", f"{c}") for c in ids]
    said = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.pair_id: r.rejected for r in chat_formatting.format_preferences(chat_formatting.crossed(said)).collect()}
    assert got == {c: f"<|assistant|>\n{d}<|end|>\n" for c, d in zip(ids, [*ids[1:], ids[0]], strict=True)}


def counted_candidates(spark, monkeypatch, rows):
    """The lines that go, and how many pairs of lines were looked at."""
    seen, made = [], line_dedup.candidates
    monkeypatch.setattr(line_dedup, "candidates", lambda *args: seen.append(cut(made(*args))) or seen[-1])
    documents = line_dedup.Numbered(table(spark, rows).selectExpr("cast(doc_id AS BIGINT) AS doc", "text"))
    gone = {(r.doc, r.line_no) for r in line_dedup.removed_lines(documents).collect()}
    return gone, seen[0].count()


def test_a_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Of 300 variants of a line, less than the highest bound of a crowd, most meet its first ones alone."""
    base = [f"w{i}" for i in range(30)]
    rows = [(d, " ".join([*base[: d % 30], f"v{d}", *base[d % 30 + 1 :]])) for d in range(300)]
    rows += [(1000 + d, "\n".join(" ".join(f"o{d}x{j}x{i}" for i in range(30)) for j in range(100))) for d in range(60)]
    gone, pairs = counted_candidates(spark, monkeypatch, rows)
    assert gone == {(d, 0) for d in range(1, 300)} and pairs < 10_000


def test_unlike_long_lines_are_told_apart(spark, monkeypatch):
    """Lines of 180 words that share the words they are posted under, and little else."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(2000)]
    rows = [(d, " ".join(["rare", *rnd.sample(vocab, 180)])) for d in range(200)]
    gone, pairs = counted_candidates(spark, monkeypatch, rows)
    assert not gone and pairs < 100
