"""The n-gram join, the filter audit and the whitening against brute force, with every awkward case."""

import random
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from helpers import AWKWARD, clashing, lower, table, words

from colloq.llm import filter_audit, ngram_join, whitening


# --- n-gram join


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())


def plain_components(rows, percent=90):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[find(i)].append(doc_id)
    least = {p: min((x for x in ids if x is not None), default=None) for p, ids in members.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def join_rows(spark, rows, **options):
    return sorted((tuple(r) for r in ngram_join.joined(table(spark, rows), **options).collect()), key=repr)


def families(seed, n, length=60, vocabulary=400):
    """Texts with edits of a few words, so that similarities lie on both sides of the threshold, and chains of edits."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(names) for _ in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, 12)):
            texts.append(" ".join(base))
            base = list(base) if rng.random() < 0.5 else base
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(names)
            if rng.random() < 0.2:
                base = base + [rng.choice(names)]
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts[:n])]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = families(seed, 250)
    assert join_rows(spark, rows) == plain_components(rows)


def test_join_at_another_threshold(spark):
    rows = families(3, 120, length=25, vocabulary=60)
    assert join_rows(spark, rows, percent=70) == plain_components(rows, 70)


def test_join_of_a_dense_family_and_near_misses(spark):
    """One family whose members are linked through others, and one whose members are all just under the threshold."""
    base = [f"b{i}" for i in range(80)]
    linked = [(i, " ".join([*base[: i % 70], f"x{i}", *base[i % 70 + 1 :]])) for i in range(60)]
    apart = [(1000 + i, " ".join(f"c{j}" if j % 20 or not i else f"y{i}-{j}" for j in range(80))) for i in range(40)]
    assert join_rows(spark, linked + apart) == plain_components(linked + apart)


def test_join_of_equal_prefixes(spark):
    """Groups of several different sets: rare words first, then common ones that differ."""
    common = [f"k{i}" for i in range(40)]
    rows = [(i, " ".join(random.Random(i).sample(common, 40))) for i in range(30)]
    rows += [(100 + i, "p q r s t u v w x y z " + " ".join(common[:29] if i % 2 else common[1:30])) for i in range(10)]
    assert join_rows(spark, rows) == plain_components(rows)


def test_join_awkward(spark):
    rows = [r[:2] for r in AWKWARD] + [(20, "a b"), (21, "A\tB"), (22, "a"), (23, "A"), (24, "a b c"), (25, "ha ha ha"), (26, "ha ha ha ha HA ha")]
    expected = plain_components(rows)
    assert join_rows(spark, rows) == expected
    named = clashing(table(spark, rows))
    assert sorted((tuple(r) for r in ngram_join.joined(named).collect()), key=repr) == expected
    assert join_rows(spark, []) == []
    assert join_rows(spark, [(None, "one two three"), (None, "one two three")]) == [(None, 1, None), (None, 1, None)]


def test_join_whatever_the_partitions(spark):
    rows = families(5, 100)
    once = {tuple(r) for r in ngram_join.joined(table(spark, rows).repartition(1)).collect()}
    assert once == {tuple(r) for r in ngram_join.joined(table(spark, rows).repartition(7)).collect()}


def test_numbers_of_many_words():
    """Triples of so many numbers that three don't fit in 63 bits."""
    a, b, c = np.array([5, 5, 1, 5]), np.array([7, 7, 2, 7]), np.array([9, 9, 3, 8])
    for base in (10, 1 << 30):
        found = ngram_join._different(a, b, c, base)
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == [(1, 2, 3), (5, 7, 8), (5, 7, 9)]


# --- filter audit


def failed(rows):
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = words(t)
        earlier = doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in rows)
        tests = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), earlier
        out.append({name for name, hit in zip("ABCDE", tests, strict=True) if hit})
    return out


def plain_audit(rows, labels):
    good, toxic = ({d for d, *flags in labels if d is not None and flags[k] == 1} for k in (0, 1))
    fails, out = failed(rows), {}
    parts = {s or "" for *_, s in rows}
    for part in parts:
        mine = [(rows[i][0], fails[i]) for i in range(len(rows)) if (rows[i][2] or "") == part]
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                total[name] += len(gone)
                n_failing = sum(name in f for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), n_failing - len(gone), sum(f == {name} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    table_of_labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = filter_audit.audit(docs, table_of_labels).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.EDGE_COUNTS, "shapley")] for r in rows}, rows


def audit_rows():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(["Ab", "cd", "ef", f"g{i}", f"h{rng.random()}"]) for _ in range(rng.choice([0, 5, 150, 250, 400])))
        rows.append((i, text + rng.choice(["", "", " 5%", " $"]), rng.choice(["s1", "s1", "s2", None, ""])))
    return rows + [(100 + i, rows[i][1], "s3") for i in range(0, 60, 4)]


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    got, all_rows = audited(spark, table(spark, rows), labels)
    assert got == plain_audit(rows, labels)
    assert len(all_rows) == len(got) == 600 * len({s or "" for *_, s in rows})


def test_audit_awkward(spark):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in AWKWARD] + [(30, None, None), (31, "", "t"), (None, "", "t"), (32, None, "t")]
    labels = [(1, 1, 0), (8, 1, 1), (7, 0, 1)]
    expected = plain_audit(rows, labels)
    assert audited(spark, clashing(table(spark, rows)), labels)[0] == expected
    assert audited(spark, table(spark, []), labels)[0] == {}
    assert audited(spark, table(spark, rows), [])[0] == plain_audit(rows, [])


def test_lattice():
    assert len(filter_audit.lattice()) == 80 and len(set(filter_audit.lattice())) == 80


# --- whitening


VECTORS = "vec_id bigint, embedding array<double>"


def whitened(spark, rows, partitions=3, schema=VECTORS):
    df = spark.createDataFrame(rows, schema).repartition(partitions)
    return [r.asDict() for r in whitening.whiten(df).orderBy("vec_id", "component").collect()]


def plain_whitening(rows):
    """Covariance in exact fractions, eigenvectors by numpy's own solver."""
    valid = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in valid)
    valid = [(i, x + [0] * (width - len(x))) for i, x in valid]
    fit = sorted({tuple(x) for _, x in valid})
    n = len(fit)
    s = [sum(x[k] for x in fit) for k in range(width)]
    cov = np.array([[float(sum(Fraction(n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / n**3) for j in range(width)] for i in range(width)])
    e, v = np.linalg.eigh(cov)
    return valid, n, s, e[::-1], v[:, ::-1]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    scales = np.array([3.0, 1.0, 0.5, 0.25, 0.1, 0.02])
    rows = [(i, (rng.normal(size=6) * scales + 5).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(90)]
    got, (valid, n, s, e, v) = whitened(spark, rows), plain_whitening(rows)
    assert len(got) == 4 * len(rows)
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, x in valid:
        gap = np.array([n * a - b for a, b in zip(x, s, strict=True)], dtype=float)
        for k in range(4):
            r, expected = by[i, k + 1], gap / n @ v[:, k] / np.sqrt(e[k])
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            sign = signs.setdefault(k, np.sign(r["whitened"] * expected))
            assert abs(r["whitened"] * sign - expected) < 1e-9 * max(1, abs(expected))
            assert abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-10 and r["identity_error"] < 1e-9


def test_whitening_drops_and_repeats(spark):
    rows = [(1, [0.5, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (None, [2.0, -1.0]), (6, [0.5, 1.0]), (7, [-3.0, 0.25]), (7, [-3.0, 0.25])]
    got = whitened(spark, rows)
    assert [(r["vec_id"], r["component"]) for r in got] == [(None, 1), (None, 2), (1, 1), (1, 2), (6, 1), (6, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert {r["n"] for r in got} == {3}


def test_whitening_without_variance(spark):
    got = whitened(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])
    assert len(got) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    line = whitened(spark, [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(5)])
    assert {r["whitened"] for r in line if r["component"] > 1} == {0.0}
    assert abs(sum(r["whitened"] ** 2 for r in line if r["component"] == 1) / 5 - 1) < 1e-12


def test_whitening_of_nothing(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == [] and whitened(spark, [(1, [])]) == []


def test_whitening_of_uneven_and_huge_vectors(spark):
    rows = [(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 1.0, 4.0]), (4, [0.0, 7.0])]
    got = whitened(spark, rows)
    assert {r["n"] for r in got} == {3} and len(got) == 12
    big = whitened(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])])
    assert [r["deviation"] for r in big] == [None] * 4 + [r["deviation"] for r in big[4:]] and big[0]["identity_error"] < 1e-4


def test_whitening_ignores_other_columns(spark):
    rows = [(1, [0.5, 1.0], 9, 9), (2, [2.0, 1.0], 8, 8), (3, [0.0, 7.0], 7, 7)]
    plain = whitened(spark, [r[:2] for r in rows])
    assert whitened(spark, rows, schema=VECTORS + ", x int, n int") == plain


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(40, 5)))
    v, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    lengths = np.array([1e6, 1e3, 1.0, 1e-3, 1e-6])
    _, found = whitening.jacobi(whitening.triangle(q * lengths @ v.T))
    assert np.allclose(found[:3], lengths[:3], rtol=1e-9)
    graded = np.triu(rng.normal(size=(9, 9)))
    components, found = whitening.jacobi(graded)
    assert np.allclose(found, np.linalg.svd(graded, compute_uv=False)) and np.allclose(components.T @ components, np.eye(9))
