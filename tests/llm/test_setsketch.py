import re
from collections import defaultdict

import numpy as np
import pytest

from tallyforge.llm import neighbours, setsketch
from tallyforge.llm.queries import op11_setsketch

_word = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = _word.findall(lower)
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size=2, similar=80):
    """rows: doc_id, text; all pairs that share a shingle, by sets of strings."""
    sets, having = [shingles(t, size) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in having[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= similar * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return ordered((doc, len(s), least.get(root(i)) if s else doc, doc is not None and doc == (least.get(root(i)) if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def edited(rng, words, n):
    """The words with n of them replaced."""
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return out


def made(seed=1):
    """Groups of near copies about the limit, chains of them, copies, and texts apart."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(20, 120)))]
        for n in (0, 1, 2, 3, 5, 8):
            rows.append(" ".join(edited(rng, base, min(n, len(base)))))
        chain = base
        for _ in range(5):
            chain = edited(rng, chain, max(1, len(base) // 20))
            rows.append(" ".join(chain))
    rows += [rows[0]] * 30 + [rows[7].upper(), "one", "ONE", "one two", "two one"]
    order = rng.permutation(len(rows))
    return [(int(i) + 1000, rows[i]) for i in order]


def test_groups_equal_brute_force(spark):
    rows = made()
    assert ordered(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 2).collect()) == brute(rows)


def test_five_words(spark):
    rows = made(2)
    assert ordered(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == brute(rows, 5)


def test_a_large_group_of_near_copies_in_small_cells(spark, monkeypatch):
    """Near copies of which many aren't linked to their bucket's first: cells of few nodes, and sets counted in many parts."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, int(rng.integers(2, 16))))) for i in range(400)]
    whole = neighbours.missed
    monkeypatch.setattr(neighbours, "missed", lambda *a: whole(*a, cell=32))
    monkeypatch.setattr(neighbours, "BITS", 64)
    assert ordered(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()) == brute(rows)


def test_edge_documents(spark, edge_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in edge_documents.collect()]
    assert ordered(setsketch.near_duplicates(edge_documents, 2).collect()) == brute(rows)
    nulls = [(None, "a b c"), (None, "a b c"), (7, "a  B c"), (7, "something else"), (8, "something else"), (None, ""), (None, None)]
    assert ordered(setsketch.near_duplicates(spark.createDataFrame(nulls, "doc_id bigint, text string"), 2).collect()) == brute(nulls)
    assert setsketch.near_duplicates(no_documents, 2).collect() == []


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, where):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = op11_setsketch(spark, where)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and ordered(got.collect()) == brute(rows)


def pair_of(rng, n, similar):
    """Two sets of about n hashes, of that similarity."""
    both = round(n * similar)
    a, b = rng.integers(0, 2**63, both + (n - both) // 2, dtype=np.uint64), rng.integers(0, 2**63, (n - both) - (n - both) // 2, dtype=np.uint64)
    return np.unique(a), np.unique(np.concatenate([a[:both], b]))


@pytest.mark.parametrize("similar", [0.1, 0.5, 0.8, 0.95])
def test_estimates_are_near_and_registers_merge(similar):
    rng, n = np.random.default_rng(9), 256
    errors, equal = [], []
    for _ in range(200):
        a, b = pair_of(rng, 600, similar)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = setsketch.registers(a, n), setsketch.registers(b, n)
        assert (setsketch.registers(np.union1d(a, b), n) == np.maximum(x, y)).all()
        counts = [np.array([c]) for c in ((x > y).sum(), (x < y).sum(), (x == y).sum())]
        errors.append(setsketch.estimate(*counts, np.array([len(a)]), np.array([len(b)]))[0] - true)
        equal.append((x == y).mean())
    deviation = np.sqrt(similar * (1 - similar) / n)
    assert abs(np.mean(errors)) < 4 * deviation / np.sqrt(200) + 0.005 and np.std(errors) < 1.3 * deviation
    # bands meet at least as often as the similarity says
    assert np.mean(equal) > similar - 4 * deviation / np.sqrt(200)


def test_pairs_at_the_limit_share_a_band():
    rng = np.random.default_rng(10)
    for n in (1000, 1_000_000):
        kind, met = setsketch.kind_for(n, 2), 0
        for _ in range(300):
            a, b = pair_of(rng, 300, 0.8)
            keys = kind.keys(np.stack([setsketch.registers(a, kind.size), setsketch.registers(b, kind.size)]))
            met += (keys[0] == keys[1]).any()
        assert met == 300


def test_similar_sets_are_all_of_them():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.95], rng.integers(0, 2**63, int(rng.integers(0, 90)), dtype=np.uint64)])) for _ in range(60)]
    component, ask = rng.integers(0, 9, 60), rng.random(60) < 0.5
    i, j = neighbours.similar_sets(sets, component, ask, 80)
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    expected = {(x, y) for x in range(60) for y in range(60) if ask[x] and not ask[y] and component[x] != component[y] and alike(sets[x], sets[y])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and expected
    assert [len(x) for x in neighbours.similar_sets([np.zeros(0, np.uint64)] * 2, np.arange(2), np.array([True, False]), 80)] == [1, 1]
