"""Decontamination, n-gram join and substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from mailspark.llm import decontaminate, jaccard, substrings
from mailspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(seed, n, vocabulary=40, low=0, high=80):
    """Texts of few words, with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "A", "a"]
    passage = [rng.choice(words) for _ in range(25)]
    out = [None, "", "  \t\n", "one", "One two", "x" * 5000, "\x1c a\x0bb"]
    while len(out) < n:
        t = [rng.choice(words) for _ in range(rng.randint(low, high))]
        if rng.random() < 0.3:
            t[len(t) // 2:len(t) // 2] = passage[rng.randint(0, 5):]
        if rng.random() < 0.4 and len(out) > 10:
            t = (rng.choice(out[7:]) or "").split()
            for _ in range(rng.randint(0, 2)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        out.append(rng.choice((" ", "\n", " \t ")).join(t))
    return out


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (1, 5, 10)])
def test_jaccard_join(docs, n, num, den):
    texts = made(n, 90)
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        k = min(n, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a)
             if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs(texts), n, num, den).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in enumerate(roots(len(texts), links))}


def test_jaccard_in_blocks_and_repeated_rows(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "STAR", 2)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(12)] + [" ".join(base)]
    got = jaccard.link_digest(docs(texts + texts[:1]).union(docs(texts[:2]))).collect()
    assert len(got) == 16 and {r.component_id for r in got} == {0}
    df = docs(texts)
    assert [r.doc_id for r in jaccard.drop_near_duplicates(df).collect()] == [0]
    assert jaccard.drop_near_duplicates(df).columns == df.columns


def test_jaccard_of_a_table_twice(docs, monkeypatch):
    """Chains of texts of which only neighbours are alike, every row repeated."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    rng, texts = random.Random(7), []
    for c in range(4):
        texts += [(c, " ".join(f"c{c}w{j}" for j in range(3 * i, 3 * i + 60))) for i in range(30)]
    rng.shuffle(texts)
    first = {}
    want = {i: first.setdefault(c, i) for i, (c, _) in enumerate(texts)}
    df = docs([t for _, t in texts])
    assert {r.doc_id: r.component_id for r in jaccard.link_digest(df).collect()} == want
    twice = jaccard.link_digest(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and {r.doc_id: r.component_id for r in twice} == want


def test_jaccard_of_nothing(docs):
    assert jaccard.link_digest(docs([])).count() == 0
    assert {r.component_id for r in jaccard.link_digest(docs([None, "", " "])).collect()} == {0, 1, 2}


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("deep", [2048, 1])
def test_substrings(docs, monkeypatch, deep):
    monkeypatch.setattr(substrings, "GROUP_SUFFIXES", deep)
    size, texts = 12, made(3, 70, vocabulary=6)
    first, want = {}, {}
    words = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j:j + size]), i)
    for i, w in enumerate(words):
        keep = [True] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j:j + size])] < i:
                keep[j:j + size] = [False] * size
        left = " ".join(x for x, k in zip(w, keep) if k)
        want[i] = (len(w), keep.count(False), hashlib.sha256(left.encode()).hexdigest(), left)
    assert sum(v[1] for v in want.values()) > 100
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeats_digest(docs(texts), size).collect()}
    assert got == {i: v[:3] for i, v in want.items()}
    left = {r.doc_id: r.text for r in substrings.remove_repeats(docs(texts), size).collect()}
    assert left[0] is None and all(left[i] == want[i][3] for i in want if want[i][1])


def test_substrings_edges(docs):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = docs([(0, long), (1, "x " + long), (2, None), (3, "short"), (None, long), (0, long)])
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.repeats_digest(rows).collect()}
    assert got == {(0, 60_000): 0, (1, 60_001): 60_000, (2, 0): 0, (3, 1): 0, (None, 60_000): 0}
    assert substrings.repeats_digest(docs([])).count() == 0


def test_tree_nodes():
    import numpy as np
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4])
    node = substrings.tree_nodes(words, 3)
    assert node[0] == node[3] and len(set(node[[0, 1, 2, 6]])) == 4 and len(node) == 7


def test_decontamination(spark, docs):
    texts = made(5, 60, vocabulary=200) + ["Zero one two THREE four five six seven eight nine ten, x", "stop", "a stop b"]
    items = [(1, "zero ONE two three-four five six seven eight nine ten eleven"), (2, "stop"), (10, None), (11, "..."),
             (12, " ".join((texts[30] or "").split()[:30])), (20, texts[40]), (21, texts[40]), (22, "never seen words here")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    got = {r.doc_id: r for r in decontaminate.contamination(
        docs(texts), spark.createDataFrame([(*x, "c", 1) for x in items], "item_id bigint, text string, term string, n int")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, hit, seen = split(t), set(), set()
        for item, x in items:
            v = split(x)
            k = min(10, len(v))
            for s in range(len(v) - k + 1 if v else 0):
                for j in range(len(w) - k + 1):
                    if w[j:j + k] == v[s:s + k]:
                        hit.update(range(j, j + k))
                        seen.add(str(item))
        ids = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (
            len(w), len(hit), len(seen), ids, bool(hit)), (i, t)


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    df = docs([(0, "a b c d e f g h i j"), (1, "x"), (None, "a b c d e f g h i j k l"), (0, "a b c d e f g h i j"), (2, None)])
    assert sorted(r.n_hit for r in decontaminate.contamination(df, items).collect()) == [0, 0, 10, 10, 12]
    assert not any(r.contaminated for r in decontaminate.contamination(df, none).collect())
    assert decontaminate.contamination(docs([]), items).count() == 0
    kept = decontaminate.drop_contaminated(df, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == df.columns
    near = decontaminate.proximity_matches(docs(["a b c x d e f g h i j k l"]), items, slop=2).collect()
    assert {r.item_id for r in near} <= {1} and all(r.gap <= 2 for r in near)


def test_signatures_go_only_where_a_pair_can_be(spark, monkeypatch):
    """Of a tile of many sizes, members without another in reach send no signature."""
    sent = []
    schema = "token bigint, id bigint, n int"
    # sizes 10, 20, 40, ... lie in bands of their own; the last three are alike in size
    sizes = [10 * 2 ** i for i in range(17)] + [10 * 2 ** 16 + 1] * 3
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], schema)
    known = spark.createDataFrame([(i, bytearray(8)) for i in range(len(sizes))], "id bigint, bitmap binary")
    merged = spark.createDataFrame([], "id bigint, component bigint")
    stage = jaccard.stage

    def seen(df, name):
        out = stage(df, name)
        if name == "worth":
            sent.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "stage", seen)
    pairs = jaccard._cell_pairs(rows, merged, known, 85, 100, False)
    assert sent and sent[0] <= 2
    assert all(a >= 16 and b >= 16 for a, b in pairs.collect())
