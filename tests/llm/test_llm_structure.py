"""Merkle manifest, conversation repair and SimHash against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from mailspark.llm import conversations, merkle, oracle, simhash

CLASH = ("grp bigint, n int, lo int, hi int, digest string, path string, kids string, rank int, _at int, t int, "
         "key string, fp string, id int, least int, pending int, part int, number int, piece string, kind int, copies int")
EXTRA = (1, 2, 3, 4, "d", "p", "k", 5, 6, 7, "key", "fp", 8, 9, 10, 11, 12, "piece", 13, 14)


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ------------------------------------------------------------------ manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """Root, and per leaf its siblings level by level as (left, right)."""
    paths, own, now = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(now) > 1:
        up, covers = [], []
        for i in range(0, len(now), 3):
            run = now[i:i + 3]
            for j in range(len(run)):
                for leaf in own[i + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(H("".join(run)))
            covers.append(sum(own[i:i + 3], []))
        now, own = up, covers
    return now[0], paths


def manifest(rows):
    def leaf(r, text):
        return H("".join(field(x) for x in (*r[:4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = [sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in names]
    trees = [tree([leaf(r, r[4]) for r in g]) for g in ordered]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (sub, paths), up in zip(ordered, trees, above):
        for r, path in zip(g, paths):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for a, b in path + up:
                folded = H(a + folded + b)
            out.append((r[0], leaf(r, r[4]), sub, root, H("".join(a + b for a, b in path + up)), folded, folded == root))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows],
                                 "doc_id bigint, source string, lang string, n_chars bigint, text string, " + CLASH)


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_manifest(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "", None]), rng.choice(["en", None]), rng.choice([1, None]),
             rng.choice([None, "", "x", "é\n\ny", "a\nb", "\n"])) for i in range(70)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, "t\n"), (7, "a", "en", 1, "other"), (3, "z", "", 0, "w\n" * 300_000)]
    rows += rows[:40] + rows[:1] * 30
    rng.shuffle(rows)
    df = documents(spark, rows)
    assert sorted_rows(merkle.manifest_digest(df).collect()) == sorted_rows(manifest(rows))


@pytest.mark.parametrize("rows", [[], [(5, "s", "en", 1, "a\nb")], [(1, "s", None, 0, "x"), (2, None, None, 0, "x")]])
def test_manifest_of_few(spark, rows):
    got = merkle.manifest_digest(documents(spark, rows)).collect()
    assert sorted_rows(got) == sorted_rows(manifest(rows) if rows else [])


def test_manifest_nodes(spark):
    rows = documents(spark, [(i, "s" if i < 11 else "t", None, i, "x") for i in range(13)])
    leaves = rows.select("source", "doc_id", merkle.leaf_digest(merkle.COLUMNS).alias("digest"))
    made = merkle.build_manifest(leaves, "source", "doc_id")
    nodes = [(r.tree, r.grp, r.level, r.lo, r.hi) for r in made.nodes().collect()]
    assert len(nodes) == len(set(nodes)) == 13 + 4 + 2 + 1 + 1 + 2 + 1     # 11: 4, 2, 1; 2: 1; two groups: 1
    for tree_name, grp, level, lo, hi in nodes:
        if level:    # an interval is what its children cover, side by side
            inside = sorted(x[3:] for x in nodes if x[:3] == (tree_name, grp, level - 1) and lo <= x[3] and x[4] <= hi)
            assert inside[0][0] == lo and inside[-1][1] == hi
            assert all(a[1] == b[0] for a, b in zip(inside, inside[1:]))


def test_crc_in_sql():
    keys = ["0", "17", "-5", "123456789:3", " : "]
    got = duckdb.sql(f"SELECT {oracle._crc32('k')} FROM (SELECT unnest({keys!r}) AS k)").fetchall()
    assert [r[0] for r in got] == [zlib.crc32(k.encode()) for k in keys]


# ------------------------------------------------------------------ conversations

STEP = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def cheapest(rows, faults):
    """All edit sequences, memoised: cost, audit and lines."""
    @functools.lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in "EA" else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in STEP:
                    c, a, o = best(i, STEP[state, role[0]], inserted + 1)
                    options.append((c + 2, "I" + a, (role + ":", *o)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, o = best(i + 1, state, 0)
            options.append((c + 3, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                for edit, price, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if (state, new[:1]) in STEP:
                        c, a, o = best(i + 1, STEP[state, new[:1]], 0)
                        options.append((c + price + late, edit + a, (f"{new}:{text}", *o)))
        return min(options, key=lambda x: x[:2]) if options else (10 ** 9, "", ())
    for i in range(len(rows), 0, -1):      # from the end, so that no call goes deep
        for state in "ESUA":
            best(i, state, 0)
    return best(0, "E", 0)


def repaired(rows):
    groups = {}
    for c, t, role, text in rows:
        mine = groups.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        mine += [(t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for c, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, H(f"{r[1]}:{r[2]}")))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.encode().strip()
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1:] not in (b".", b"!", b"?") else "")
            seen.add((role, text))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(mine, faults)
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    H("\n".join(lines))))
    return out


def talk(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], "conv_id bigint, turn bigint, role string, text string, " + CLASH)


def talks(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for _ in range(rng.choice([1, 2, 5, 12, 40])):
            rows.append((None if c == 3 else c, rng.choice([None, *range(rng.choice([3, 30]))]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["a.", "b", "", " \t", None, "c! ", "d?", "é.\n", "a. x", "e.", "f.\x1c", "g."])))
    return rows + rows[:5]


@pytest.mark.parametrize("size", [2, 128])
def test_repair(spark, size):
    rows = talks(5, 40)
    got = conversations.repair(conversations.damaged(talk(spark, rows)), size).collect()
    assert sorted_rows(got) == sorted_rows(repaired(rows))


def test_one_long_conversation(spark):
    rng = random.Random(1)
    rows = [(9, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 300)}{rng.choice(['.', '.', ''])}") for t in range(400)]
    rows += [(9, 17, "user", "same.")] * 300 + [(2, 0, "user", "long " * 200_000 + ".")]
    got = conversations.repair_digest(talk(spark, rows)).collect()
    assert sorted_rows(got) == sorted_rows(repaired(rows))


def test_repaired_rows_are_what_the_digest_covers(spark):
    rows = [r for r in talks(8, 12) if r[0] is not None]
    hurt = conversations.damaged(talk(spark, rows))
    lines = {}
    for r in sorted(conversations.repaired_rows(hurt, 4).collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.edit in ("keep", "rerole", "insert")
    for r in conversations.repair(hurt, 4).collect():
        mine = lines.get(r.conv_id, [])
        assert H("\n".join(mine)) == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in mine))


def test_no_conversations(spark):
    assert conversations.repair_digest(talk(spark, [])).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = conversations.repair_digest(talk(spark, [(1, dropped, "user", "a.")])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", H(""))]


def test_automaton_on_every_short_signature():
    """Nodes give the least cost and the least of the cheapest audits, and are shared."""
    faults = {"d": "blank"}
    automaton, signatures = conversations.Automaton(), ["".join(x) for n in range(1, 4) for x in itertools.product("dsuaxUS", repeat=n)]
    for sig in sorted(signatures, key=lambda s: s[::-1]):
        rows = [(0, {"x": "tool", "d": "user"}.get(c, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "")), "t") for c in sig]
        cost, audit, _ = cheapest(rows, [faults.get(c, "truncated" if c.isupper() else "") for c in sig])
        table, _, order = automaton.read(sig)[-1]
        tail = [len(t) * 2 for t in conversations.TAIL]
        f = min(range(4), key=lambda f: (table[0][f] + tail[f], order[0].index(f) if f in order[0] else 9))
        assert table[0][f] + tail[f] == cost
        assert automaton.audit(sig, 0, f) + conversations.TAIL[f] == audit
    assert automaton.made == len(signatures)    # one node per distinct suffix


# ------------------------------------------------------------------ simhash


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, radius=4):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_masks_cover_every_pair():
    rng = random.Random(2)
    first = simhash.covering_masks(list(range(64)), 4)
    assert len(first) == 31
    for _ in range(3000):
        at = rng.sample(range(64), 4)
        apart = sum(1 << p for p in at)
        hits = [m for m in first if not m & apart]
        assert hits
        for m in hits:
            free = simhash._free(m)
            assert any(not s & apart for s in simhash.covering_masks(free, 4))
            assert max(len(simhash._free(m | s)) for s in simhash.covering_masks(free, 4)) <= 16


def texts(seed, n):
    rng = random.Random(seed)
    out = [None, "", " \t", "One", "one two THREE", "é É", "a\x0bb c\x1cd e f g"]
    base = [f"w{rng.randint(0, 99)}" for _ in range(200)]
    while len(out) < n:
        t = list(base) if rng.random() < 0.6 else [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = "X" + str(rng.randint(0, 9))
        out.append(rng.choice([" ", "\n ", "\t"]).join(t))
    return out + out[-3:]


@pytest.mark.parametrize("limit", [simhash.BUCKET, 7])
def test_simhash(docs, limit, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 50)
    made = [(i if i % 11 else None, t) for i, t in enumerate(texts(4, 150))] + [(8, "again"), (8, "again")]
    df = docs(made)
    rows = df.selectExpr("doc_id AS id", "text")
    got = [(r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_classes(rows, limit=limit).collect()]
    prints = [by_hand(t) for _, t in made]
    want = list(zip([i for i, _ in made], prints, classes([i for i, _ in made], prints)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_simhash_digest(docs):
    long = "w " * 400_000 + "end"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_digest(docs([None, long, "a b c d", ""])).collect()}
    assert got[0] == ("0" * 16, 0) and got[3] == ("0" * 16, 0)
    assert got[2] == (f"{by_hand('a b c d'):016x}", 2)
    assert got[1] == (f"{by_hand(long):016x}", 1)
    assert simhash.simhash_digest(docs([])).collect() == []


def test_forest_connects_what_is_near():
    rng = random.Random(6)
    values = sorted({sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & (1 << 64) - 1 for _ in range(150)})
    a, b = simhash._forest(np.array(values, np.uint64), 4)
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in zip(a.tolist(), b.tolist()):
        parent[find(x)] = find(y)
    want = classes(values, values)
    assert [min(v for v in values if find(v) == find(x)) for x in values] == want
    assert len(a) == len(values) - len(set(want))
