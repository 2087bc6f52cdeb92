"""Conversation trie, vector codes and language model against brute force, on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from encaje.llm import codes, lm, trie


# --- trie -----------------------------------------------------------------------------------------

def brute_nodes(rows, rebuild=True):
    conv = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            conv[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    seq = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        seq[c] = own.get(c - c % 100, [])[:h] + turns[h:] if rebuild else turns
    members, children = defaultdict(list), defaultdict(set)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[:d - 1])].add(tuple(s[:d]))
    saved, leaves = Counter(), Counter()
    for key in sorted(members, key=len, reverse=True):
        leaves[key] += not children[key]
        if key:
            saved[key] += (len(members[key]) - 1) * len(key[-1][1])
            saved[key[:-1]] += saved[key]
            leaves[key[:-1]] += leaves[key]
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string")


def found_nodes(df, **options):
    return sorted(tuple(-1 if x is None else x for x in r)
                  for r in trie.prefix_nodes(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"segment": 2, "rows": 7, "fan": 2},
                                     {"segment": 3, "rows": 5, "fan": 2, "rebuild": False}])
def test_trie_equals_brute_force(spark, options):
    draw = random.Random(5)
    rows = [(c, draw.choice([None, t, t]), draw.choice(["user", None]), draw.choice(["a", "b", None, "éß"]))
            for c in draw.sample(range(300), 40) for t in range(draw.choice([1, 2, 4, 9]))]
    rows += [*rows[:3], (None, 1, "user", "lost")]
    assert found_nodes(conversations(spark, rows), **options) == brute_nodes(rows, options.get("rebuild", True))


def test_trie_of_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 60) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in (70, 71) for t in range(40)] + [(72, 0, "user", "other")]
    want = brute_nodes(rows, rebuild=False)
    assert found_nodes(conversations(spark, rows), rebuild=False, segment=4, rows=9, fan=3) == want
    assert found_nodes(conversations(spark, rows).limit(0)) == []


def test_spines_keep_strict_minima_only():
    assert trie._spines([3, 3, 1, 2, 1, 4, 5]) == [0, 2, 4, 5, 6]
    assert trie._spines([2, -1, 7, -1, 3]) == [0, 1, 3, 4]


# --- vector codes -----------------------------------------------------------------------------------

def test_tree_assignment_is_exact():
    rng = np.random.default_rng(0)
    for n, kind in itertools.product((1, 2, 33, 700), range(3)):
        points = rng.integers(-50, 50, (n, 4)) if kind < 2 else rng.integers(0, 2, (n, 4))
        if kind == 1:
            points[:n // 2] = points[0]
        entries = points[rng.integers(0, n, min(n, 16))].copy()
        tree = codes.Tree(points, 8)
        code, total, count = codes.assign(tree.order, tree.nodes, tree.sums, tree.radius, points, entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (code == want).all()
        for e in range(len(entries)):
            assert count[e] == (want == e).sum() and (total[e] == points[want == e].sum(0)).all()


def test_balls_hold_their_points_and_most_are_owned():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 2, (200, 2)) for c in (0, 100, 200)]).astype(np.int64)
    tree = codes.Tree(points, 8)
    for (start, n, *_), total, radius in zip(tree.nodes, tree.sums, tree.radius):
        mine = points[tree.order[start:start + n]]
        assert (mine.sum(0) == total).all()
        assert np.sqrt(((mine - total / n) ** 2).sum(1)).max() <= radius
    far = np.sqrt(((tree.sums[0] / 600 - points) ** 2).sum(1)).max()
    assert tree.radius[0] >= far


def brute_codes(rows, parts, entries, rounds):
    kept = sorted((i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
                  if v is not None and all(x is not None and math.isfinite(x) for x in v))
    data = np.array([q for _, q in kept])
    width = data.shape[1] // parts
    books, codes_, error = [], [], np.zeros(len(data), np.int64)
    for p in range(parts):
        x = data[:, p * width:(p + 1) * width]
        book = x[:entries].copy()

        def near():
            return ((x[:, None] - book[None]) ** 2).sum(2)
        for _ in range(rounds):
            at = near().argmin(1)
            for e in range(len(book)):
                if (at == e).any():
                    book[e] = [int(s) // int((at == e).sum()) for s in x[at == e].sum(0)]
        codes_.append(near().argmin(1))
        error += near().min(1)
        books.append(book)
    return {i: ("".join(f"{c[k]:02x}" for c in codes_), int(error[k])) for k, (i, _) in enumerate(kept)}, books


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist(), i % 3 if i % 5 else None) for i in range(300)]
    rows += [(i, [0.5] * 8, 1) for i in range(300, 420)]  # a hot vector
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [float("nan")] * 8, None),
             (903, [float("inf")] * 8, 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows],
                               "vec_id long, embedding array<float>, label int, code string").repartition(5)
    coded, books = codes.compress(df, codes.Settings(parts=4, entries=12, rounds=2, block=64, leaf=8))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label)
            for i, v, label in rows]
    want, want_books = brute_codes(rows, 4, 12, 2)
    got = codes.with_label_error(coded).collect()
    assert {r.id: (r.code, r.error) for r in got} == want and len(got) == len(want)
    assert all((a == b).all() for a, b in zip(books, want_books))
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got)
    assert codes.digest(books) == hashlib.sha256(
        ",".join(str(x) for b in want_books for x in b.ravel()).encode()).hexdigest()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = codes.compress(spark.createDataFrame([], schema))
    assert coded.count() == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    rows = [(None, [1.0] * 16, 0), (1, [2.0] * 16, None), (1, [2.0] * 16, None), (2, [1.0] * 3, 0),
            (3, [1e30] * 16, 0)]
    coded, _ = codes.compress(spark.createDataFrame(rows, schema))
    got = Counter((r.id, r.code, r.error) for r in coded.collect())
    assert got[(2, None, None)] == 1 and got[(3, None, None)] == 1
    assert got[(1, "00" * 16, 0)] == 2 and sum(got.values()) == 5


# --- language model ------------------------------------------------------------------------------------

def documents(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(260):
        word, text = draw.choice(words), []
        for _ in range(draw.randrange(0, 40)):
            text.append(word)
            word = words[(words.index(word) * 3 + draw.choice([1, 1, 1, 2, 7])) % 40]
        rows.append((i, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "ÀB Àb àB"), (None, "w1 w2"),
             (5, "w1 w1"), (5, "w1 w1"), (1004, "w1 " * 5000), (1005, "never seen anywhere")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, order):
    rows, df = documents(spark)
    settings = lm.Settings(order=order, block_bytes=2000, task_keys=500)
    got = lm.score(df.repartition(3), settings).collect()
    train = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[(i, held(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in got) == want
    assert all(r.score < 0 for r in got)
    if order > 1:  # the next word follows from the last one
        tested = [r for r in got if r.held_out and r.n_tokens > 5]
        assert sum(r.score for r in tested) > sum(r.base_score for r in tested) * 0.8


def test_score_equals_the_formula_with_learned_weights(spark, monkeypatch):
    rows, df = documents(spark)
    seen = {}
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: seen.setdefault("w", learn(*a)))
    got = {r.doc_id: r.score for r in lm.score(df, lm.Settings(block_bytes=3000)).collect()}
    one, two, docs = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w))
            docs += 1
    n, v, weights = sum(one.values()), len(one), seen["w"]
    known = [b for b in weights if b >= 0]

    def probability(before, word):
        context = docs if before is None else one[before]
        bucket = 64 + int(math.log2(context)) if context else 0
        like = [b for b in known if b // 64 == bucket // 64]
        mix = weights[min(like, key=lambda b: (abs(b - bucket), b))] if like else weights[-1]
        return (mix[0] / (v + 1) + mix[1] * one[word] / n
                + (mix[2] * two[(before, word)] / context if context else 0))

    for i, t in rows:
        if i != 5:
            w = tokens(t)
            assert got[i] == pytest.approx(sum(
                math.log10(probability(a, b)) for a, b in zip([None, *w], w)), rel=1e-9)
    for before in (None, b"w1", b"w7", b"unknown"):  # shares of all words and of one unknown word sum to one
        assert sum(probability(before, w) for w in one) + probability(before, b"unknown!") == pytest.approx(1)


def test_language_model_of_nothing(spark):
    _, df = documents(spark)
    assert lm.score(df.limit(0)).count() == 0
    only = lm.score(df.where("doc_id = 1005")).collect()  # alone, whichever side it is on
    assert len(only) == 1 and only[0].n_tokens == 4


def test_packed_numbers_come_back():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 999).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all()
    small = rng.integers(0, 300, 50).astype(np.uint32)
    assert (lm.unpack(lm.pack(small), np.uint32) == small).all()
