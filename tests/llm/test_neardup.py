import random

from civicspark.llm import neardup

VOCAB = [f"w{k}" for k in range(3000)]


def family(rng, size, n=120):
    base = [rng.choice(VOCAB) for _ in range(n)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t))
            rng.choice([lambda: t.__setitem__(k, rng.choice(VOCAB)), lambda: t.pop(k), lambda: t.insert(k, rng.choice(VOCAB))])()
        out.append(" ".join(t))
    return out


def brute(texts):
    sh = {i: set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} for i, t in texts.items() for w in [neardup.words(t)]}
    root = {i: i for i in sh}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sh)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sh[a] & sh[b]) / len(sh[a] | sh[b]) > 0.5:
                root[find(b)] = find(a)
    return {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}


def fixture():
    rng = random.Random(11)
    texts = [t for _ in range(25) for t in family(rng, rng.randint(1, 5))]
    texts += [texts[0].upper().replace(" ", "\n "), "short", "SHORT", "two words", "x " * 400]
    return {f"id{k:03d}": t for k, t in enumerate(texts)}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "id string, text string, group_id string, node int")
    return neardup.edited_copies({"t": (df, "id", "text")}, **more)


def test_groups_against_brute_force(spark):
    texts = fixture()
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    got = {(r.id_a, r.id_b) for r in neardup.group_pairs(run(spark, rows)).collect()}
    assert got == brute(texts)
    split = neardup.group_pairs(run(spark, rows, shard_rows=1, sample=1))  # every shard is split
    assert {(r.id_a, r.id_b) for r in split.collect()} == got


def test_odd_rows(spark):
    rows = [("a", None, None, None), ("b", "", None, None), ("c", " \n", None, None), ("d", "!!!", None, None), (None, "one two three", None, None), ("e", "one two three", None, None), ("e", "one two three", None, None), ("f", "One  two, three.", None, None)]
    got = run(spark, rows).collect()
    assert sorted(r.id for r in got) == ["e", "f"] and len({r.group_id for r in got}) == 1 and all(r.n_texts == 1 for r in got)
    assert [(r.id_a, r.id_b) for r in neardup.group_pairs(run(spark, rows)).collect()] == [("e", "f")]
    assert run(spark, []).count() == 0


def test_tables_stay_apart(spark):
    df = spark.createDataFrame([("a", "one two three four")], "id string, text string")
    g = neardup.edited_copies({"s": (df, "id", "text"), "t": (df, "id", "text")})
    assert neardup.group_pairs(g).count() == 0 and g.count() == 2


def test_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    s = [rng.getrandbits(64) for _ in range(300)]
    s += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in s[:100]] + s[:5]
    tree = neardup.BKTree()
    for x in s:
        tree.add(x)
    for x in s[::7]:
        for radius in (0, 3, 22):
            assert {k for _, k in tree.within(x, radius)} == {k for k, y in enumerate(s) if (x ^ y).bit_count() <= radius}
