"""SimHash against a brute-force version."""

import random

import xxhash
from pyspark.sql import functions as F

from jurispark.llm import simhash
from jurispark.llm.components import components

SCHEMA = "doc_id long, text string, fp string, n int"


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fps: {id: fingerprint}; smallest id reachable."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def rows():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÉTÉ", "Straße", "a b"]
    out = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 40, 400]))]
        out.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    for i in range(120, 200):  # copies with few changed words
        words = out[rng.randrange(60)][1].split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    out += [(200, None), (201, ""), (202, " \n"), (203, "One TWO three"), (204, "one two three")]
    return out


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in data}
    want = slow_components(fps)
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_long_text_matches_the_definition():
    text = " ".join(f"Tok{i % 977}" for i in range(50_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_links_find_all_near_fingerprints(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):  # chains of one, two and three flips
        for n in (1, 2, 3):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    fps |= {0, 1, 2**63, 2**64 - 1}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for segments in (8, 16):
        links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), segments)
        pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in links.collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        root = {f: f for f in fps}

        def find(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in pairs:
            root[find(a)] = find(b)
        near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
        assert near and all(find(a) == find(b) for a, b in near)


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame(
        [(None, "a b c", "", 1), (3, "a b c", "", 1), (3, "a b c", "", 1), (None, "q r s t u", "", 1)],
        SCHEMA,
    )
    got = sorted(r["component_id"] or -1 for r in simhash.near_duplicates(df).collect())
    assert got == [-1, 3, 3, 3]


def test_cells_are_shared_by_all_pairs_within_two_bits(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        f = rng.choice([rng.getrandbits(64), 0, 2**64 - 1, 2**63])
        g = f
        for b in rng.sample(range(64), rng.randrange(3)):
            g ^= 1 << b
        pairs.append((f - 2**64 if f >= 2**63 else f, g - 2**64 if g >= 2**63 else g))
    df = spark.createDataFrame(pairs, "a long, b long")
    for segments in (8, 16):
        met = df.select(F.arrays_overlap(simhash.cells(F.col("a"), segments), simhash.cells(F.col("b"), segments)).alias("m"))
        assert all(r["m"] for r in met.collect())


def test_one_row_of_each_component(spark):
    rows = [
        (5, "a b c d", "x", 1), (9, "a b c d", "y", 2), (None, "a b c d", "z", 3),  # copies
        (7, "one two three four", "x", 4), (7, "five six seven eight nine", "x", 5),  # one id, two texts
        (8, "five six seven eight nine", "x", 6), (8, "five six seven eight nine", "x", 6),
        (None, "q r s t", "x", 7), (None, "q r s t", "x", 7), (3, None, "x", 8), (4, "", "x", 9),
    ]
    clashing = "doc_id long, text string, fp string, row int"
    got = simhash.one_of_each(spark.createDataFrame(rows, clashing))
    assert got.columns == ["doc_id", "text", "fp", "row"]
    assert sorted(r["row"] for r in got.collect()) == [1, 4, 5, 7, 8]
    assert simhash.one_of_each(spark.createDataFrame([], clashing)).collect() == []


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 180)]
    pairs = spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(pairs).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}


def test_hash_is_the_public_one(spark):
    texts = ["", "a", "ab cd ef", "x" * 31, "y" * 32, "é" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h"))
    for r in df.collect():
        assert r["h"] % 2**64 == xxhash.xxh64(r["t"].encode(), seed=42).intdigest()
