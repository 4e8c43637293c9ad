import random

import numpy as np
import xxhash

from lamina.llm import components, simhash
from lamina.llm.queries import op4_simhash_variants


def slow_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(ids, fps, distance):
    """Smallest id of each row's class, by brute force."""
    own = list(range(len(fps)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                own[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprints(docs_of, odd_rows):
    for k in (4, 5):
        got = sorted(((r["doc_id"] is None, r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(docs_of(odd_rows), k).collect()), key=str)
        assert got == sorted(((d is None, d, slow_fingerprint(t, k)) for d, t in odd_rows), key=str)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(0)
    fps = []
    for _ in range(12):  # chains and balls around centres, and strangers
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice((1, 2, 4, 5, 9))):
                x ^= 1 << b
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = classes(list(range(len(fps))), fps, 4)
    for most in (16_384, 33):
        links = simhash.links(table, 4, 3, most)
        found = {r["node"] & (1 << 64) - 1: r["component"] & (1 << 64) - 1 for r in components.components(links).collect()}
        got = [found.get(f, f) for f in fps]
        assert len({(a, b) for a, b in zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_query(spark, small):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    fps = [slow_fingerprint(t, 4) for _, t in rows]
    want = {(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, classes([d for d, _ in rows], fps, 4), strict=True)}
    assert {tuple(r) for r in op4_simhash_variants(spark, small).collect()} == want


def test_odd_rows(docs_of, odd_rows):
    got = simhash.near_duplicates(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 3)} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}  # no words: equal fingerprints
    kept = simhash.without_copies(docs_of(odd_rows)).collect()
    assert sum(r["text"] == odd_rows[0][1] for r in kept) == 1 and len(kept) == 6
    assert simhash.near_duplicates(docs_of(odd_rows).limit(0)).isEmpty()


def test_forest_of_two_sides():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 12, 40, dtype=np.uint64) for _ in range(2))
    for x, y in simhash.forest(np.unique(a), 2, np.setdiff1d(b, a)):
        assert bin(x ^ y).count("1") <= 2


def similar_classes(texts, similar=0.8):
    """Each text's class, by brute force over exact sets of five-word shingles."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    own = list(range(len(texts)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similar * (len(sets[i]) + len(sets[j]) - both):
                own[root(i)] = root(j)
    return {root(i) for i in range(len(texts))}, sets


def test_large_group_of_copies_keeps_every_real_link(docs_of):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(words)]
    for i in range(600):
        copy = list(words)
        for at in rng.sample(range(300), rng.choice((5, 6))):
            copy[at] = f"edit{i}x{at}"
        texts.append(" ".join(copy))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    want, _ = similar_classes(texts)
    assert simhash.without_copies(docs_of(texts)).count() == len(want) < 300


def test_copies_further_apart_than_the_index_of_fingerprints(docs_of):
    rng = random.Random(5)
    texts = []
    while len(texts) < 16:  # pairs of similarity 0.8 or more whose fingerprints differ in 12 bits or more
        words = [f"w{rng.randrange(5000)}" for _ in range(80)]
        copy = list(words)
        for at in rng.choice(((40,), (40, 79), (0, 79))):
            copy[at] = "edit"
        a, b = " ".join(words), " ".join(copy)
        if (slow_fingerprint(a, 5) ^ slow_fingerprint(b, 5)).bit_count() >= 12:
            texts += [a, b]
    want, _ = similar_classes(texts)
    assert len(want) == 8
    assert sorted(r["doc_id"] for r in simhash.without_copies(docs_of(texts)).collect()) == list(range(0, 16, 2))
