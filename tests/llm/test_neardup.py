import random
import re

import numpy as np
import pytest

from tallyshelf.llm import neardup
from tallyshelf.llm.components import components

SCHEMA = "doc_id bigint, text string, n_shingles string, id int"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


def made():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(" ".join(text(rng.randrange(0, 80)))) for _ in range(60)]
    hub = text(120)
    # A star: every copy is close to the hub, most are not close to each other.
    for _ in range(90):
        copy = list(hub)
        for k in rng.sample(range(120), 5):
            copy[k] = f"x{rng.random()}"
        rows.append(" ".join(copy))
    rows += [" ".join(hub), " ".join(hub).upper(), rows[0], rows[0], None, "", "  ", "one", "one", "ONE\n", "one two", "one two three"]
    chain = text(40)
    for k in range(8):
        rows.append(" ".join(chain[k:k + 30]))
    rng.shuffle(rows)
    return [(i, t, "x", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("n", [2, 5])
def test_components_against_brute_force(spark, n):
    rows = made()
    got = neardup.find(spark.createDataFrame(rows, SCHEMA), words=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, n) and len(got) == len(rows)


def test_crowded_regions_keep_every_link(spark, monkeypatch):
    """With next to no window the sorted orders find few pairs; the crowded regions must find the rest."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(neardup, "WINDOW", 1)
    monkeypatch.setattr(neardup, "PAIRS", 500)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base), "", 0)]
    for i in range(1, 160):
        copy = list(base)
        for k in rng.sample(range(200), 9):
            copy[k] = f"x{i}-{k}"
        rows.append((i, " ".join(copy), "", 0))
    want = brute(rows, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.find(spark.createDataFrame(rows, SCHEMA), words=2).collect()}
    assert got == want


def test_large_regions_keep_every_link(spark, monkeypatch):
    """Nodes of one region that agree in no order's full key, in a region above the size of a large one."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(neardup, "LARGE_REGION", 16)
    rng = random.Random(5)
    sets = {}
    for i in range(0, 120, 2):
        n = rng.choice([1, 4, 5, 40, 50, 90, 300])
        sets[i] = {rng.getrandbits(63) for _ in range(n)}
        # Exactly at the threshold where the size allows it: four fifths of a set, with sizes a whole band apart.
        sets[i + 1] = set(sorted(sets[i])[:-(-4 * n // 5)])
    sets[1000] = sets[0] | {1}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    crowd = spark.createDataFrame([(i, b"r") for i in sets], "id bigint, region binary")
    blobs = [(i, np.array(sorted(x), np.uint64).tobytes()) for i, x in sets.items()]
    none = spark.createDataFrame([], "id bigint, component bigint")
    found = neardup._crowded(crowd, none, spark.createDataFrame(blobs, "id bigint, shingles binary"), 80)
    assert found is not None and len(links) > 50
    got, want = (components(x).collect() for x in (found, spark.createDataFrame(links, "a bigint, b bigint")))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_keep_first(spark):
    rows = made()
    docs = spark.createDataFrame(rows + [rows[5], rows[5], (None, "null id a b c d e f", "", 0), (None, "null id a b c d e f", "", 0)], SCHEMA)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = [i for i, (_, c) in brute(rows, 5).items() if i == c]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 1


def test_empty_and_lone(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert neardup.find(docs).count() == neardup.keep_first(docs).count() == 0
    one = spark.createDataFrame([(7, None, "", 0)], SCHEMA)
    assert [tuple(r) for r in neardup.find(one).collect()] == [(7, 0, 7)]


def test_long_text_and_signature():
    a = neardup.shingles(" ".join(f"w{i % 9973}" for i in range(200_000)), 5)
    assert len(a) == 9973 and (neardup.signature(a) == neardup.signature(a[::-1])).all()


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1100)] + [
        (k, k + 1) for k in range(2000, 2040)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    comp = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in comp:
        before = dict(comp)
        for a, b in links:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            break
    assert got == comp
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_common_passage_links_nobody_but_the_near_copies(spark, monkeypatch):
    """Many texts share most of their words, too few for a link; the few near copies among them are found."""
    monkeypatch.setattr(neardup, "WINDOW", 1)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"x{i}-{k}" for k in range(rng.choice([15, 17, 19, 40]))]), "", 0) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + f" y{i}", "", 0) for i in range(0, 150, 15)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.find(spark.createDataFrame(rows, SCHEMA), words=2).collect()}
    assert got == brute(rows, 2)


def test_word_hashes():
    """Equal words hash alike wherever they stand, different ones differ, also where only a late byte does."""
    words = [f"w{i}" for i in range(3000)] + ["x" * n for n in range(1, 900)] + ["x" * 700 + c for c in "abc"] + ["aab", "aba", "baa", "é", "\x00", "\x00\x00"]
    hashes = neardup._words(" ".join(words).encode())
    assert len(np.unique(hashes)) == len(words) == len(hashes)
    assert (neardup._words(" \n".join(reversed(words)).encode()) == hashes[::-1]).all()
    small = neardup.shingles("A b\tc " * 3000, 2)
    before, neardup._PART = neardup._PART, 100
    try:
        assert (neardup.shingles("A b\tc " * 3000, 2) == small).all() and len(small) == 3
    finally:
        neardup._PART = before
