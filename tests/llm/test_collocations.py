import random
import re
from collections import Counter

import pytest

from tallyshelf.llm import collocations as co

SCHEMA = "text string, lang string, id bigint, phrase string, n int"


def brute(rows, least, longest, top):
    """Straight from the definition, in Python integers."""
    f, n = {}, Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + m])] += 1
    out = []
    for lang, of in f.items():
        candidates = [p for p, a in of.items() if len(p) > 1 and a >= least]
        rank = []
        for p in candidates:
            a = of[p]
            if any(len(q) > len(p) and of[q] >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in candidates):
                continue
            score, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for place, (s, a, p, left, right) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, place, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made():
    rng = random.Random(3)
    words = ["The", "of", "a b", "Éa", "new", "york", "x\x00y", "time", "square", "is", "it"]
    rows = []
    for k in range(300):
        text = []
        for _ in range(rng.randrange(0, 60)):
            text.append(rng.choice(["new york time square", "of the", "it is", "a a a a a a", "nur einmal fest hier dort"]
                                   if rng.random() < 0.3 else words))
            text.append(rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!?"]))
        rows.append(("".join(text), rng.choice(["en", "de", None]), k, "clash", 1))
    return rows + [rows[0]] * 5 + [(None, "en", 1, "", 1), ("", "fr", 1, "", 1), (" .. ", "fr", 1, "", 1), ("one", "fr", None, None, None),
                                   ("und und " * 30, "und", 1, "", 1), ("w " * 50_000, "long", 1, "", 1)]


@pytest.mark.parametrize("in_memory", [None, 0, 25])
def test_against_brute_force(spark, in_memory, monkeypatch):
    if in_memory is not None:
        monkeypatch.setattr(co, "COUNTED", 50)
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = co.collocations(*co.frequent_phrases(docs, least=20, in_memory=in_memory), top=30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 20, 5, 30)
    assert len(want) >= 60 and sorted(map(tuple, got.collect())) == want


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 1, 3 * 10**9), ("en", "b", 1, 2 * 10**9 + 1), ("en", "a b", 2, 10**9 + 7)],
                                    "lang string, phrase string, size int, a bigint")
    totals = spark.createDataFrame([("en", 10**12)], "lang string, n bigint")
    assert co.collocations(phrases, totals).first()["score"] == 1000 * (10**9 + 7) * 10**12 // (3 * 10**9 * (2 * 10**9 + 1))


def test_empty_and_rare(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert co.collocations(*co.frequent_phrases(docs)).count() == 0
    docs = spark.createDataFrame([("one two three", "en", 1, "", 1)], SCHEMA)
    assert co.collocations(*co.frequent_phrases(docs)).count() == 0
    assert co.collocations(*co.frequent_phrases(docs, least=1)).count() == 1
