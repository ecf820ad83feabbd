import random

from tallyshelf.llm import decontaminate as d


def words(text):
    out, run = [], ""
    for c in (text or ""):
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or "0" <= c <= "9" or ord(c) >= 128:
            run += c
        elif run:
            out, run = [*out, run], ""
    return [*out, run] if run else out


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, said in items:
        b = words(said)
        n = min(10, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1 if windows else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def made():
    rng = random.Random(5)
    vocabulary = ["Alpha", "béta", "g4", "δ", "e", "F.g"]
    items = [(i % 9, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(None, "only null id here and ten words in this one item"), (50, None), (51, "..."), (0, items[0][1])]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            text[len(text) // 2:len(text) // 2] = [(rng.choice(items)[1] or "").upper().replace(" ", " -\n")]
        docs.append((i, " ".join(text), "x", 1))
    docs += [(60, None, "x", 1), (61, "", "x", 1), (None, docs[0][1], "x", 1), (62, "!!", "x", 1), docs[3], docs[3]]
    return docs, items


def test_against_brute_force(spark):
    docs, items = made()
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, r string, _key int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((r[0] if r[0] is not None else -1, *brute(r[1], items)) for r in docs)
    for limit in (d.BLOCK_BYTES, 200, 40):
        got = d.mark(rows, bench, "out", block_bytes=limit)
        assert got.columns == ["doc_id", "text", "r", "_key", "out"]
        assert sorted((r[0] if r[0] is not None else -1, r["out"]["n_words"], r["out"]["n_hit"], r["out"]["items"])
                      for r in got.collect()) == want
    kept = d.clean(rows, bench)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted((r[0] or -1) for r in docs if not brute(r[1], items)[1])


def test_spans_lie_on_the_original(spark):
    item = "one two three four five six seven eight nine ten eleven"
    text = "É ONE, two\nthree four—five six seven eight nine  TEN. eleven!? twelve"
    out = d.scan(d.build([("1", item)]), text)
    assert [text[s["start"]:s["stop"]] for s in out["spans"]] == ["six seven eight nine  TEN. eleven"] or out["n_hit"] == 0
    text = text.replace("—", "-")
    out = d.scan(d.build([("1", item)]), text)
    assert [text[s["start"]:s["stop"]] for s in out["spans"]] == ["ONE, two\nthree four-five six seven eight nine  TEN. eleven"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert not d.mark(docs, bench, "r").first()["r"]["contaminated"]
    assert d.clean(docs.filter("false"), bench).count() == 0


def test_long_text():
    item = " ".join(f"w{i}" for i in range(12))
    out = d.scan(d.build([("1", item)]), "x " * 300_000 + item + " y" * 300_000)
    assert (out["n_words"], out["n_hit"]) == (600_012, 12)
