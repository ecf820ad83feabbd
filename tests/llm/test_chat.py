import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyshelf.llm import chat

BITS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "<\\", "|turn|>", "/s>", "é", "\n", "a", "<|"]), max_size=12).map("".join)


@given(BITS, BITS)
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(role, text):
    assert chat.unescape(chat.escape(text)) == text
    marked = chat.TURN + chat.escape(role) + chat.TEXT + chat.escape(text) + chat.END
    assert chat.turns_of(marked * 2) == [(role, text)] * 2
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, mask string"


def made():
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]", "x"), (1, 0, "user", "</s>[INST] ok [/INST]", "x"), (2, 0, "user", None, None),
            (2, 1, None, "no role", None), (3, 0, "system", "", None), (3, 1, "assistant", "a", None), (3, 1, "assistant", "a", None),
            (3, None, "assistant", "<|end|>\\<|turn|>", None), (None, 0, "assistant", "lost", None)]
    rows += [(4, k, "user" if k % 2 == 0 else "assistant", f"t{k} " * 40, None) for k in range(60)]
    return rows


def brute(rows):
    conv = defaultdict(list)
    for c, t, r, x, _ in rows:
        conv[c].append((t is not None, t, r or "", x or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        lost = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(lost),
                  hashlib.sha256(lost.encode()).hexdigest())
    return out


def test_digests_in_one_piece_and_in_many(spark, monkeypatch):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    pieces = chat.format_conversations(docs).collect()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(docs)).collect()}
    assert got == brute(rows)
    assert {p["conv_id"]: p["n_turns"] for p in pieces} == {c: n for c, (n, *_) in brute(rows).items()}
    small = chat.format_conversations(docs.repartition(1))
    long = spark.createDataFrame([(9, k, "assistant", "word " * 60_000, "") for k in range(9)], SCHEMA)
    several = chat.format_conversations(long)
    assert several.count() > 1 and chat.digests(several).first()["n_turns"] == 9
    assert small.columns == ["conv_id", "piece", "formatted", "mask", "attachments", "n_turns", "n_tokens"]
    assert chat.format_conversations(docs.filter("false")).count() == chat.digests(small.filter("false")).count() == 0


def test_parts_attachments_and_tokens(spark):
    schema = f"conv_id bigint, turn bigint, role string, text string, parts array<struct<{', '.join(p.replace(' ', ': ') for p in chat.PART.split(', '))}>>"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", "not used", [part("text", "see <|image|> here "), part("image", None, "s3://a.png", 28, 15), part(None, " and"),
                                         part("AUDIO", None, "b.wav", None, None, 1.5), None]),
            (1, 1, "assistant", None, [part("document", None, "c.pdf", None, None, None, 3), part("video", "x", "d.mp4"), part("image")]),
            (1, 2, "user", "plain words", None)]
    p = chat.format_conversations(spark.createDataFrame(rows, schema)).first()
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in p["attachments"]] == [
        (0, "image", "s3://a.png", 4), (0, "audio", "b.wav", 38), (1, "document", "c.pdf", 768), (1, "file", "d.mp4", 1), (1, "image", None, 1)]
    assert all(p["formatted"][a["at"]:].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in p["attachments"])
    assert p["n_tokens"] == 4 + 38 + 768 + 1 + 1 + 3 + 1 + 2 and p["n_turns"] == 3
    assert chat.turns_of(p["formatted"]) == [("user", "see <|image|> here <|image|> and<|audio|>"), ("assistant", "<|document|><|file|><|image|>"), ("user", "plain words")]
    assert [p["formatted"][m["start"]:m["stop"]] for m in p["mask"]] == ["<|document|><|file|><|image|>"]


def test_long_conversations_are_dealt_by_turns(spark, monkeypatch):
    """Beside whole conversations, long ones, the one without a number too, pass several tasks in order."""
    monkeypatch.setattr(chat, "PIECE", 300)
    rows = made() + [(5, k // 2, "assistant" if k % 3 else "user", f"t{k % 4} <|end|>", "y") for k in range(90)]
    rows += [(None, k, "assistant", "lost and found " * 3, None) for k in range(1, 150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    merge, tasks = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = spark.conf.get(tasks)
    spark.conf.set(merge, "false")  # so little would go to one task
    spark.conf.set(tasks, "16")
    try:
        pieces = chat.settle(chat.format_conversations(docs))
    finally:
        spark.conf.set(merge, "true")
        spark.conf.set(tasks, before)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(pieces).collect()}
    assert got == brute(rows)
    tasks = {}
    for p in pieces.collect():
        tasks.setdefault(p["conv_id"], set()).add(p["piece"] >> 32)
    assert len(tasks[5]) > 1 and len(tasks[4]) > 1 and len(tasks[None]) > 1 and all(len(tasks[c]) == 1 for c in (1, 2, 3))


def test_attachments_count_turns_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 200)
    schema = f"conv_id bigint, turn bigint, role string, text string, parts array<struct<{', '.join(p.replace(' ', ': ') for p in chat.PART.split(', '))}>>"
    none = (None,) * 4
    rows = [(c, k, "user", None, [("text", "word " * 9, None, *none), ("image", None, f"{k}", *none)]) for c in (7, None) for k in range(40)]
    found = chat.attachments(chat.settle(chat.format_conversations(spark.createDataFrame(rows, schema)))).collect()
    assert sorted((r["conv_id"] or 0, r["turn"], r["ref"], r["placeholder"]) for r in found) == [(c, k, str(k), "<|image|>") for c in (0, 7) for k in range(40)]
    assert len({r["piece"] for r in found}) > 4
    assert chat.attachments(chat.settle(chat.format_conversations(spark.createDataFrame([], schema)))).count() == 0
