import hashlib
import itertools
import random
import re
import zlib

from tallyshelf.llm import repair
from tallyshelf.llm.q_repair import damaged

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit int, chunk string"
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def lines(audit, rows):
    """What an audit leaves, or None if it breaks a rule; and what it costs."""
    out, cost, at, left = [], 0, 0, faults(rows)
    for edit in audit:
        if edit == "I":
            out.append([None, ""])
            cost += 5
            continue
        (_, role, text), fault = rows[at], left[at]
        at += 1
        if edit == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 5 * (fault == "truncated") + (edit == "R")
        out.append([role if edit == "K" else None, text])
    start = bool(out) and out[0][0] is not None and out[0][0][:1] == "s"
    for k, line in enumerate(out[start:]):
        line[0] = ("user", "assistant")[k % 2] if line[0] is None else line[0]
    if not re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
        return None
    return cost, "\n".join(f"{r}:{t}" for r, t in out)


def exhaustive(rows):
    """Every audit of up to three inserted rows."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for n in range(4):
            for places in itertools.combinations(range(len(rows) + n), n):
                rest = iter(edits)
                audit = "".join("I" if k in places else next(rest) for k in range(len(rows) + n))
                found = lines(audit, rows)
                if found and (best is None or (found[0], audit) < best):
                    best = (found[0], audit)
    return best


def plain(rows):
    """The same by a program on whole strings."""
    nxt, kept = (2, 2, 3, 2), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                best[nxt[s]] = min(best.get(nxt[s], (9e9, "")), (c + 5, a + "I"))
        return best

    best = inserted({0: (0, "")})
    for (_, role, _), fault in zip(rows, faults(rows)):
        new = {}
        for s, (c, a) in best.items():
            options = [(s, c + 2, a + "D")]
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                options.append((nxt[s], c + 1 + more, a + "R"))
                if (s, role[:1]) in kept:
                    options.append((kept[s, role[:1]], c + more, a + "K"))
            for t, cost, audit in options:
                new[t] = min(new.get(t, (9e9, "")), (cost, audit))
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows, solve=plain):
    conv = {}
    for c, t, r, x, *_ in rows:
        conv.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, of in conv.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit = solve(of)
        turns = [t for t, *_ in of if t is not None]
        found, heads = faults(of), [r[:1] for _, r, _ in of]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
                  hashlib.sha256(lines(audit, of)[1].encode()).hexdigest())
    return out


def made(rng, convs, size):
    words = ["fine.", "so so", "what?", "no!", " ", "", "\n", "end. \t", "é.", "a:b\nc.", "very long " * 30 + "."]
    roles = ["user", "user", "assistant", "assistant", "system", "ustad", "tool", "", " ", None]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, size + 1)):
            turn = rng.choice([t, t, t, t + 2, None])
            text = rng.choice([*words, None, f"said {rng.randrange(9)}.", f"said {t}."])
            rows.append((c, turn, rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[t % 2], text, 1, "x"))
    return rows


def got(spark, rows, parts=3):
    found = repair.digests(repair.plan(spark.createDataFrame(rows, SCHEMA).repartition(parts))).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def test_plain_program_against_every_audit():
    rng = random.Random(1)
    for k in range(60):
        rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x, *_ in made(rng, 1, 4)]
        assert plain(rows) == exhaustive(rows)


def test_conversations_against_brute_force(spark):
    rows = made(random.Random(2), 120, 9)
    rows += [(None, k, "user" if k % 2 else "assistant", f"t{k}.", 0, "") for k in range(4)] + [(500, None, None, None, None, None)]
    rows += [(501, 0, "user", "a.", 0, "")] * 5 + [(502, k, "user", "Cut", 0, "") for k in range(4)] + [(503, 0, "user", "w" * 300_000 + ".", 0, "")]
    assert got(spark, rows) == brute(rows)


def test_chunks_of_a_long_conversation(spark, monkeypatch):
    """Chunks of a few rows, and partitions that begin inside a conversation, give what whole conversations give."""
    rng = random.Random(4)
    rows = made(rng, 3, 5) + [(7, rng.randrange(700), rng.choice(["user", "assistant", "tool"]), f"said {rng.randrange(400)}" + rng.choice(".. "), 0, "")
                              for _ in range(700)]
    want = brute(rows)
    for chunk in (1, 3, 64):
        monkeypatch.setattr(repair, "CHUNK", chunk)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", chunk == 64)
        try:
            assert got(spark, rows, 4) == want
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows(spark):
    rows = made(random.Random(5), 40, 6)
    found = repair.repaired(repair.plan(spark.createDataFrame(rows, SCHEMA))).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["conv_id"], r["chunk"], r["nr"])):
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, want in brute(rows).items():
        assert hashlib.sha256("\n".join(by.get(c, [])).encode()).hexdigest() == want[-1]


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Said {t}. And?", 0, "") for c in range(40) for t in range(2)] + [
        (None, 3, "user", None, 0, ""), (9, None, None, "x!", 0, "")]
    want = []
    for c, t, r, x, *_ in rows:
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            want += [(c, t, "user" if d == 4 else r, "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x)] * (2 if d == 3 else 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = damaged(docs)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    out = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(repair.plan(found.filter("conv_id < 30")), docs).collect()}
    assert set(out) == {r[0] for r in rows} and out[35] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    none = docs.filter("false")
    assert repair.digests(repair.plan(none), none).count() == 0


def test_order_of_audits_and_colliding_hashes(monkeypatch):
    rng = random.Random(6)
    for base in (repair._BASE, 0):  # with base 0 a hash is the last letter's code, so nearly all collide
        monkeypatch.setattr(repair, "_BASE", base)
        nodes = [repair.Node(None, "")]
        for _ in range(400):
            nodes.append(repair.Node(rng.choice(nodes[-12:]), rng.choice(["D", "K", "R", "I", "DK", "KI"])))
        text = [repair._letters(n, nodes[0]) for n in nodes]
        for _ in range(2000):
            a, b = rng.randrange(401), rng.randrange(401)
            if nodes[a].depth == nodes[b].depth or not (text[a].startswith(text[b]) or text[b].startswith(text[a])):
                assert repair.less(nodes[a], nodes[b]) == (text[a] < text[b]), (text[a], text[b])
