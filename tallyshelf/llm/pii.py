"""Personal data in texts: fixed patterns, and spans that a semi-Markov conditional random field adds.

The patterns find whole, well-written e-mail and IP addresses, card and phone numbers; what they find stays. The
model reads the neighbourhood of digits and at-signs that no pattern covers: numbers that ran together, other
separators, phone numbers without a plus, bracketed ``(at)`` and ``[.]``. Candidate segments there are scored as
whole spans (digits and their groups, checksum, separators, what stands on either side), and a dynamic program
over segments of at most MAX_TOKENS tokens chooses boundaries and kinds together.

The model is fitted here, by stochastic ascent on the conditional likelihood (forward-backward over segments), on
a bounded sample of windows of the texts: the patterns label them, and each match is also written in the ways that
patterns miss, next to dates, amounts, versions and numbers of a wrong checksum, which are none.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import column

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a candidate segment, at most.
MAX_TOKENS = 48
#: Windows of text the model is fitted on, at most; and the seed of how matches are rewritten.
SAMPLE, SEED = 400, 7
EPOCHS, RATE, DECAY = 5, 0.5, 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the checksum of a card number holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By its at-signs, so that a long word without one is read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each chain of dotted numbers."""
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k:k + 4])) + 3
            if all(map(_octet, parts[k:k + 4])):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, by kind as in KINDS, then by start: leftmost, not overlapping within a kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]+|(?<=[\[(])at(?=[\])])")
_AT, _DOT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?"), re.compile(r"\.| ?(?:\(dot\)|\[dot\]|\[\.\]|\(\.\)) ?")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NUMBER_BETWEEN = " -./()[]_"
_NEAR, _AROUND = 24, 64
_CUES = {"mail": "email", "email": "email", "ip": "ip", "host": "ip", "card": "card", "visa": "card", "phone": "phone", "tel": "phone",
         "call": "phone", "fax": "phone", "mobile": "phone"}


def islands(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of the text around digits and at-signs that no span in ``taken`` covers."""
    covered = sorted((a, b) for _, a, b in taken)
    start = stop = None
    k, reach = 0, -1
    for m in _TRIGGER.finditer(text):
        while k < len(covered) and covered[k][0] <= m.start():
            reach = max(reach, covered[k][1])
            k += 1
        if m.end() <= reach:
            continue
        if stop is not None and m.start() - stop > _NEAR:
            yield max(0, start - _AROUND), min(len(text), stop + _AROUND)
            start = None
        start, stop = m.start() if start is None else start, m.end()
    if start is not None:
        yield max(0, start - _AROUND), min(len(text), stop + _AROUND)


@dataclass
class Lattice:
    """Tokens of an island (their starts, and the end), and candidate segments by their last token."""
    edges: list[int]
    ends: list[list[tuple[int, list[str]]]]   # per token end: first token, features


def lattice(text: str, begin: int, end: int, taken: list[tuple[str, int, int]]) -> Lattice:
    tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
    edges = [a for a, _ in tokens] + [end]
    at = {p: k for k, p in enumerate(edges)}
    blocked = [False] * len(tokens)
    for _, a, b in taken:
        if a < end and b > begin:
            for k, (p, q) in enumerate(tokens):
                if p < b and q > a:
                    blocked[k] = True
    found: dict[tuple[int, int], None] = {}

    def free(p: int) -> bool:
        return p < 0 or p >= len(text) or not text[p].isalnum()

    for i, (a, _) in enumerate(tokens):
        c = text[a]
        if blocked[i] or not ("0" <= c <= "9" or c in "+(") or not free(a - 1):
            continue
        count = between = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            p, q = tokens[j]
            c = text[p]
            if blocked[j]:
                break
            if "0" <= c <= "9":
                count, between = count + q - p, 0
                if count > 19:
                    break
                if count >= 4 and free(q):
                    found[i, j + 1] = None
            elif c in _NUMBER_BETWEEN or j == i:
                between += 1
                if between > 3:
                    break
            else:
                break
    for m in _AT.finditer(text, begin, end):
        local = _LOCAL.search(text, max(begin, m.start() - _AROUND), m.start())
        if not local or not free(local.start() - 1):
            continue
        label = _LABEL.match(text, m.end(), end)
        while label:
            dot = _DOT.match(text, label.end(), end)
            label = _LABEL.match(text, dot.end(), end) if dot else None
            if label and label.end() in at and free(label.end()) and local.start() in at:
                i, j = at[local.start()], at[label.end()]
                if j - i <= MAX_TOKENS and not any(blocked[i:j]):
                    found[i, j] = None
    ends: list[list[tuple[int, list[str]]]] = [[] for _ in edges]
    for i, j in found:
        ends[j].append((i, features(text, edges[i], tokens[j - 1][1])))
    return Lattice(edges, ends)


def features(text: str, a: int, b: int) -> list[str]:
    """What a whole span looks like and what stands beside it."""
    span, out = text[a:b], ["any"]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    if _AT.search(span):
        out.append("at")
        host = _AT.split(span, maxsplit=1)[-1]
        out.append("host" if re.fullmatch(r"[A-Za-z]{2,}", re.split(_DOT, host)[-1]) else "no host")
        dot = _DOT.match(text, b)
        if dot and _LABEL.match(text, dot.end()):
            out.append("host goes on")
    else:
        out.append(f"digits {len(digits)}")
        if 13 <= len(digits) <= 19:
            out.append("checksum" if luhn(digits) else "no checksum")
            if luhn(digits):
                out.append("checksum, even groups" if len(set(map(len, groups[:-1]))) <= 1 else "checksum, other groups")
        dotted = re.split(r"\[\.\]|\(\.\)|\.", span)
        if len(dotted) == 4 and all(x.isdigit() and x.isascii() for x in dotted):
            out.append("four parts" if all(map(_octet, dotted)) else "four large parts")
        out.append("groups " + ".".join(str(len(g)) for g in groups) if len(groups) <= 6 else "groups many")
        between = re.findall(r"[^0-9]+", span.lstrip("+("))
        out += [f"between {s}" for s in sorted({s.strip() or "blank" for s in between})]
        if len({s for s in between if s.strip(" ()")}) > 1:
            out.append("mixed separators")
        if any(len(s) > 2 for s in between):
            out.append("wide separator")
        out.append("starts +" if span[0] == "+" else "starts (" if span[0] == "(" else "starts 00" if span.startswith("00") else "starts digit")
        if span.count("(") != span.count(")"):
            out.append("open bracket")
    left, right = text[max(0, a - _NEAR):a], text[b:b + 2]
    out.append("left " + _side(left[-1:]))
    out.append("right " + _side(right[:1]) + (" digit" if right[1:2].isdigit() else ""))
    if re.search(r"[0-9][ .()/-]\Z", left):
        out.append("digit before")
    for word in re.findall(r"[a-z]+", left.lower())[-2:]:
        if word in _CUES:
            out.append("cue " + _CUES[word])
    return out


def _side(c: str) -> str:
    return "edge" if not c else "blank" if c.isspace() else c if c in "+-./:,()[]$@=_\"" else "letter" if c.isalpha() else "digit" if c.isdigit() else "other"


_LABELS = (None, *KINDS)


class Model:
    """Weights of (kind, feature) and of (kind before, kind); a token outside all segments has kind None."""

    def __init__(self, weights: dict[tuple, float] | None = None):
        self.weights = weights or {}

    def scores(self, found: list[str]) -> list[float]:
        get = self.weights.get
        return [sum(get((kind, f), 0.0) for f in found) for kind in KINDS]

    def _moves(self) -> list[list[float]]:
        return [[self.weights.get(("after", y, z), 0.0) for z in _LABELS] for y in _LABELS]

    def decode(self, seen: Lattice) -> list[tuple[str, int, int]]:
        """The likeliest segmentation's spans."""
        moves, n = self._moves(), len(seen.edges)
        best: list[list[tuple[float, int, int] | None]] = [[None] * 5 for _ in range(n)]
        best[0][0] = (0.0, -1, 0)
        for j in range(1, n):
            here = best[j]
            for i, z, s in self._segments(seen, j):
                for y in range(5):
                    if best[i][y] is not None:
                        total = best[i][y][0] + moves[y][z] + s
                        if here[z] is None or total > here[z][0]:
                            here[z] = (total, i, y)
        out, j = [], n - 1
        z = max((y for y in range(5) if best[j][y]), key=lambda y: best[j][y][0])
        while j > 0:
            _, i, y = best[j][z]
            if z:
                out.append((KINDS[z - 1], seen.edges[i], seen.edges[j]))
            j, z = i, y
        return out[::-1]

    def _segments(self, seen: Lattice, j: int) -> Iterator[tuple[int, int, float]]:
        yield j - 1, 0, 0.0
        for i, found in seen.ends[j]:
            for z, s in enumerate(self.scores(found), 1):
                yield i, z, s

    def gradient(self, seen: Lattice, truth: set[tuple[str, int, int]]) -> dict[tuple, float]:
        """Of the log-likelihood of the true segmentation: its features less the expected ones."""
        moves, n = self._moves(), len(seen.edges)
        arcs = [[]] + [list(self._segments(seen, j)) for j in range(1, n)]
        low = float("-inf")
        ahead = [[low] * 5 for _ in range(n)]
        ahead[0][0] = 0.0
        for j in range(1, n):
            for i, z, s in arcs[j]:
                ahead[j][z] = _plus(ahead[j][z], s + _sum(ahead[i][y] + moves[y][z] for y in range(5)))
        behind = [[low] * 5 for _ in range(n)]
        behind[n - 1] = [0.0] * 5
        for j in range(n - 1, 0, -1):
            for i, z, s in arcs[j]:
                if behind[j][z] > low:
                    for y in range(5):
                        behind[i][y] = _plus(behind[i][y], moves[y][z] + s + behind[j][z])
        whole = _sum(ahead[n - 1])
        out: dict[tuple, float] = {}

        def add(key: tuple, value: float) -> None:
            out[key] = out.get(key, 0.0) + value

        for j in range(1, n):
            for i, z, s in arcs[j]:
                share = 0.0
                for y in range(5):
                    p = ahead[i][y] + moves[y][z] + s + behind[j][z] - whole
                    if p > -20:
                        p = math.exp(p)
                        share += p
                        if y or z:
                            add(("after", _LABELS[y], _LABELS[z]), -p)
                if z and share > 1e-9:
                    for f in next(found for k, found in seen.ends[j] if k == i):
                        add((KINDS[z - 1], f), -share)
        j, before = 1, 0
        while j < n:
            span = next(((k, i, e) for e in range(j, min(n, j + MAX_TOKENS + 1)) for i, _ in seen.ends[e] if i == j - 1
                         for k in KINDS if (k, seen.edges[i], seen.edges[e]) in truth), None)
            z = 1 + KINDS.index(span[0]) if span else 0
            if before or z:
                add(("after", _LABELS[before], _LABELS[z]), 1.0)
            if span:
                for f in next(found for k, found in seen.ends[span[2]] if k == span[1]):
                    add((span[0], f), 1.0)
            j, before = span[2] + 1 if span else j + 1, z
        return out


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == float("-inf") else a + math.log1p(math.exp(b - a))


def _sum(values) -> float:
    total = float("-inf")
    for v in values:
        total = _plus(total, v)
    return total


def _card(rng: random.Random, size: int = 16) -> str:
    head = str(rng.randrange(10 ** (size - 2), 10 ** (size - 1)))
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def _grouped(digits: str, sizes: tuple[int, ...], between: str) -> str:
    out, at = [], 0
    for s in sizes:
        out.append(digits[at:at + s])
        at += s
    return between.join(x for x in [*out, digits[at:]] if x)


def rewritten(kind: str, span: str, rng: random.Random) -> str:
    """A match as people also write it, so that its pattern misses it."""
    if kind == "email":
        name, host = span.split("@", 1)
        at, dot = rng.choice([("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[.]")])
        return name.rstrip("._%+-") + at + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rng.choice(["[.]", "(.)"]))
    digits = _digits(span)
    if kind == "card":
        return _grouped(digits, (4,) * (len(digits) // 4), rng.choice([".", "/", " - ", "_", ". "]))
    country, area, rest = (digits[:len(digits) - 10], digits[-10:-7], digits[-7:]) if len(digits) > 10 else ("", digits[:3], digits[3:])
    between = rng.choice(["-", ".", " ", "/"])
    return rng.choice([f"({area}) {rest[:3]}-{rest[3:]}", between.join([area, rest[:3], rest[3:]]),
                       between.join(x for x in ["00" + country, area, rest[:3], rest[3:]] if x), f"+{country or 1}/{area}/{rest}"])


def nothing(rng: random.Random) -> str:
    """A number that is no personal data."""
    n = lambda a, b: rng.randrange(a, b)
    wrong = _card(rng, n(13, 20))
    wrong = wrong[:-1] + str((int(wrong[-1]) + n(1, 10)) % 10)
    return rng.choice([
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2100)}", f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2100)}",
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02} {n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"{n(1900, 2020)}-{n(2020, 2100)}",
        f"{n(1, 999)},{n(0, 1000):03},{n(0, 1000):03}.{n(0, 100):02}", f"{n(1, 999)} {n(0, 1000):03} {n(0, 1000):03}",
        f"{n(1, 20)}.{n(0, 20)}.{n(300, 20000)}.{n(300, 9999)}", f"{n(10**6, 10**12)}", f"978-{n(0, 10)}-{n(10, 99)}-{n(10**5, 10**6)}-{n(0, 10)}",
        f"{n(0, 90)}.{n(10**5, 10**6)}, {n(0, 180)}.{n(10**5, 10**6)}", wrong, _grouped(wrong, (4, 4, 4, 4), rng.choice(" -./")),
        f"{n(10, 999)}-{n(10, 999)}", f"{n(1, 99)}.{n(1, 99)}.{n(1, 99)}", f"x{n(10**9, 10**10)}", f"{n(100, 999)} {n(1000, 9999)} {n(10, 99)}"])


def _example(parts: list[tuple[str, str | None]]) -> tuple[str, set[tuple[str, int, int]]]:
    text, truth = "", set()
    for part, kind in parts:
        if kind:
            truth.add((kind, len(text), len(text) + len(part)))
        text += part
    return text, truth


def examples(windows: list[str], rng: random.Random) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """Labelled texts: each window as it is, and with its matches rewritten, run together or replaced."""
    made = {"email": lambda: f"{rng.choice(['ann', 'j.doe', 'k9', 'info'])}{rng.randrange(100)}@{rng.choice(['mail', 'web', 'a-b'])}{rng.randrange(9)}.{rng.choice(['com', 'example.org', 'net'])}",
            "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: _card(rng, rng.choice([16, 16, 16, 15, 13, 19])),
            "phone": lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"}
    for window in windows or [""] * 50:
        spans = base_spans(window)
        yield window, set(spans)
        kind, a, b = rng.choice(spans) if spans else (rng.choice(KINDS), 0, 0)
        span, left, right = window[a:b] or made[kind](), window[:a] or "so ", window[b:] or " on"
        left = left if not left[-1:].isalnum() else left + " "
        right = right if not right[:1].isalnum() else " " + right
        left, right = re.sub(r"[0-9@+]", "x", left), re.sub(r"[0-9@+]", "x", right)
        yield _example([(left, None), (rewritten(kind, span, rng), kind), (right, None)])
        yield _example([(left, None), (nothing(rng), None), (right, None)])
        run = [("phone", made["phone"]())] + [(k, made[k]()) for k in rng.sample(["card", "card", "ip"], 2)]
        run = run if rng.random() < 0.5 else run[1:]
        parts = [(left, None)]
        for k, s in run:
            parts += [(s, k), (" ", None)]
        yield _example([*parts, (right.lstrip(), None)])


def fit(windows: list[str], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """A model of the given windows of text; without windows one of made-up matches alone."""
    rng = random.Random(seed)
    ready = []
    for text, truth in examples(windows, rng):
        for a, b in islands(text, []):
            seen = lattice(text, a, b, [])
            if any(seen.ends):
                ready.append((seen, truth))
    model, squares = Model(), {}
    for _ in range(epochs):
        rng.shuffle(ready)
        for seen, truth in ready:
            for key, g in model.gradient(seen, truth).items():
                g -= DECAY * model.weights.get(key, 0.0)
                squares[key] = squares.get(key, 1e-6) + g * g
                model.weights[key] = model.weights.get(key, 0.0) + RATE * g / math.sqrt(squares[key])
    return model


def sample(docs: DataFrame, text: str = "text", rows: int = SAMPLE) -> list[str]:
    """Windows of text around the first digit or at-sign of at most ``rows`` texts, those that hash least."""
    before = F.length(F.regexp_extract(column(text), r"(?s)^[^0-9@]*+(?=[0-9@])", 0))
    found = column(text).rlike("[0-9@]")
    window = F.when(found, F.substring(column(text), F.greatest(before - 60, F.lit(1)), F.lit(180))).otherwise("")
    least = docs.select(window.alias("w")).filter("w <> ''").distinct().orderBy(F.xxhash64("w"), "w").limit(rows)
    return [r["w"] for r in least.collect()]


def spans(text: str | None, model: Model) -> list[tuple[str, int, int, bool]]:
    """All spans of a text (kind, start, stop, by pattern), by kind as in KINDS, then start."""
    text = text or ""
    if not _TRIGGER.search(text):
        return []
    known = base_spans(text)
    out = [(*s, True) for s in known]
    for a, b in islands(text, known):
        seen = lattice(text, a, b, known)
        if any(seen.ends):
            out += [(*s, False) for s in model.decode(seen)]
    # Islands may overlap in their margins, where neither has a segment of its own.
    return sorted(set(out), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind: string, start: bigint, stop: bigint, base: boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))


def mark(docs: DataFrame, model: Model, into: str, text: str = "text") -> DataFrame:
    """Add the array ``into`` (see SPANS) of a text's personal data to every row; places are code points.

    Spans the model adds never overlap what a pattern found. A null or empty text has none; texts are read
    whole at any length; repeated rows each keep theirs; an empty table gives no row; other columns may have
    any name but that of ``into``.
    """
    weights = model.weights

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(weights)
        for batch in batches:
            yield pa.array([[{"kind": k, "start": a, "stop": b, "base": p} for k, a, b, p in spans(t.as_py(), known)] for t in batch], _SPANS)

    return docs.withColumn(into, found(column(text)))
