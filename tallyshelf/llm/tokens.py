"""Token ids of texts by a public tokenizer, for use inside tasks."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Pre-tokens a Python worker remembers with their ids; others are encoded again when they come back.
REMEMBERED = 400_000

# In texts of these characters the pre-tokens of byte-level BPE need no Unicode tables: ASCII, Latin-1
# letters and signs that are neither letter, number nor white space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿×÷À-ÖØ-öø-ÿ‐-‧‰-⁞€]*")
_PRETOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\r0-9{_LETTERS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_OPEN: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes whole texts without special tokens of its own.

    Byte-level BPE looks at one pre-token at a time, so a pre-token is encoded once and remembered, and a
    text's ids are the ids of its pre-tokens in turn. Texts with characters beyond ``_PLAIN`` or with an
    added token in them, and any other kind of tokenizer, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        pre = told.get("pre_tokenizer") or {}
        self.byte_level = (
            told["model"]["type"] == "BPE" and not told.get("normalizer") and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        self.opens = np.array([str(self.library.id_to_token(i)).startswith("Ġ") for i in range(size)])
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens. Those that open with their only space are encoded in one text, which comes
        apart where a token opens with a space."""
        out = {}
        joined = [x for x in new if x[0] == " " and len(x) > 1 and x.find(" ", 1) < 0 and not x[1].isspace()]
        for k in range(0, len(joined), 4096):
            part = joined[k:k + 4096]
            ids = np.array(self.library.encode("".join(part), add_special_tokens=False).ids, self.type)
            edges = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * self.type.itemsize
            raw = ids.tobytes()
            if len(edges) != len(part) + 1:
                out.update(zip(part, self._ids(part)))
                continue
            out.update(zip(part, map(raw.__getitem__, map(slice, edges[:-1].tolist(), edges[1:].tolist()))))
        rest = [x for x in new if x not in out]
        out.update(zip(rest, self._ids(rest)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, in ``self.type``; null is the empty text."""
        texts = [t or "" for t in texts]
        out: list[bytes | None] = [None] * len(texts)
        split = {}
        for i, t in enumerate(texts):
            if self.byte_level and _PLAIN.fullmatch(t) and not any(a in t for a in self.added):
                split[i] = _PRETOKENS.findall(t)
        known = self.known
        new = self._learn(sorted(set().union(*split.values()).difference(known)))
        known.update(new)
        for i, parts in split.items():
            out[i] = b"".join(map(known.__getitem__, parts))
        # What is beyond the limit is forgotten again.
        for p in list(new)[max(0, REMEMBERED - len(known) + len(new)):]:
            del known[p]
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, opened once per Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def portions(texts: list, characters: int = 1 << 20):
    """Slices of a list of texts that hold about so many characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= characters:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]
