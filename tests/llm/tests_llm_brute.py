"""Brute-force versions of the first three stages."""

from test_decontaminate import brute as windows
from test_neardup import brute as groups
from test_quality import brute as measures

from tallyshelf.llm import quality


def quality_kept(text):
    return not measures(text)["fail_bits"] & quality.PLAIN.mask


def near_duplicates(texts, n):
    return [i for i, (_, c) in groups(list(texts.items()), n).items() if i == c]


def decontaminated(text, items):
    return windows(text, [(r["item_id"], r["text"]) for r in items])[1] > 0
