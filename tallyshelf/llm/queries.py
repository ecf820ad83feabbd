"""Imports every query module of this subpackage, which registers its queries."""

from tallyshelf.llm import q_chat, q_collocations, q_decontaminate, q_html_text, q_mix, q_neardup, q_pii, q_quality, q_repair, q_shard, q_token_counts, q_token_files, q_warc  # noqa: F401
from tallyshelf.llm.registry import ORACLES, QUERIES  # noqa: F401
