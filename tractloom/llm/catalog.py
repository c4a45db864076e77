"""All registered queries of this package: importing the query modules fills the registry."""

from . import query_chat, query_divergence, query_exact_dedup, query_lm, query_mixing, query_ngram_join, query_packing, query_pii, query_prefix_trie, query_secrets, query_sharding, query_topk, query_toxicity  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
