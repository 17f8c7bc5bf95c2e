"""All registered queries of the subpackage."""

from __future__ import annotations

from ._common import QUERIES


def load_all() -> dict:
    """Import every operator module (each registers its query on import)."""
    from . import (  # noqa: F401
        chat, chunked_bpe, langid, metric_join, mixing, ns_clustering, parity_join, piece_lattice, posting_lists,
        suffix_dedup, token_alignment, token_counts, toxicity,
    )
    return QUERIES
