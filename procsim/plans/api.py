"""The public surface: what a user of the library calls."""

from __future__ import annotations

from procsim.models import Models
from procsim.operators.explore import Traces, extract_traces, to_variant_event_log
from procsim.operators.items import extract_items
from procsim.operators.normalize import build_mapping, embedded, normalize, vectors_of
from procsim.operators.rollup import all_pairs, fine_scores, hybrid, structural_similarity
from procsim.operators.traces import compare_traces, extract_ngrams, ngram_similarity, trace_similarity
from procsim.sources.load import Loaded, load_models, load_texts

__all__ = [
    "Loaded", "Models", "Traces", "all_pairs", "build_mapping", "compare_traces", "embedded", "extract_items", "extract_ngrams", "extract_traces",
    "fine_scores", "hybrid", "load_models", "load_texts", "ngram_similarity", "normalize", "structural_similarity", "to_variant_event_log", "trace_similarity", "vectors_of",
]
