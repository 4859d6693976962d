"""All registered queries of the library but those of the corpus operators."""

from __future__ import annotations

from . import alignment_queries, classifier_queries, evidence_queries, graph_queries, kernel_queries, measure_queries, pair_graph_queries, program_queries, reference_queries, result_queries, search_queries, sequencing_queries, spectra_queries, spectrum_queries, training_queries

_MODULES = (spectra_queries, result_queries, graph_queries, kernel_queries, evidence_queries, program_queries, measure_queries, sequencing_queries, alignment_queries, pair_graph_queries, spectrum_queries, search_queries, reference_queries, classifier_queries, training_queries)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
