"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op4_benchmark_passages
from .dialogue import op11_edit_lattice
from .language import op13_compression_language
from .line_chunks import op6_line_chunks
from .neighbours import op5_anisotropic_search
from .packing import op1_best_fit_packing
from .quality import op9_quality
from .resample import op12_importance_resampling
from .sharding import op10_two_pass_shuffle
from .simhash import op3_simhash_components
from .token_files import op7_token_files
from .toxicity import op2_classifier_chain
from .url_rules import SQL as URL_SQL
from .url_rules import op8_redirect_equivalence

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_classifier_chain": op2_classifier_chain,
    "op3_simhash_components": op3_simhash_components,
    "op4_benchmark_passages": op4_benchmark_passages,
    "op5_anisotropic_search": op5_anisotropic_search,
    "op6_line_chunks": op6_line_chunks,
    "op7_token_files": op7_token_files,
    "op8_redirect_equivalence": op8_redirect_equivalence,
    "op9_quality": op9_quality,
    "op10_two_pass_shuffle": op10_two_pass_shuffle,
    "op11_edit_lattice": op11_edit_lattice,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_compression_language": op13_compression_language,
}
SQL: dict[str, str] = {"op8_redirect_equivalence": URL_SQL}
