"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import license_scan, phrases, variants, vptree
from .bpe import op1_bpe_round_trip
from .html_text import op8_main_text
from .jaccard_join import op6_jaccard_components
from .kneser_ney import op9_kneser_ney
from .license_scan import op7_license_digests
from .mixing import op4_soft_mixing
from .phrases import op11_phrases
from .quality_net import op2_quality_net
from .quality_rules import op3_robust_rules
from .token_counts import op5_trie_counts
from .url_models import op12_url_ratio
from .variants import op13_spelling_variants
from .vptree import op10_vantage_trees

QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_quality_net": op2_quality_net,
    "op3_robust_rules": op3_robust_rules,
    "op4_soft_mixing": op4_soft_mixing,
    "op5_trie_counts": op5_trie_counts,
    "op6_jaccard_components": op6_jaccard_components,
    "op7_license_digests": op7_license_digests,
    "op8_main_text": op8_main_text,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_vantage_trees": op10_vantage_trees,
    "op11_phrases": op11_phrases,
    "op12_url_ratio": op12_url_ratio,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op7_license_digests": license_scan.oracle(),
    "op10_vantage_trees": vptree.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op13_spelling_variants": variants.ORACLE,
}
