"""Names of the queries of this subpackage, and their SQL where SQL can express them."""

from tidemark.llm import convtrie, jaccard, lexical, mixing, suffixes, topk
from tidemark.llm.convtrie import op12_convtrie
from tidemark.llm.html import op5_html
from tidemark.llm.jaccard import op7_jaccard
from tidemark.llm.language import op10_language
from tidemark.llm.lexical import op13_lexical
from tidemark.llm.mixing import op2_mixing
from tidemark.llm.packing import op6_packing
from tidemark.llm.ppm import op11_ppm
from tidemark.llm.quality import op8_quality
from tidemark.llm.secrets import op1_secrets
from tidemark.llm.suffixes import op3_suffixes
from tidemark.llm.topk import op4_topk
from tidemark.llm.urls import op9_urls

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_suffixes": op3_suffixes,
    "op4_topk": op4_topk,
    "op5_html": op5_html,
    "op6_packing": op6_packing,
    "op7_jaccard": op7_jaccard,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_language": op10_language,
    "op11_ppm": op11_ppm,
    "op12_convtrie": op12_convtrie,
    "op13_lexical": op13_lexical,
}
ORACLE_SQL = {"op2_mixing": mixing.ORACLE, "op3_suffixes": suffixes.ORACLE, "op4_topk": topk.ORACLE, "op7_jaccard": jaccard.ORACLE, "op12_convtrie": convtrie.ORACLE, "op13_lexical": lexical.ORACLE}
