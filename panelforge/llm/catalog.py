"""The queries of this subpackage, one for each operator, and their SQL where there is one."""

from .bestfit import op11_best_fit
from .bpe_automaton import op10_bpe_automaton
from .divergence import OP13_SQL, op13_divergence
from .embedding_dedup import OP4_SQL, op4_embedding_dedup
from .html_wrapper import op7_html_extract
from .langid import op6_language_id
from .licenses import op5_license_scan
from .ngram_join import OP3_SQL, op3_ngram_join
from .packing import op8_packing
from .secrets import op9_secret_scan
from .syncmers import op2_syncmers
from .toxicity import op1_toxicity
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_syncmers, op3_ngram_join, op4_embedding_dedup, op5_license_scan, op6_language_id, op7_html_extract, op8_packing, op9_secret_scan, op10_bpe_automaton,
                                      op11_best_fit, op12_whitening, op13_divergence)}
ORACLES = {"op3_ngram_join": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op13_divergence": OP13_SQL}
