"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from urnframe.llm.fim import op13_fill_in_middle
from urnframe.llm.fm_index import op10_fm_index
from urnframe.llm.katz import op3_katz
from urnframe.llm.langid import op9_language_id
from urnframe.llm.line_spread import OP5_SQL, op5_line_spread
from urnframe.llm.merkle_audit import OP2_SQL, op2_merkle_audit
from urnframe.llm.multi_index import op4_multi_index
from urnframe.llm.pack_curve import op1_curve_packing
from urnframe.llm.pair_align import op12_pair_alignment
from urnframe.llm.pigeonhole import op6_pigeonhole
from urnframe.llm.quality_fm import op11_factorisation_machine
from urnframe.llm.signature_join import op7_signature_join
from urnframe.llm.toxicity import op8_toxicity_cnn

QUERIES = {
    f.__name__: f
    for f in (
        op1_curve_packing, op2_merkle_audit, op3_katz, op4_multi_index, op5_line_spread, op6_pigeonhole, op7_signature_join, op8_toxicity_cnn,
        op9_language_id, op10_fm_index, op11_factorisation_machine, op12_pair_alignment, op13_fill_in_middle,
    )
}
SQL = {"op2_merkle_audit": OP2_SQL, "op5_line_spread": OP5_SQL}
