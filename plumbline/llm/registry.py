"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from plumbline.llm.fingerprints import op2_scaled_sketch
from plumbline.llm.jaccard import ORACLE_SQL, op10_jaccard_join
from plumbline.llm.langid import op9_byte_cnn
from plumbline.llm.licenses import op5_license_dice
from plumbline.llm.media import op8_avi_mjpeg
from plumbline.llm.packing import op7_pack_sum_of_squares
from plumbline.llm.rank_bpe import op4_rank_bpe
from plumbline.llm.shards import op1_minimax_shards
from plumbline.llm.token_orc import op3_token_orc
from plumbline.llm.toxicity import op6_toxicity_chain

QUERIES = {f.__name__: f for f in (op1_minimax_shards, op2_scaled_sketch, op3_token_orc, op4_rank_bpe, op5_license_dice, op6_toxicity_chain, op7_pack_sum_of_squares, op8_avi_mjpeg, op9_byte_cnn, op10_jaccard_join)}
ORACLES: dict[str, str] = {"op10_jaccard_join": ORACLE_SQL}
