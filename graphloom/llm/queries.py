"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op12_byte_bpe
from .decontamination import op7_decontamination_winnowing
from .licenses import ORACLE as LICENSE_SQL
from .licenses import op4_license_scan
from .lm import op5_log_bilinear_nce
from .media import op8_media_columns
from .packing import op9_hierarchical_packing
from .quality import op1_quality_bradley_terry
from .sharding import op10_hilbert_sharding
from .simhash import op6_simhash_pigeonring
from .spelling import op11_spelling_variants
from .tokenfile import op3_token_files
from .toxicity import op2_toxicity_segments
from .whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_bradley_terry, op2_toxicity_segments, op3_token_files, op4_license_scan, op5_log_bilinear_nce,
        op6_simhash_pigeonring, op7_decontamination_winnowing, op8_media_columns, op9_hierarchical_packing, op10_hilbert_sharding, op11_spelling_variants,
        op12_byte_bpe, op13_embedding_whitening,
    )
}

ORACLES = {"op4_license_scan": LICENSE_SQL}
