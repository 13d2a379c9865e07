"""Registered queries of this package, and the SQL of those that have one."""

from __future__ import annotations

from .bestfit import op7_packed_binary
from .centroids import OP13_SQL, op13_centroid_clustering
from .curvepack import op4_curve_packing
from .decontam import op3_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .improbable import op12_fingerprints
from .jaccard import op2_jaccard_join
from .licenses import OP6_SQL, op6_license_scan
from .linealign import op8_line_dedup
from .maxent import op5_maxent_scores
from .quality import OP1_SQL, op1_quality
from .suffixes import op10_suffix_dedup
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_curve_packing": op4_curve_packing,
    "op5_maxent_scores": op5_maxent_scores,
    "op6_license_scan": op6_license_scan,
    "op7_packed_binary": op7_packed_binary,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_fingerprints": op12_fingerprints,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES = {
    "op1_quality": OP1_SQL,
    "op6_license_scan": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
