"""The queries of the training-data operators by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from voxmere.llm import decontam, langid, linededup, neardup, neighbours, packing, quality, repair, repeats, sharding, toxicity, variants, webp

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_webp": webp.op2_webp,
    "op3_language": langid.op3_language,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_histogram_sort": sharding.op6_histogram_sort,
    "op7_packing": packing.op7_packing,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_repeats": repeats.op10_repeats,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_variants": variants.op12_variants,
    "op13_repair": repair.op13_repair,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": linededup.ORACLE,
}
