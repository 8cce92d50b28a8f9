"""The queries of this folder's operators, with DuckDB SQL where that can say the same over whole tables."""

from __future__ import annotations

from weftgraph.llm import decontaminate, licenses, near_dedup, neighbours, packing, pitman_yor, quality, sharding, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_shards": sharding.op2_shards,
        "op3_quality": quality.op3_quality,
        "op4_packing": packing.op4_packing,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_pitman_yor": pitman_yor.op6_pitman_yor,
        "op7_urls": url_filter.op7_urls,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": near_dedup.OP1_SQL, "op7_urls": url_filter.OP7_SQL, "op8_neighbours": neighbours.OP8_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
