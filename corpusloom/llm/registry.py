"""The queries of this package and their SQL twins."""

from __future__ import annotations

from . import bpe, conversations, html_text, line_dedup, maxscore, mixing, packing, pii, quality, runs, simhash, url_filter, warc


def queries() -> dict:
    found = (
        quality.op1_quality_rules,
        line_dedup.op2_line_dedup,
        url_filter.op3_url_filter,
        maxscore.op4_maxscore,
        simhash.op5_simhash,
        warc.op6_warc,
        html_text.op7_html_text,
        bpe.op8_byte_bpe,
        pii.op9_pii,
        mixing.op10_mix_sources,
        packing.op11_pack,
        conversations.op12_repair,
        runs.op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op3_url_filter": url_filter.OP3_SQL,
        "op4_maxscore": maxscore.OP4_SQL,
        "op6_warc": warc.OP6_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
        "op12_repair": conversations.OP12_SQL,
    }
