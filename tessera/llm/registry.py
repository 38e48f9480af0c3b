"""The registered corpus queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import align, decontam, fim, html, langid, licenses, merkle, mixing, quality, secrets, simhash, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle": merkle.query,
        "op2_simhash": simhash.query,
        "op3_html": html.query,
        "op4_licenses": licenses.query,
        "op5_langid": langid.query,
        "op6_secrets": secrets.query,
        "op7_decontam": decontam.query,
        "op8_warc": warc.query,
        "op9_mixing": mixing.query,
        "op10_token_files": token_files.query,
        "op11_fim": fim.query,
        "op12_quality": quality.query,
        "op13_align": align.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op7_decontam": decontam.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL, "op11_fim": fim.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
