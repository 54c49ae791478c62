"""The registered queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from versoscan.llm import chat, sharding, warc
from versoscan.llm.decontaminate import decontaminate_query
from versoscan.llm.html import html_query
from versoscan.llm.packing import packing_query
from versoscan.llm.pii import pii_query
from versoscan.llm.quality import quality_query
from versoscan.llm.resampling import resampling_query
from versoscan.llm.simhash import simhash_query
from versoscan.llm.substrings import substrings_query
from versoscan.llm.suffixes import suffixes_query
from versoscan.llm.whitening import whitening_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": html_query,
    "op2_decontaminate": decontaminate_query,
    "op3_suffix_arrays": suffixes_query,
    "op4_pii": pii_query,
    "op5_substrings": substrings_query,
    "op6_sharding": sharding.sharding_query,
    "op7_warc": warc.warc_query,
    "op8_quality_rules": quality_query,
    "op9_packing": packing_query,
    "op10_simhash": simhash_query,
    "op11_whitening": whitening_query,
    "op12_chat": chat.chat_query,
    "op13_resampling": resampling_query,
}
ORACLE_SQL: dict[str, str] = {
    "op6_sharding": sharding.oracle(),
    "op7_warc": warc.ORACLE,
    "op12_chat": chat.ORACLE,
}
