"""Queries of the corpus operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import divergence, interaction
from strandlake.llm.decontaminate import op7_decontamination
from strandlake.llm.divergence import op12_divergence
from strandlake.llm.interaction import op13_interaction
from strandlake.llm.langid import op2_language
from strandlake.llm.licenses import op1_licenses
from strandlake.llm.lm import op11_attention
from strandlake.llm.ordinal import op5_ordinal
from strandlake.llm.packing import op6_packing
from strandlake.llm.quality import op3_quality
from strandlake.llm.secrets import op8_secrets
from strandlake.llm.simhash import op4_simhash
from strandlake.llm.tokenfile import op10_tokenfile
from strandlake.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_language": op2_language,
        "op3_quality": op3_quality,
        "op4_simhash": op4_simhash,
        "op5_ordinal": op5_ordinal,
        "op6_packing": op6_packing,
        "op7_decontamination": op7_decontamination,
        "op8_secrets": op8_secrets,
        "op9_toxicity": op9_toxicity,
        "op10_tokenfile": op10_tokenfile,
        "op11_attention": op11_attention,
        "op12_divergence": op12_divergence,
        "op13_interaction": op13_interaction,
    }


#: Operator 7 over strings of words.
_DECONTAMINATION = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
occ AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, (SELECT DISTINCT m FROM win))),
hit AS (SELECT doc_id, p, m, item_id FROM occ JOIN win USING (m, s)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": _DECONTAMINATION, "op12_divergence": divergence.ORACLE_SQL, "op13_interaction": interaction.ORACLE_SQL}
