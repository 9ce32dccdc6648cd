"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from kinweave.llm.bpe import op11_bpe
from kinweave.llm.decontaminate import op9_decontamination
from kinweave.llm.langid import op6_langid
from kinweave.llm.lm import op5_lm
from kinweave.llm.mixing import op8_mixing
from kinweave.llm.quality_model import op2_quality
from kinweave.llm.quality_rules import op4_quality_rules
from kinweave.llm.simhash import op1_simhash
from kinweave.llm.spelling import op12_spelling
from kinweave.llm.substrings import op10_substrings
from kinweave.llm.toxicity import op3_toxicity
from kinweave.llm.warc import op7_warc
from kinweave.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_quality, op3_toxicity, op4_quality_rules, op5_lm,
        op6_langid, op7_warc, op8_mixing, op9_decontamination, op10_substrings, op11_bpe, op12_spelling, op13_whitening,
    )
}

ORACLES = {
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
        ), b AS (SELECT d, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN best <> page_id THEN best END AS refers_to
        FROM p LEFT JOIN b ON p.d = b.d AND n >= 1000
    """,
    "op10_substrings": r"""
        WITH texts AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS w
            FROM texts, unnest(range(1, len(ws) - 33)) AS t(i)
        ), twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE w IN (SELECT w FROM twice)
        ), words AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM texts
        ), kept AS (
            SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS k
            FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)
    """,
}
