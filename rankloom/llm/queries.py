"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, bpe_automaton, language_mix, masked_lm, minhash, packing, pii, pivot_index, spelling, spot_signatures, token_files, toxicity, winnowing


def queries() -> dict:
    return {
        "op1_toxicity_chain": toxicity.op1_toxicity_chain,
        "op2_bpe_automaton": bpe_automaton.op2_bpe_automaton,
        "op3_pii_surrogates": pii.op3_pii_surrogates,
        "op4_language_mix": language_mix.op4_language_mix,
        "op5_packing": packing.op5_packing,
        "op6_masked_lm": masked_lm.op6_masked_lm,
        "op7_pivot_index": pivot_index.op7_pivot_index,
        "op8_minhash_dedup": minhash.op8_minhash_dedup,
        "op9_token_files": token_files.op9_token_files,
        "op10_spot_signatures": spot_signatures.op10_spot_signatures,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_winnowing": winnowing.op12_winnowing,
        "op13_cross_alignment": alignment.op13_cross_alignment,
    }


OP7 = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, component_id, coalesce(e.vec_id = component_id, true) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = x LEFT JOIN degrees d ON e.vec_id = d.a
"""

OP8 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), placed AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words WHERE len(w) >= 5),
chains AS (
    SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS shingle
    FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), own AS (
    SELECT DISTINCT doc_id, shingle FROM chains WHERE shingle IS NOT NULL
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
), sizes AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
shingles AS (SELECT doc_id, n, shingle FROM own JOIN sizes USING (doc_id)),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b
    ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, if(r.y = l.a, l.b, l.a) FROM reach r JOIN links l ON r.y = l.a OR r.y = l.b
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept
FROM documents d LEFT JOIN least ON d.doc_id = x LEFT JOIN sizes ON d.doc_id = sizes.doc_id
"""

OP12 = r"""
WITH items AS (
    SELECT item_id, w, least(10, len(w)) AS m
    FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
    WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM items)
), docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), starts AS (
    SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
    FROM (SELECT doc_id, m, w, unnest(generate_series(1, len(w) - m + 1)) AS s FROM docs, (SELECT DISTINCT m FROM items) WHERE len(w) >= m)
), hits AS (SELECT doc_id, s, m, item_id FROM starts JOIN windows USING (m, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM hits) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_pivot_index": OP7, "op8_minhash_dedup": OP8, "op12_winnowing": OP12}
