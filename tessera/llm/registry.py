"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tessera.llm import jaccard, media, mixing, packing, pii, quality, secrets, substring, urls, vectors


def queries() -> dict:
    return {
        "op1_suffix_dedup": substring.op1_suffix_dedup,
        "op2_crf_quality": quality.op2_crf_quality,
        "op3_entropy_mixing": mixing.op3_entropy_mixing,
        "op4_jaccard_join": jaccard.op4_jaccard_join,
        "op5_host_segmentation": urls.op5_host_segmentation,
        "op6_audio_features": media.op6_audio_features,
        "op7_credential_linking": secrets.op7_credential_linking,
        "op8_deobfuscated_pii": pii.op8_deobfuscated_pii,
        "op9_collision_counting": vectors.op9_collision_counting,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }


#: Reaches every link from every row, so it is for small tables.
_REACH = "r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), m AS (SELECT x, min(y) AS y FROM r GROUP BY x), c AS (SELECT x, count(*) AS n FROM l GROUP BY x)"

JACCARD = (
    r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
g AS (SELECT DISTINCT doc_id, g FROM s), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)), """
    + _REACH
    + " SELECT doc_id, least(doc_id, coalesce(m.y, doc_id)) AS class_id, coalesce(c.n, 0) AS n_links FROM documents LEFT JOIN m ON m.x = doc_id LEFT JOIN c ON c.x = doc_id"
)

VECTORS = (
    """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
w AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98), """
    + _REACH
    + " SELECT vec_id, coalesce(c.n, 0) AS n_links, least(vec_id, coalesce(m.y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.y, vec_id)) AS kept FROM embeddings LEFT JOIN m ON m.x = vec_id LEFT JOIN c ON c.x = vec_id"
)


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": JACCARD, "op9_collision_counting": VECTORS}
