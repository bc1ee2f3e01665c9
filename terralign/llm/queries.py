"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from terralign.llm import decontam, embeddings, linededup, lm, packing, pii, quality, search, sharding, simhash, substring, toxicity, trie

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_packing": packing.query,
    "op3_line_dedup": linededup.query,
    "op4_decontamination": decontam.query,
    "op5_pii": pii.query,
    "op6_quality": quality.query,
    "op7_sharding": sharding.query,
    "op8_embeddings": embeddings.query,
    "op9_simhash": simhash.query,
    "op10_language_model": lm.query,
    "op11_substring_dedup": substring.query,
    "op12_lexical_search": search.query,
    "op13_conversation_trie": trie.query,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": linededup.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op12_lexical_search": search.ORACLE,
    "op13_conversation_trie": trie.ORACLE,
    "op8_embeddings": """WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach AS (SELECT vec_id AS n, vec_id AS r FROM u UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n),
links AS (SELECT a, count(*) AS k FROM e GROUP BY a), least AS (SELECT n, min(r) AS r FROM reach GROUP BY n)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, r AS component_id, vec_id = r AS kept
FROM u LEFT JOIN links ON a = vec_id JOIN least ON n = vec_id""",
}
