"""The queries of this package, by name; SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe
from .chat import op3_chat
from .decontam import op9_decontam
from .embeddings import op2_embeddings
from .html import op5_html
from .langid import op6_langid
from .ngrams import op7_ngrams
from .substring import op1_substring
from .toxicity import op8_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_substring": op1_substring,
    "op2_embeddings": op2_embeddings,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_html": op5_html,
    "op6_langid": op6_langid,
    "op7_ngrams": op7_ngrams,
    "op8_toxicity": op8_toxicity,
    "op9_decontam": op9_decontam,
    "op10_warc": op10_warc,
}

_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: From links (a, b) and all ids: the smallest id that each reaches.
_REACH = """
        both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(v, r) AS (SELECT {id}, {id} FROM {source} UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.v),
        root AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)"""

SQL: dict[str, str] = {
    "op1_substring": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
        h AS (SELECT doc_id, list_transform(range(1, len(w) - 33), lambda p: md5(array_to_string(w[p:p + 34], ' '))) AS k FROM d WHERE len(w) >= 35),
        win AS (SELECT doc_id, unnest(k) AS k, unnest(range(1, len(k) + 1)) AS p FROM h),
        again AS (SELECT doc_id, p FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, p + i AS p FROM again CROSS JOIN (SELECT unnest(range(35)) AS i)),
        wd AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM wd ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op2_embeddings": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),{_REACH.format(id="vec_id", source="embeddings")}
        SELECT vec_id, (SELECT count(*) FROM both_ WHERE both_.a = vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN root ON root.v = vec_id""",
    "op3_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<a>|<t>|</r>|</t>')) AS n,
                     length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<a>|<t>|</r>|</t>')) AS m FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE m + 11 END))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op7_ngrams": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
        e AS (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),{_REACH.format(id="doc_id", source="documents")}
        SELECT s.doc_id, len(g) AS n_shingles, component_id FROM s JOIN root ON root.v = s.doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT payload_digest AS d, max(page_id) AS top FROM h WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM h LEFT JOIN g ON payload_digest = d""",
}
