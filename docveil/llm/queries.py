"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op9_byte_bpe
from .fingerprint import op5_fingerprint
from .language_id import op3_language_id
from .near_vectors import op2_embedding_near_dedup
from .ngram_join import op1_ngram_jaccard_join
from .packing import op8_packing
from .quality import op10_quality
from .substring import op6_substring_dedup
from .token_counts import op4_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_fingerprint": op5_fingerprint,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality": op10_quality,
}
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
#: the smallest id that links reach, from CTEs `ids` (id) and `links` (a, b)
_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM ids UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
named AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ids AS (SELECT doc_id AS id FROM documents), {_REACH},
of_doc AS (SELECT a AS doc_id, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN of_doc ON of_doc.doc_id = w.doc_id JOIN named ON named.id = w.doc_id""",
    "op2_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT named.id AS vec_id, coalesce(n, 0) AS n_links, component_id, named.id = component_id AS kept FROM named LEFT JOIN n USING (id)""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS l FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 34], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM w WHERE len(l) >= 35)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (h)),
own AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM own ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(l) AS n_words, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}
