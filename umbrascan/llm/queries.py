"""The registered queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbrascan.llm import (
    bpe,
    chat,
    collocations,
    exact_topk,
    main_text,
    near_duplicates,
    neighbours,
    packing,
    prefix_trie,
    substrings,
    token_counts,
    token_files,
    toxicity,
)
from umbrascan.llm.shared import table

PATTERN = public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(control).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    done = chat.format_turn_rows(rows).select("conv_id", "formatted", "loss_spans")
    read = done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS written,
         length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ': ', '\c ')) AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + head + 2 + written + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50
), h AS (
  SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS win FROM s
), f AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (win) WHERE first < doc_id
), k AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), o AS (
  SELECT k.doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY k.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN o USING (doc_id)
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode(table(spark, sf_dir, "documents"), path, PATTERN, decoded="decoded")
    return done.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.write_and_read(table(spark, sf_dir, "documents"), path, PATTERN, 2, with_ids=False).drop("ids")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=4)


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM inter JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)
), reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.to_id
), c AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), PATTERN)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt(rows))


TRIE_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)[:32]) AS turns
  FROM r GROUP BY conv_id
), crc AS (
  SELECT conv_id, turns, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda x: 0::BIGINT)),
                          lambda u, v: xor(u >> 1, 3988292384::BIGINT * (u & 1))))) % 4 AS h
  FROM own
), built AS (
  SELECT c.conv_id, coalesce(b.turns[1 : c.h], []) || c.turns[c.h + 1 :] AS turns
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), p AS (
  SELECT conv_id, len(turns) AS l, turns, unnest(range(0, len(turns) + 1)) AS d FROM built
), q AS (
  SELECT conv_id, l, d, turns[1 : d] AS node, CASE WHEN d > 0 THEN turns[1 : d - 1] END AS above, CASE WHEN d > 0 THEN turns[d].text ELSE '' END AS last FROM p
), n AS (
  SELECT node, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
         len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE l = d), '')) AS ends_sha256
  FROM q GROUP BY node, d
), k AS (SELECT above AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above
), m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)
), up AS (
  SELECT node[1 : a] AS node, n_children, n_convs, words FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m)
), s AS (
  SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM up GROUP BY node
)
SELECT m.conv_id, m.d::BIGINT AS depth, x.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (node) LEFT JOIN m x ON x.node = m.above
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


PHRASE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), n AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(words) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100
), c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1
), u AS (SELECT *, unnest(range(1, k)) AS cut FROM c
), s AS (
  SELECT u.lang, u.phrase, u.a, u.cut, x.a AS l, y.a AS r, n.n,
         (1000 * u.a::HUGEINT * n.n) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM u JOIN n USING (lang)
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.words[1 : u.cut], ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.words[u.cut + 1 :], ' ')
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_spans AS (
  SELECT lang, a AS f, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))
), lost AS (
  SELECT DISTINCT low.lang, low.phrase FROM low JOIN inner_spans i ON i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.f >= 100 * low.a
), ranked AS (
  SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM low ANTI JOIN lost USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


PAGE_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS inside FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split(regexp_replace(inside, '</?(p|h1)>', chr(1), 'g'), chr(1)), lambda x:
    replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', chr(1)), '&amp', chr(1))) AS blocks
  FROM a
), c AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(replace(x, chr(1), '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_chat,
        op3_substrings,
        op4_byte_bpe,
        op5_neighbours,
        op6_token_files,
        op7_token_counts,
        op8_near_duplicates,
        op9_packing,
        op10_exact_topk,
        op11_prefix_trie,
        op12_collocations,
        op13_main_text,
    )
}


def oracles() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op2_chat": CHAT_SQL, "op3_substrings": SUBSTRING_SQL, "op8_near_duplicates": NEAR_SQL, "op10_exact_topk": TOPK_SQL, "op11_prefix_trie": TRIE_SQL, "op12_collocations": PHRASE_SQL, "op13_main_text": PAGE_SQL}
