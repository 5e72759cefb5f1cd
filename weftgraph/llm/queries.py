"""Queries of the text operators over their whole tables."""

from __future__ import annotations

from weftgraph.llm import ann, bpe, decontaminate, htmltext, langid, secrets, simhash, spelling, suffixes, tokenfile, toxicity, warc, whitening
from weftgraph.llm.common import table

QUERIES = {
    "op1_ann": lambda spark, sf_dir: ann.op1(table(spark, sf_dir, "embeddings")),
    "op2_secrets": lambda spark, sf_dir: secrets.op2(table(spark, sf_dir, "documents")),
    "op3_html": lambda spark, sf_dir: htmltext.op3(table(spark, sf_dir, "pages")),
    "op4_language": lambda spark, sf_dir: langid.op4(table(spark, sf_dir, "documents")),
    "op5_byte_bpe": lambda spark, sf_dir: bpe.op5(table(spark, sf_dir, "documents")),
    "op6_decontaminate": lambda spark, sf_dir: decontaminate.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_toxicity": lambda spark, sf_dir: toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_token_file": lambda spark, sf_dir: tokenfile.op8(table(spark, sf_dir, "documents")),
    "op9_suffix_dedup": lambda spark, sf_dir: suffixes.op9(table(spark, sf_dir, "documents")),
    "op10_simhash": lambda spark, sf_dir: simhash.op10(table(spark, sf_dir, "documents")),
    "op11_warc": lambda spark, sf_dir: warc.op11(table(spark, sf_dir, "pages")),
    "op12_spelling": lambda spark, sf_dir: spelling.op12(table(spark, sf_dir, "documents")),
    "op13_whitening": lambda spark, sf_dir: whitening.op13(table(spark, sf_dir, "embeddings")),
}
#: Base32 of a digest by five bits at a time.
_WARC = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages), k AS (SELECT *, sha1(t) AS h, strlen(t) AS n FROM p),
g AS (SELECT t, max(page_id) AS kept FROM p GROUP BY t)
SELECT page_id, n AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((strpos('0123456789abcdef', substring(h, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substring(concat(h, '0'), 2 + (5 * i) // 4, 1)) - 1) // (1 << (3 - (5 * i) % 4)) % 32, 1)), '') AS payload_digest,
 CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to, url FROM k JOIN g USING (t)"""

#: CRC-32 by a table that SQL makes itself; near words by what is left when a letter is taken away.
_SPELLING = """WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL), x AS (SELECT doc_id, run, c, hex(encode(concat(doc_id, ':', run))) AS s FROM d),
b AS (SELECT doc_id, run, c, list_transform(range(length(s) // 2), lambda i: CAST((strpos('0123456789ABCDEF', substring(s, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substring(s, 2 * i + 2, 1)) - 1 AS BIGINT)) AS bytes FROM x),
h AS (SELECT run, c, coalesce(xor(list_reduce(list_concat([4294967295], bytes), lambda a, v: xor(a >> 8, t[1 + (xor(a, v) & 255)])), 4294967295), 1) AS h FROM b, tbl),
w0 AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2)) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w0 WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
del AS MATERIALIZED (SELECT word, n, i, concat(substring(word, 1, i), substring(word, i + 2)) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM del a JOIN del b ON a.k = b.k AND a.i = b.i AND a.word <> b.word UNION SELECT del.word, w.word, w.n FROM del JOIN w ON del.k = w.word UNION SELECT w.word, del.word, del.n FROM del JOIN w ON del.k = w.word),
best AS (SELECT x, count(*) OVER (PARTITION BY x) AS n_near, y, m, row_number() OVER (PARTITION BY x ORDER BY m DESC, y) AS r FROM near),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN y END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best ON x = word AND r = 1),
up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f e ON e.word = up.at AND e.form IS NULL"""

ORACLES: dict[str, str] = {"op11_warc": _WARC, "op12_spelling": _SPELLING}
