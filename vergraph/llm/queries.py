"""The registered queries of the operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import grade_texts, grades_of

    return grade_texts(table(spark, sf_dir, "documents"), grades_of(table(spark, sf_dir, "labels")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import find_repeats, report

    return report(find_repeats(table(spark, sf_dir, "documents")))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, write_store

    return read_store(spark, write_store(table(spark, sf_dir, "documents")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination, report

    return report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_load

    return shard_by_load(table(spark, sf_dir, "documents"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import fit_and_score

    return fit_and_score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .languages import identify

    return identify(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import trie_of_rebuilt

    return trie_of_rebuilt(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ann, op2_quality, op3_repeats, op4_minhash, op5_token_store, op6_html_text, op7_decontaminate, op8_sharding, op9_brown_lm, op10_packing, op11_languages, op12_prefix_trie, op13_spelling)
}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SHINGLES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(LOW, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, min(other) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
WINDOWS = r"""WITH b AS (SELECT item_id, regexp_extract_all(LOW, 'PATTERN') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(LOW, 'PATTERN') AS w FROM documents),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM bw) ON len(w) >= k)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
#: crc32 of a list of bytes, by a table of 256 remainders that is made here.
CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"
CRC = "xor(list_reduce(list_concat([4294967295], BYTES), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
TRIE = r"""WITH TABLE,
u AS (SELECT conv_id AS c, turn, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, list(s ORDER BY turn NULLS FIRST, s.r, sha256(concat(length(s.r), ':', s.r, s.x))) AS t FROM u GROUP BY c),
h AS (SELECT c, t, CRC % 6 AS h FROM g, tab),
p AS (SELECT h.c, list_concat(coalesce(g.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN g ON g.c = h.c - h.c % 100),
m AS (SELECT c, d, t[1:d] AS k, d = len(t) AS ended FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM p)),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends FROM m GROUP BY d, k),
k AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
o AS (SELECT n.d, n.k, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.k[n.d].x) END AS own, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.k = n.k),
a AS (SELECT k[1:a] AS k, sum(own) AS saved, sum(leaf) AS leaves FROM (SELECT k, own, leaf, unnest(range(0, d + 1)) AS a FROM o) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(o.n_children AS BIGINT) AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN o ON o.k = n.k JOIN a ON a.k = n.k LEFT JOIN n q ON n.d > 0 AND q.k = n.k[1:n.d - 1]"""
SPELLING = r"""WITH RECURSIVE TABLE,
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT id, w, count(*) AS n, length(w) AS l FROM r GROUP BY 1, 2),
c AS (SELECT w, n, l, CRC AS h FROM h, tab),
v AS (SELECT w, sum(n) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(substring(w, 1, h % l), substring(w, h % l + 2)) ELSE w END AS w, n FROM c) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
d AS (SELECT w, n, i, concat(substring(w, 1, i - 1), substring(w, i + 1)) AS s FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
e AS (SELECT DISTINCT a.w AS x, b.w AS y FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.w <> b.w UNION SELECT v.w, d.w FROM v JOIN d ON d.s = v.w UNION SELECT d.w, v.w FROM v JOIN d ON d.s = v.w),
p AS (SELECT x, count(*) AS n_near, arg_min(y, (-m.n, encode(y))) AS y, max(m.n) AS m FROM e JOIN v m ON m.w = e.y GROUP BY x),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN y END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN p ON p.x = v.w),
o AS (SELECT w, w AS root FROM f UNION ALL SELECT o.w, f.form FROM o JOIN f ON f.w = o.root WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, o.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN o ON o.w = f.w JOIN f z ON z.w = o.root AND z.form IS NULL"""
#: The UTF-8 bytes of text up to U+00FF.
LATIN_BYTES = "flatten(list_transform(string_split(concat(id, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + CAST(unicode(x) AS BIGINT) // 64, 128 + CAST(unicode(x) AS BIGINT) % 64] END))"
ORACLE_SQL: dict[str, str] = {
    "op4_minhash": SHINGLES.replace("LOW", LOWER),
    "op7_decontaminate": WINDOWS.replace("LOW", LOWER).replace("PATTERN", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    "op12_prefix_trie": TRIE.replace("CRC", CRC.replace("BYTES", "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")).replace("TABLE", CRC_TABLE),
    "op13_spelling": SPELLING.replace("CRC", CRC.replace("BYTES", LATIN_BYTES)).replace("TABLE", CRC_TABLE),
}
