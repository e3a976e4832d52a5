"""Registered queries of the text operators and, where SQL can express them, the DuckDB text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.llm import bpe, decontaminate, exact_dedup, language_id, nn_descent, prefix_trie, quality, secret_ledger, simhash_dedup, substring_dedup, token_alignment, toxicity, url_filter
from alarmlens.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark, d):
    return exact_dedup.exact_groups(table(spark, d, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text) AS keep_id,
       count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
       sha256(text) AS text_sha256
FROM t
"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op10_bpe(spark, d):
    return bpe.encode_documents(table(spark, d, "documents"), vocabulary())


@query
def op7_simhash_dedup(spark, d):
    return simhash_dedup.near_groups(table(spark, d, "documents"))


@query
def op8_decontaminate(spark, d):
    report = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return report.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


ORACLES["op8_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
         array_to_string(words[s : s + least(10, len(words)) - 1], ' ') AS span
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS s FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM spans),
places AS (
  SELECT doc_id, size, s, array_to_string(words[s : s + size - 1], ' ') AS span
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s
        FROM docs, sizes WHERE len(words) >= size)),
hits AS (SELECT doc_id, size, s, span FROM places WHERE (span, size) IN (SELECT (span, size) FROM spans)),
words_hit AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS w FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT h.doc_id, CAST(p.item_id AS VARCHAR) AS item
        FROM (SELECT DISTINCT doc_id, size, span FROM hits) h JOIN spans p USING (span, size)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.list, '')) AS items_sha256,
       coalesce(w.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words_hit w USING (doc_id) LEFT JOIN items_hit i USING (doc_id)
"""


@query
def op4_secret_ledger(spark, d):
    rules = secret_ledger.BASE_RULES + secret_ledger.ADDED_RULES
    found = secret_ledger.scan(table(spark, d, "documents"), secret_ledger.new_ledger(spark), rules)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(secret_ledger.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_ledger.spans_text(F.col("spans")).alias("spans"),
    )


def _spans_sql(kind: str, rank: int, pattern: str, value: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, stop - len(m[i]) AS start, stop
  FROM (SELECT doc_id, m, v, i, list_sum(list_transform(p[1:i], lambda x: len(x))) +
               list_sum(list_transform(m[1:i], lambda x: len(x))) AS stop
        FROM (SELECT doc_id, m, p, v, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}', 0) AS m, regexp_split_to_array(text, '{quoted}') AS p,
                           regexp_extract_all(text, '{quoted}', {value}) AS v FROM t)))
  WHERE len(v[i]) >= {least}"""


ORACLES["op4_secret_ledger"] = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ("
    + " UNION ALL ".join(
        [
            _spans_sql(
                "assign",
                0,
                r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                2,
                6,
            ),
            _spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, 20),
            _spans_sql("hex", 2, "[0-9a-f]+", 0, 24),
            *[_spans_sql(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secret_ledger.ADDED_RULES, 3)],
        ]
    )
    + """), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank)
           FILTER (rank < 3) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined j ON j.doc_id = t.doc_id
"""
)


@query
def op3_url_filter(spark, d):
    return url_filter.judge(table(spark, d, "pages"))


@query
def op5_quality(spark, d):
    return quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_toxicity(spark, d):
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op6_language_id(spark, d):
    return language_id.languages(table(spark, d, "documents"))


@query
def op9_substring_dedup(spark, d):
    return substring_dedup.deduplicated(table(spark, d, "documents")).drop("spans")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op11_token_alignment(spark, d):
    return token_alignment.alignments(table(spark, d, "documents"), vocabulary(), piece_model())


@query
def op12_prefix_trie(spark, d):
    return prefix_trie.prefix_trie(table(spark, d, "conversations"))


ORACLES["op12_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS mark, strlen(text) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
           list_prepend(4294967295, range(0, 8 * length(digits))),
           lambda acc, i: CASE WHEN i % 8 = 0 THEN
               CASE WHEN xor(acc, ascii(digits[i // 8 + 1])) % 2 = 1
                    THEN xor(xor(acc, ascii(digits[i // 8 + 1])) >> 1, 3988292384)
                    ELSE xor(acc, ascii(digits[i // 8 + 1])) >> 1 END
             ELSE CASE WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END END)) % 9 AS h
  FROM (SELECT conv_id, n, CAST(conv_id AS VARCHAR) AS digits FROM n)),
c AS (SELECT crc.conv_id, crc.base, crc.h, least(crc.h, coalesce(n.n, 0)) AS taken
      FROM crc LEFT JOIN n ON n.conv_id = crc.base),
rebuilt AS (
  SELECT c.conv_id, t.pos AS depth, mark, size FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, c.taken + t.pos - c.h, mark, size FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT c.conv_id, coalesce(string_agg(mark, '' ORDER BY depth), '') AS path, list(size ORDER BY depth) AS sizes, count(depth) AS len
  FROM c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, len, d, path[1 : 32 * d] AS key, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
            FROM (SELECT *, unnest(range(0, len + 1)) AS d FROM paths)),
nodes AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len), '') AS ends
          FROM members GROUP BY d, key),
kids AS (SELECT key[1 : 32 * (d - 1)] AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT key[1 : 32 * e] AS key, sum((n_convs - 1) * size) AS saved, count(*) FILTER (childless) AS leaves
  FROM (SELECT nodes.*, kids.key IS NULL AS childless, unnest(range(0, d + 1)) AS e FROM nodes LEFT JOIN kids USING (key))
  GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs,
       coalesce(kids.n_children, 0) AS n_children, below.leaves AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN below USING (key) LEFT JOIN kids USING (key)
LEFT JOIN nodes p ON x.d > 0 AND p.key = x.key[1 : 32 * (x.d - 1)]
"""


@query
def op13_nn_descent(spark, d):
    return nn_descent.nearest_neighbours(table(spark, d, "embeddings"))
