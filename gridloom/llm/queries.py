"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, context_tree, decontaminate, html_text, language_id, merkle, pii, quality_rules, secrets, simhash, spelling, toxicity
from .common import remainder, table

#: Where the vocabulary of op6 lies, which is the path that the tokenizers' package names.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "kept", "host_verdict")


ORACLE["op1_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
q AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' ||
             lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o || ' ' || lead(x, 6) OVER o || ' ' || lead(x, 7) OVER o AS win
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM q WHERE win IS NOT NULL),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM r WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, i - coalesce(j, -8))) AS n FROM s GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             100 * n_symbols > 30 * word_chars OR 100 * n_dup_lines > 20 * n_words AS loose,
             100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 5 * n_words AS tight FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR loose) AS f FROM b GROUP BY host),
g AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v, sum(n) AS n FROM h),
k AS (SELECT m, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(0.0, m * (1 - m) / v - 1) ELSE n END AS s FROM g),
v AS (SELECT host, (f + m * s) / (n + s) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR CASE WHEN rate >= 0.9 THEN true WHEN rate >= 0.5 THEN tight ELSE loose END) AS kept,
       CASE WHEN rate >= 0.9 THEN 'blocked' WHEN rate >= 0.5 THEN 'watch' ELSE 'trusted' END AS host_verdict
FROM b JOIN v USING (host)
"""


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("__text")
    return decontaminate.verdicts(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE["op10_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x
      FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM i),
g AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, k WHERE len(w) >= k)),
h AS (SELECT g.doc_id, g.s, g.k, i.item_id FROM g JOIN i ON g.k = i.k AND g.x = i.x),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, keep=["doc_id"], with_ids=False, with_decoded=False)


@query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), rest > 0)
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", (rest == 0).alias("held_out"), "score", "predicted")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), remainder("doc_id", 4)
    model = language_id.train(docs, (rest >= 0) & (rest != 2))
    found = language_id.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    return chat_format.format_chats(chats).select("conv_id", "turn", "role", "role_found", "n_turns", "rendered")


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 10)
    model = context_tree.train(docs, rest > 0)
    found = context_tree.score(docs, model, keep=["doc_id"])
    n = F.lit(model.train_tokens).cast("bigint").alias("train_tokens")
    return found.select("doc_id", (rest == 0).alias("held_out"), "n_tokens", "n_known", n, "base_score", "score", "bits_per_byte")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, changed)


# crc32 of an expression's bytes: every byte is folded in, then eight shifts (-1).
_SQL_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(hex(encode({0})), ''),
    lambda x, i: CASE WHEN i % 2 = 1 THEN []::BIGINT[] ELSE [{1}, -1, -1, -1, -1, -1, -1, -1, -1] END))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""


def _sql_crc(text: str) -> str:
    return _SQL_CRC.format(text, f"(instr('0123456789ABCDEF', hex(encode({text}))[i - 1]) * 16 + instr('0123456789ABCDEF', x) - 17)::BIGINT")


_SQL_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_SQL_LEAF.format(text="text")} AS leaf,
         CASE WHEN {_sql_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_SQL_LEAF.format(text="replace(text, chr(10), '')")} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
nodes(source, lvl, pos, n, h) AS (
  SELECT coalesce('=' || source, ''), 0, pos, n, leaf FROM l
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (
  SELECT source, lvl, pos, n, string_agg(h, '' ORDER BY pos) OVER before AS a, string_agg(h, '' ORDER BY pos) OVER after AS b FROM nodes WHERE n > 1
  WINDOW before AS (PARTITION BY source, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY source, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
usteps AS (
  SELECT lvl, pos, n, string_agg(h, '' ORDER BY pos) OVER before AS a, string_agg(h, '' ORDER BY pos) OVER after AS b FROM upper WHERE n > 1
  WINDOW before AS (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walk(doc_id, leaf, source, lvl, pos, n, h, proof) AS (
  SELECT doc_id, leaf, coalesce('=' || source, ''), 0, pos, n, coalesce(changed, leaf), '' FROM l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.source, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, sha256(coalesce(t.a, '') || w.h || coalesce(t.b, '')), w.proof || coalesce(t.a, '') || coalesce(t.b, '')
  FROM walk w JOIN steps t ON w.source = t.source AND w.lvl = t.lvl AND w.pos = t.pos WHERE w.n > 1),
uwalk(doc_id, leaf, subroot, lvl, pos, n, h, proof) AS (
  SELECT w.doc_id, w.leaf, s.subroot, 0, s.pos, s.n, w.h, w.proof FROM walk w JOIN s USING (source) WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.pos // 3, (w.n + 2) // 3, sha256(coalesce(t.a, '') || w.h || coalesce(t.b, '')), w.proof || coalesce(t.a, '') || coalesce(t.b, '')
  FROM uwalk w JOIN usteps t ON w.lvl = t.lvl AND w.pos = t.pos WHERE w.n > 1),
r AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM uwalk, r WHERE n = 1
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLE["op13_spelling_variants"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
c AS (SELECT doc_id, r, count(*) AS n FROM t WHERE length(r) >= 7 GROUP BY ALL),
h AS (SELECT r, n, {_sql_crc("(coalesce(doc_id::VARCHAR, '') || ':' || r)")} AS h FROM c),
w AS (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
y AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM x),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM y a JOIN y b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
      UNION SELECT y.word, w.word, w.n FROM y JOIN w ON y.rest = w.word
      UNION SELECT w.word, y.word, y.n FROM y JOIN w ON y.rest = w.word),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -other_n, b := other)) AS s FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -s.a >= 10 * w.n THEN s.b END AS form, CASE WHEN -s.a >= 10 * w.n THEN -s.a END AS form_n FROM w LEFT JOIN b USING (word)),
g(word, last, form) AS (SELECT word, word, form FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.form = f.word WHERE g.form IS NOT NULL)
SELECT f.word, f.form, g.last AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON f.word = g.word WHERE g.form IS NULL
"""
