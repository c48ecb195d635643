"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from .common import table
from .exact_dedup import op3_tree_merge
from .filter_audit import FILTERS, op12_audit
from .jaccard_join import op10_universe_partition
from .language_id import op5_naive_bayes
from .line_dedup import op7_line_chunks
from .packing import op2_bin_slack, special_tokens
from .quality_rules import RULES, STOP_WORDS, op6_rules
from .scaled_sketch import op11_sketches
from .secret_scan import RULES as SECRET_RULES
from .secret_scan import op9_trigram_index
from .sentencepiece_bpe import op4_merge_dropout
from .sharding import op1_hilbert
from .token_alignment import op13_alignment
from .toxicity import op8_convolution


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_sharding(spark, sf_dir):
    return op1_hilbert(table(spark, sf_dir, "documents"))


def op2_minimum_bin_slack(spark, sf_dir):
    return op2_bin_slack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), special_tokens(tokenizer_path("byte_bpe_50k.json")))


def op3_digest_tree_merge(spark, sf_dir):
    return op3_tree_merge(table(spark, sf_dir, "documents"))


def op5_language_naive_bayes(spark, sf_dir):
    return op5_naive_bayes(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return op6_rules(table(spark, sf_dir, "documents"))


def op8_toxicity_convolution(spark, sf_dir):
    return op8_convolution(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_trigram_index(spark, sf_dir):
    return op9_trigram_index(table(spark, sf_dir, "documents"))


def op10_universe_partition_join(spark, sf_dir):
    return op10_universe_partition(table(spark, sf_dir, "documents"))


def op7_line_chunk_dedup(spark, sf_dir):
    return op7_line_chunks(table(spark, sf_dir, "documents"))


def op4_sentencepiece_merge_dropout(spark, sf_dir):
    return op4_merge_dropout(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_scaled_sketch(spark, sf_dir):
    return op11_sketches(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return op12_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark, sf_dir):
    return op13_alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""



def _op6_sql() -> str:
    checks = []
    for name, measure, per, least, most in RULES:
        parts = [f"1000 * {measure} >= {least} * {per}"] * (least is not None) + [f"1000 * {measure} <= {most} * {per}"] * (most is not None)
        checks.append(f"{' AND '.join(parts)} AS rule_{name}")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, unnest(generate_series(1, len(words) - 2)) AS i, words FROM t),
w AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM w, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
    len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullet_lines,
    len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
    len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper_words,
    len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words
  FROM t LEFT JOIN p USING (r)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(checks)} FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"rule_{r[0]}" for r in RULES)} AS kept, {", ".join(f"rule_{r[0]}" for r in RULES)} FROM c
"""


def secrets_sql(source: str) -> str:
    """Common table expressions ending in `secrets` (r, doc_id, t, k, kind, s, e) and `rows` (r, doc_id, t) over a table with doc_id and text."""
    parts = []
    for k, rule in enumerate(SECRET_RULES):
        regex = rule.regex.replace("'", "''")
        parts.append(f"""
  SELECT r, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, '{regex}', 0) AS w, regexp_extract_all(t, '{regex}', {rule.group}) AS m,
    string_split_regex(t, '{regex}') AS b, {rule.least} AS least FROM rows WHERE regexp_matches(t, '{regex}')""")
    return f"""
rows AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM {source}),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT r, k, kind, w, b, m, least, unnest(generate_series(1, len(w))) AS i FROM found),
sized AS (SELECT r, k, kind, i, length(b[i]) AS skip, length(w[i]) AS n, length(m[i]) >= least AS ok FROM each),
placed AS (SELECT *, sum(skip + n) OVER (PARTITION BY r, k ORDER BY i) AS e FROM sized),
secrets AS (SELECT r, k, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE ok)"""


OP9_SQL = f"""
WITH {secrets_sql("documents")},
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM secrets GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM rows LEFT JOIN g USING (r)
"""

def _op12_sql() -> str:
    places = range(len(FILTERS))
    letters = f"(SELECT unnest(list_value({', '.join(repr(f) for f in FILTERS)})) AS l)"
    order, apart = " || ".join(f"x{i}.l" for i in places), " AND ".join(f"x{i}.l <> x{j}.l" for i in places for j in range(i))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS m
  FROM t),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT {order} AS filter_order FROM {", ".join(f"{letters} x{i}" for i in places)} WHERE {apart}),
s AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, CAST(i AS INTEGER), 1)) - 65))), 0) AS earlier
  FROM (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN m & (CAST(earlier AS BIGINT) | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & CAST(earlier AS BIGINT) = 0 AND m & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & CAST(earlier AS BIGINT) > 0 AND m & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & CAST(earlier AS BIGINT) = 0 AND m & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & CAST(earlier AS BIGINT) = 0 AND m & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


QUERIES = {f.__name__: f for f in (op1_hilbert_sharding, op2_minimum_bin_slack, op3_digest_tree_merge, op5_language_naive_bayes, op6_quality_rules, op8_toxicity_convolution, op9_secret_trigram_index, op10_universe_partition_join, op7_line_chunk_dedup, op4_sentencepiece_merge_dropout, op11_scaled_sketch, op12_filter_audit, op13_token_alignment)}
ORACLES = {"op3_digest_tree_merge": OP3_SQL, "op6_quality_rules": _op6_sql(), "op9_secret_trigram_index": OP9_SQL, "op12_filter_audit": _op12_sql()}
