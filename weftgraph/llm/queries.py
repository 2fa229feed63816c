"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import fingerprint, language, mixing, neardup, packing, quality, secrets, sharding, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDupParameters(shingle_words=2))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~F.coalesce(language.held_out(), F.lit(False))))
    held = docs.select("doc_id", "text")
    return language.identify(held, model).select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_document_fingerprints, op3_minhash_near_dedup, op4_sharding, op5_language_id,
        op6_mix_sources, op7_warc_derivatives, op8_packing, op9_secret_scans, op10_substring_dedup,
    )
}

#: Words of a text t as SQL: runs of characters other than ASCII white space.
WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"

_RULES = quality.LineRules()
_QUOTE = lambda x: "'" + x.replace("'", "''") + "'"
_NAV = ", ".join(map(_QUOTE, _RULES.nav_words))
_PHRASES = " OR ".join(f"contains(low, {_QUOTE(x)})" for x in _RULES.boilerplate)

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(t="text")} AS w FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
lines AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
marks AS (SELECT *, lower(bare) AS low, {WORDS.format(t="lower(bare)")} AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth,
    length(regexp_replace(bare, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    length(bare) - length(regexp_replace(bare, '[!-/:-@\[-`{{-~]', '', 'g')) AS punct,
    length(bare) - length(regexp_replace(bare, '[|»›•·>]', '', 'g')) AS seps FROM lines),
named AS (SELECT *, len(list_filter(lw, lambda x: trim(x, '.,:;!?()[]') IN ({_NAV}))) AS navs FROM marks),
failed AS (SELECT *, CASE WHEN NOT (contains({_QUOTE(_RULES.terminal)}, right(bare, 1)) OR (len(lw) >= {_RULES.paragraph_words} AND regexp_matches(bare, '[.!?] '))) OR punct > {_RULES.max_punctuation} * chars THEN 'p'
    WHEN seps >= {_RULES.max_separators} OR (len(lw) <= {_RULES.nav_line_words} AND navs > 0 AND 2 * navs >= len(lw)) THEN 'n'
    WHEN {_PHRASES} THEN 'b' END AS why FROM named),
bad AS (SELECT doc_id, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS dup, sum(CASE WHEN why IS NOT NULL THEN chars ELSE 0 END) AS lost,
    count(*) FILTER (why = 'p') AS p, count(*) FILTER (why = 'n') AS n, count(*) FILTER (why = 'b') AS b FROM failed GROUP BY doc_id),
win AS (SELECT doc_id, len(w) AS nw, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM many, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(lost, 0) AS lost_chars, coalesce(p, 0) AS n_punctuation, coalesce(bad.n, 0) AS n_navigation, coalesce(b, 0) AS n_boilerplate
    FROM d LEFT JOIN bad USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= {_RULES.max_lost} * word_chars) AS kept,
    lost_chars::BIGINT AS lost_chars, n_punctuation::BIGINT AS n_punctuation, n_navigation::BIGINT AS n_navigation, n_boilerplate::BIGINT AS n_boilerplate FROM base
"""

_SKETCH = """
{n}_w AS (SELECT doc_id, {words} AS w FROM e),
{n}_s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM {n}_w),
{n}_h AS (SELECT doc_id, len(s) AS n, list_sort(list_distinct(list_transform(s, lambda x: md5(x)[1:16]))) AS h FROM {n}_s),
{n}_k AS (SELECT doc_id, n, h[1 : greatest(64, len(list_filter(h, lambda x: x < '2')))] AS h FROM {n}_h),
{n} AS (SELECT doc_id, n, h, CASE WHEN len(h) = n THEN 'g' ELSE greatest(list_last(h), '2') END AS upto FROM {n}_k)"""

_LIKE = """CASE WHEN {a}.n = 0 OR {b}.n = 0 THEN ({a}.n = {b}.n)::INT ELSE coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif(least(len({x}), len({y})), 0), 0) END::DOUBLE"""


def _like(a: str, b: str) -> str:
    """SQL for the likeness of two sketches, of the hashes up to the lower of their bounds."""
    part = f"list_filter({{}}.h, lambda x: x <= least({a}.upto, {b}.upto))"
    return _LIKE.format(a=a, b=b, x=part.format(a), y=part.format(b))


OP2 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nxt, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS nxt_id FROM t WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT *, left(text, n_chars - n_chars // 4) || left(nxt, n_chars // 4) AS edited FROM f),
{_SKETCH.format(n="a", words=WORDS.format(t="text"))},
{_SKETCH.format(n="b", words=WORDS.format(t="edited"))}
SELECT e.doc_id, n_chars::BIGINT AS n_chars, a.n::BIGINT AS n_shingles, sha256(edited) AS edited_sha256,
    a.n || ':' || array_to_string(a.h, '') AS fingerprint, b.n || ':' || array_to_string(b.h, '') AS edited_fingerprint,
    {_like("a", "b")} AS near_edited,
    {_like("a", "c")} AS near_next
FROM e JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN a AS c ON c.doc_id = e.nxt_id
"""

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
cls AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
sh AS (SELECT id, n, unnest(s) AS x FROM cls),
pairs AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM sh a JOIN sh b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, c) AS (SELECT id, id FROM cls UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.id WHERE r.c < e.b),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.c, s.doc_id)::BIGINT AS component_id, (s.doc_id = coalesce(comp.c, s.doc_id)) AS kept
FROM s LEFT JOIN cls ON list_sort(s.s) = cls.s LEFT JOIN comp USING (id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(0, 35) AS o(k)),
g AS (SELECT doc_id, list(i) AS pos, count(*) AS n FROM gone GROUP BY doc_id),
wd AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM wd ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_quality_rules": OP1, "op2_document_fingerprints": OP2, "op3_minhash_near_dedup": OP3, "op10_substring_dedup": OP10}
