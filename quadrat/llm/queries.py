"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_pieces import decode, encode

    model = tokenizer("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs, model, dropout=0.1, seed=1), model)
    return back.select("doc_id", "n_tokens", "ids", F.expr("decoded <=> text").alias("lossless"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, times=100, by=85)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import KINDS, find, joined

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    numbers = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *numbers, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


#: Fixed values of the rules: verdict, host, path.
RULES = [("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge

    return judge(table(spark, sf_dir, "pages"), RULES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses", "n_templates", "dice")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("repeats"), "text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, longest=3, least_words=20, share=(5, 100), seed=42)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_templates import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import find_runs, made_periodic

    found = find_runs(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")), times=4, least=6)
    best = F.expr("aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (b, x) -> if(b IS NULL OR x.length * b.period > b.length * x.period, x, b))")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    own = found.withColumn("best", best).withColumn("lines", lines)
    parts = [F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return own.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *parts, milli, F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_sentence_pieces, op2_near_duplicates, op3_personal_data, op4_url_filter, op5_language_id, op6_cover_tree, op7_token_counts, op8_winnowing, op9_license_scan, op10_sentence_spans, op11_importance_resampling, op12_main_text, op13_periodic_runs)}


def _templates_sql() -> str:
    from .licenses import TEMPLATES

    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES)


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_importance_resampling": f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT 0 AS rid, {_WORDS} AS w FROM benchmark),
x AS MATERIALIZED (SELECT rid, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT rid, w FROM d UNION ALL SELECT rid, w FROM b), (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
u AS MATERIALIZED (SELECT g, row_number() OVER () AS fid FROM (SELECT DISTINCT g FROM x)),
c(fid, h, c) AS (SELECT fid, hex(encode(g)), 4294967295 FROM u UNION ALL
  SELECT fid, h[3:], xor(c >> 8, v) FROM c JOIN t ON t.i = xor(c, 16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1) & 255 WHERE h <> ''),
k AS MATERIALIZED (SELECT g, xor(c, 4294967295) % 10000 AS bucket FROM c JOIN u USING (fid) WHERE h = ''),
f AS MATERIALIZED (SELECT rid, bucket FROM x JOIN k USING (g)),
n AS (SELECT bucket, count(*) FILTER (rid > 0) AS s, count(*) FILTER (rid = 0) AS t FROM f GROUP BY bucket),
q AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN q USING (bucket) WHERE rid > 0 GROUP BY rid),
z AS (SELECT doc_id, len(w) >= 20 AS long_, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_transform(string_split(sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8], ''), lambda y: instr('0123456789abcdef', y) - 1), lambda p, y: 16 * p + y)::DOUBLE AS h FROM d LEFT JOIN m USING (rid)),
y AS (SELECT doc_id, long_, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN long_ AND r <= 5 * n // 100 THEN r END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY long_ ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY long_) AS n FROM y)
""",
    "op12_main_text": """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(h1|p)>'), lambda y: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(y, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS t FROM a)
SELECT page_id, url, array_to_string(list_filter(t, lambda y: y <> ''), chr(10)) AS text, len(array_to_string(list_filter(t, lambda y: y <> ''), chr(10))) AS n_chars FROM b
""",
    "op4_url_filter": f"""
WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS whole FROM pages),
q AS (SELECT page_id, html, split_part(whole, '#', 1) AS rest FROM p),
h AS (SELECT page_id, html, {_LOWER.format("split_part(split_part(rest, '?', 1), '/', 1)")} AS host, substr(split_part(rest, '?', 1), len(split_part(split_part(rest, '?', 1), '/', 1)) + 1) AS path,
  substr(rest, len(split_part(rest, '?', 1)) + 1) AS query FROM q),
tag AS (SELECT page_id, t, replace(replace(lower(t), '"', ' '), chr(39), ' ') AS flat FROM (SELECT page_id, split_part(unnest(string_split(html, '<')[2:]), '>', 1) AS t FROM h)),
link AS (SELECT page_id, trim(split_part(split_part(replace(t, chr(39), '"'), CASE WHEN starts_with(flat, 'link ') THEN 'href="' ELSE 'url=' END, 2), '"', 1)) AS x FROM tag
  WHERE (starts_with(flat, 'link ') AND list_contains(string_split(flat, ' '), 'canonical')) OR (starts_with(flat, 'meta ') AND list_contains(string_split(flat, ' '), 'refresh'))),
full_ AS (SELECT page_id, split_part(CASE WHEN instr(x, '://') > 0 THEN substr(x, instr(x, '://') + 3) WHEN starts_with(x, '//') THEN substr(x, 3) ELSE host || CASE WHEN starts_with(x, '/') THEN x ELSE regexp_replace(path, '[^/]*$', '') || x END END, '#', 1) AS rest
  FROM link JOIN h USING (page_id) WHERE x <> ''),
a AS (SELECT page_id, host, path, query FROM h UNION ALL
  SELECT page_id, {_LOWER.format("split_part(split_part(rest, '?', 1), '/', 1)")}, substr(split_part(rest, '?', 1), len(split_part(split_part(rest, '?', 1), '/', 1)) + 1), substr(rest, len(split_part(rest, '?', 1)) + 1) FROM full_),
n AS (SELECT DISTINCT page_id, host, path, host || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '?' THEN '' ELSE query END AS name FROM a WHERE host <> ''),
e AS (SELECT DISTINCT x.page_id AS a, y.page_id AS b FROM n x JOIN n y USING (name)),
r(a, b) AS (SELECT page_id, page_id FROM h UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS page_id, min(b) AS component FROM r GROUP BY a),
u(verdict, rh, rp) AS (VALUES {", ".join(f"('{v}', '{x}', '/{y}')" for v, x, y in RULES)}),
d AS (SELECT page_id, arg_max(rh || rp, len(rh) + len(rp)) AS rule, arg_max(u.verdict, len(rh) + len(rp)) AS verdict FROM h JOIN u ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
v AS (SELECT page_id, name, arg_max(u.verdict, len(rh) + len(rp)) AS verdict FROM n JOIN u ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, name),
g AS (SELECT component, min(verdict) AS verdict FROM c JOIN v USING (page_id) GROUP BY component)
SELECT h.page_id, host, path, d.rule, coalesce(d.verdict, g.verdict, 'allow') AS verdict, c.component
FROM h JOIN c USING (page_id) LEFT JOIN d USING (page_id) LEFT JOIN g USING (component)
""",
    "op6_cover_tree": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = vec_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = vec_id
""",
    "op8_winnowing": f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM (SELECT *, least(13, len(w)) AS k FROM iw WHERE len(w) > 0))),
dg AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT rid, i, k, item_id FROM dg JOIN win USING (k, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
""",
    "op9_license_scan": f"""
WITH tw AS (SELECT row_number() OVER () AS tid, name, regexp_extract_all({_LOWER.format("text")}, '[a-z0-9]+') AS w FROM (VALUES {_templates_sql()}) v(name, text)),
tp AS (SELECT tid, name, len(w) AS n_words, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM tw),
t AS (SELECT *, ceil(80 * len(b) / 120.0)::INT AS shared, least(ceil(80 * len(b) / 120.0)::INT, greatest(1, len(b) // 4)) AS least_ FROM (SELECT *, list_distinct(p) AS b FROM tp)),
ta AS (SELECT tid, g FROM (SELECT tid, g, row_number() OVER (PARTITION BY tid ORDER BY len(g) DESC, g) AS k, len(b) - shared + least_ AS most FROM (SELECT tid, b, shared, least_, unnest(b) AS g FROM t)) WHERE k <= most),
an AS (SELECT tid, g, unnest(list_filter(range(1, len(p) + 1), lambda i: p[i] = g)) AS q FROM ta JOIN t USING (tid)),
d AS (SELECT rid, doc_id, x, regexp_extract_all({_LOWER.format("x")}, '[a-z0-9]+') AS w FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents)),
dp AS (SELECT rid, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT rid, tid, list_distinct(list(i - q)) AS lays FROM dp JOIN an USING (g) JOIN t USING (tid) GROUP BY rid, tid HAVING count(DISTINCT g) >= any_value(least_)),
u AS (SELECT rid, w FROM (SELECT rid, regexp_extract_all({_LOWER.format("unit")}, '[a-z0-9]+') AS w FROM
  (SELECT rid, unnest(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\\n[ \\t\\r]*\\n'), [x])) AS unit FROM d WHERE rid IN (SELECT rid FROM h))) WHERE len(w) > 1),
ps AS (SELECT rid, tid, NULL AS l, list_distinct(list_transform(range(1, len(u.w)), lambda i: u.w[i] || ' ' || u.w[i + 1])) AS s FROM u JOIN h USING (rid)
  UNION ALL SELECT rid, tid, l, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) FROM
  (SELECT rid, tid, l, w[greatest(l, 0) + 1:l + n_words] AS v FROM (SELECT rid, tid, unnest(lays) AS l FROM h) JOIN d USING (rid) JOIN t USING (tid))),
pc AS (SELECT rid, tid, name, n_words, len(b) AS nb, l, c, 200 * c // n AS dice FROM (SELECT rid, tid, name, n_words, b, l, len(list_intersect(s, b)) AS c, len(s) + len(b) AS n FROM ps JOIN t USING (tid))),
wn AS (SELECT rid, tid, l AS place FROM pc WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid, tid ORDER BY dice DESC, c DESC, l) = 1),
ms AS (SELECT rid, tid, name, n_words, nb, place, max(dice) AS dice, arg_max(c, dice * 100000 + c) AS c FROM pc JOIN wn USING (rid, tid) GROUP BY ALL HAVING max(dice) >= 80),
m AS (SELECT * FROM ms x WHERE NOT EXISTS (SELECT 1 FROM ms y WHERE y.rid = x.rid AND 2 * y.c - y.nb > 2 * x.c - x.nb AND y.place < x.place + x.n_words AND x.place < y.place + y.n_words)),
g AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_templates, max(dice)::BIGINT AS dice FROM m GROUP BY rid)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_templates, 0) AS n_templates, coalesce(dice, 0) AS dice
FROM d LEFT JOIN g USING (rid)
""",
    "op2_near_duplicates": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
""",
}
