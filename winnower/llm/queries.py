"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import chat_format, collocations, decontaminate, importance, language_id, language_model, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, toxicity
from winnower.llm.shared import crc_remainder, read


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, :t AS text UNION ALL SELECT -7L, 1L, 'assistant', :t", args={"t": probe})
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_conversations(turns)
    made = made.withColumns({"turns": chat_format.parse(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))})
    back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(back, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, CASE WHEN contains(text, '\\') OR contains(text, '\e') OR contains(text, '### ') OR contains(text, '</turn>')
    THEN replace(replace(replace(text, '\', '\\'), '### ', '#\e## '), '</turn>', '<\e/turn>') ELSE text END AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(shown) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _scored(spark: SparkSession, sf_dir: str, model, threshold: float) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = model.score(docs, model.train(docs, read(spark, sf_dir, "labels")), threshold=threshold)
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality_model, 0.3)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A public key, for demonstration: real use takes its own from the caller.
    return pii.hide_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), pii.Pseudonyms(key=b"demonstration"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang"), crc_remainder("doc_id", 3) != 1)
    out = language_id.detect(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.col("quality")
    weights = read(spark, sf_dir, "labels").select("doc_id", F.when(quality == 1, 2.0).when(quality == 0, 0.5).otherwise(1.0).alias("weight"))
    return mixing.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE) AS weight FROM labels GROUP BY doc_id),
k AS (SELECT d.*, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0) / coalesce(weight, 1.0) AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, 3.0 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS n FROM s),
f(n, level) AS (
  SELECT 0::BIGINT, (SELECT sum(source_size) FROM c) / (SELECT sum(weight) FROM c)::DOUBLE
  UNION ALL SELECT f.n + 1, ((SELECT sum(source_size) FROM c) - (SELECT sum(cap) FROM c WHERE c.n <= f.n + 1)) / (SELECT sum(weight) FROM c WHERE c.n > f.n + 1)
  FROM f WHERE EXISTS (SELECT 1 FROM c WHERE c.n = f.n + 1 AND c.cap <= c.weight * f.level) AND EXISTS (SELECT 1 FROM c WHERE c.n > f.n + 1)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM f ORDER BY n DESC LIMIT 1)) AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, round(target, 6) AS target, source, (size * copies)::BIGINT AS taken, copies
FROM (SELECT k.*, source_size, target, (epochs + CASE WHEN sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


OP6_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
v AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM h) GROUP BY r),
m AS (
  SELECT r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[\x00-@\[-`{-\x7F]+', '', 'g'))::BIGINT AS n_letters, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN v USING (r)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_length, coalesce(n_letters * 1000 // nullif(word_chars, 0), 0) AS letters, coalesce(n_symbols * 1000 // nullif(n_words, 0), 0) AS symbols,
    coalesce(n_dup_lines * 1000 // nullif(n_words, 0), 0) AS dup_lines, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats FROM m),
u AS (
  SELECT lang, source, measure, CASE WHEN v < 512 THEN v ELSE (v >> (length(bin(v)) - 9)::BIGINT) << (length(bin(v)) - 9)::BIGINT END AS x
  FROM (UNPIVOT (SELECT lang, source, word_length, letters, symbols, dup_lines, repeats FROM b WHERE NOT base_failed) ON word_length, letters, symbols, dup_lines, repeats INTO NAME measure VALUE v)),
cc AS (SELECT lang, source, measure, CASE WHEN x > 0 OR 2 * count(*) FILTER (WHERE x = 0) OVER (PARTITION BY measure) <= count(*) OVER (PARTITION BY measure) THEN x END AS x FROM u),
qa AS (SELECT measure, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM cc GROUP BY ALL),
qg AS (
  SELECT cc.lang, cc.measure, coalesce((quantile_disc(x, 0.25) * count(x) + any_value(qa.q1) * 50) // (count(x) + 50), any_value(qa.q1)) AS q1, coalesce((quantile_disc(x, 0.75) * count(x) + any_value(qa.q3) * 50) // (count(x) + 50), any_value(qa.q3)) AS q3
  FROM cc JOIN qa USING (measure) GROUP BY cc.lang, cc.measure),
qo AS (
  SELECT cc.lang, cc.source, cc.measure, coalesce((quantile_disc(x, 0.25) * count(x) + any_value(qg.q1) * 50) // (count(x) + 50), any_value(qg.q1)) AS q1, coalesce((quantile_disc(x, 0.75) * count(x) + any_value(qg.q3) * 50) // (count(x) + 50), any_value(qg.q3)) AS q3
  FROM cc JOIN qg ON cc.measure = qg.measure AND cc.lang IS NOT DISTINCT FROM qg.lang GROUP BY cc.lang, cc.source, cc.measure),
ql AS (SELECT lang, source, measure, q1 - 5 * greatest(q3 - q1, q3 // 256, 1) AS lo, q3 + 5 * greatest(q3 - q1, q3 // 256, 1) AS hi FROM qo),
mj AS (UNPIVOT (SELECT r, lang, source, word_length, letters, symbols, dup_lines, repeats FROM b WHERE NOT base_failed) ON word_length, letters, symbols, dup_lines, repeats INTO NAME measure VALUE v),
mk AS (SELECT r, bool_and(coalesce(v BETWEEN lo AND hi, true)) AS fine FROM mj JOIN ql ON mj.measure = ql.measure AND mj.lang IS NOT DISTINCT FROM ql.lang AND mj.source IS NOT DISTINCT FROM ql.source GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM b LEFT JOIN mk USING (r)
"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), near_dedup.NearDuplicates(percent=85))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT * FROM (SELECT doc_id, i, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l) WHERE n > 0),
p AS (
  SELECT * FROM (SELECT doc_id, i AS b, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM w) WHERE e IS NOT NULL
  UNION ALL SELECT doc_id, i, i FROM w WHERE n >= 50),
c AS (SELECT doc_id, b, e, array_to_string(string_split(text, chr(10))[b:e], chr(10)) AS chunk FROM p JOIN documents USING (doc_id)),
r AS (SELECT doc_id, b, e FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, b) AS k FROM c) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS i FROM r),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(g.i) AS n_removed FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, o.text, coalesce(o.n_removed, 0)::BIGINT AS n_removed, coalesce(length(d.text) - length(o.text), 0)::BIGINT AS removed_chars FROM documents d LEFT JOIN o USING (doc_id)
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, 0.5)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS k FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.k + q.k - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.m)
SELECT n.doc_id, n.k::BIGINT AS n_shingles, min(r.m) AS component_id, n.doc_id = min(r.m) AS kept
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.k
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {_LOWER} AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k))),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k, unnest(range(1, k)) AS j FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, string_split(phrase, ' ') AS w, k, f, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))


_CRC_TABLE = "SELECT list(list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"
#: crc32 of the bytes whose hexadecimal digits are x.
_CRC = "xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"

OP12_SQL = rf"""
WITH tab AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sd AS (SELECT r, unnest(ws) AS w FROM d), tq AS (SELECT unnest(ws) AS w FROM q),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM sd UNION SELECT w FROM tq)),
k AS (SELECT w, {_CRC} % 10000 AS b FROM v, tab),
s AS (SELECT b, count(*) AS s FROM sd JOIN k USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM tq JOIN k USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM sd) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tq) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM sd JOIN k USING (w) JOIN g USING (b) GROUP BY r),
o AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
y AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM x WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM y
"""


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), crc_remainder("doc_id", 7) == 2)


OP13_SQL = rf"""
WITH tab AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held_out, ['  '] || regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') || [' '] AS ws
  FROM (SELECT doc_id, text, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS x FROM documents), tab),
g AS (SELECT r, held_out, ws[j] AS w, ws[j - 1] AS v, CASE WHEN j > 2 THEN ws[j - 2] END AS u FROM (SELECT *, unnest(range(2, len(ws) + 1)) AS j FROM d)),
c1 AS (SELECT w, count(*) AS c1 FROM g WHERE NOT held_out GROUP BY ALL), c2 AS (SELECT v, w, count(*) AS c2 FROM g WHERE NOT held_out GROUP BY ALL), c3 AS (SELECT u, v, w, count(*) AS c3 FROM g WHERE NOT held_out AND u IS NOT NULL GROUP BY ALL),
n AS (SELECT coalesce(sum(c1), 0)::BIGINT AS n, count(*) AS v, (SELECT count(*) FROM d WHERE NOT held_out) AS texts FROM c1),
k AS (SELECT g.r, coalesce(c1.c1, 0) AS c1, coalesce(c2.c2, 0) AS c2, coalesce(c3.c3, 0) AS c3, CASE WHEN g.v = '  ' THEN n.texts ELSE coalesce(x.c1, 0) END AS h2, coalesce(y.c2, 0) AS h3, (coalesce(c1.c1, 0) + 1) / (n.n + n.v + 1)::DOUBLE AS p1
  FROM g CROSS JOIN n LEFT JOIN c1 ON c1.w = g.w LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w LEFT JOIN c1 x ON x.w = g.v LEFT JOIN c2 y ON y.v = g.u AND y.w = g.v),
p AS (SELECT *, CASE WHEN h2 >= 1 THEN (c2 + 500 * p1) / (h2 + 500) ELSE p1 END AS p2 FROM k),
s AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE c1 > 0) AS n_known, sum(log10(p1)) AS base_score, sum(log10(CASE WHEN h3 >= 8 THEN (c3 + 16 * p2) / (h3 + 16) ELSE p2 END)) AS score FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM n) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN s USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_SQL = {"op1_chat_format": OP1_SQL, "op5_mix_sources": OP5_SQL, "op6_quality_rules": OP6_SQL, "op7_line_dedup": OP7_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_language_model": OP13_SQL}


def queries() -> dict:
    ops = (
        op1_chat_format, op2_quality_classifier, op3_pseudonyms, op4_language_id, op5_mix_sources,
        op6_quality_rules, op7_line_dedup, op8_decontaminate, op9_toxicity, op10_minhash_near_dedup,
        op11_collocations, op12_importance_resampling, op13_language_model, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
