"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import licenses, merkle, minhash, mixing, packing, pii, quality, ranking, rpforest, secrets, substring, topk, warc
from textloom.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("ids")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


def op11_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS low FROM sets WHERE len(s) > 0)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(c.low, s.doc_id) AS kept, coalesce(k.low, s.doc_id) AS class_id
FROM sets s LEFT JOIN comp c USING (doc_id) LEFT JOIN classes k USING (doc_id)
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS owner FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND owner < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND owner < page_id THEN owner END AS refers_to
FROM o
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW r AS (ORDER BY full_at, encode(source) NULLS LAST)),
f AS (SELECT arg_min(level, row(full_at, source)) AS level FROM l WHERE level <= full_at),
t AS (SELECT l.source, l.source_size, CASE WHEN f.level IS NULL THEN l.cap ELSE least(l.cap, f.level * l.w) END AS target FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

_templates = ", ".join(
    "('{}', {})".format(label, "[" + ", ".join(f"'{w.decode()}'" for w in sorted(set(licenses.words_of(text.encode())))) + "]")
    for label, text in licenses.TEMPLATES.items()
)
_phrases = ", ".join(f"({[*p.split()]}, '{label}')" for p, label in licenses.PHRASES.items())
LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP8_SQL = rf"""
WITH t(label, tw) AS (VALUES {_templates}),
p(pw, label) AS (VALUES {_phrases}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{LICENSE_WORDS}') AS w FROM d),
hits AS (
  SELECT doc_id, p.label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p.pw) - 1] = p.pw)) - 1 AS pos
  FROM w, p WHERE contains(x, 'license')),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list_distinct(list(label))) AS labels FROM hits GROUP BY doc_id),
blocks AS (
  SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(x, chr(10)) || regexp_split_to_array(x, '\n[ \t\r]*\n')), '{LICENSE_WORDS}')) AS b FROM w),
more AS (
  SELECT doc_id, t.label, len(list_intersect(b, t.tw)) / len(t.tw) AS share FROM blocks, t
  WHERE len(b) >= 2 AND len(list_intersect(b, t.tw)) >= ceil({licenses.LEAST_CONTAINMENT} * len(t.tw) - 1e-9)),
found AS (SELECT doc_id, list(label) AS labels, max(share) AS share FROM more GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(found.labels, []))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(found.share, 0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM x),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS low FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM m WHERE low < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT a.doc_id, array_to_string(list(a.word ORDER BY a.i), ' ') AS kept FROM words a ANTI JOIN gone USING (doc_id, i) GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_near = " ".join(f"WHEN kind = {i} THEN regexp_matches(w, '(?:^|[^a-z])(?:{pii.NEAR[k]})(?:[^a-z]|$)')" for i, k in enumerate(pii.KINDS))
_points = " ".join(f"WHEN kind = {i} THEN {pii.POINTS[k]}" for i, k in enumerate(pii.KINDS))
_names = " ".join(f"WHEN kind = {i} THEN '{k}'" for i, k in enumerate(pii.KINDS))
_shapes = " ".join(f"WHEN regexp_matches(f, '{pii.SHAPES[k]}') THEN {pii.KINDS.index(k)}" for k in reversed(pii.SHAPES))
# Number of the kind and its pattern as the contract writes it (groups unnamed); 99: runs that may have an added shape.
_proposals = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 2: r"[0-9](?:[\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]", 4: pii.IBAN, 99: pii.RUN,
}

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
g AS MATERIALIZED (
{" UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_extract_all(t, '{rx}') AS m, regexp_split_to_array(t, '{rx}') AS b FROM d" for k, rx in _proposals.items())}),
u AS (SELECT rid, kind, unnest(m) AS f, unnest(b[:len(m)]) AS b, generate_subscripts(m, 1) AS i FROM g WHERE len(m) > 0),
e AS (SELECT rid, kind, f, CAST(sum(length(b) + length(f)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e FROM u),
c AS (SELECT rid, kind, f, e - length(f) AS s, e, regexp_replace(f, '[^0-9]', '', 'g') AS n, replace(f, ' ', '') AS v FROM e),
ok AS (
  SELECT rid, CASE WHEN kind < 99 THEN kind {_shapes} END AS kind, s, e - CASE WHEN kind = 99 AND ends_with(f, '.') THEN 1 ELSE 0 END AS e
  FROM c
  WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(f, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) > 0 AND CAST(left(ltrim(x, '0'), 3) AS INTEGER) > 255))) = 0
    WHEN 2 THEN length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(n)), lambda i: CASE
        WHEN i % 2 = 0 THEN CAST(n[length(n) - i] AS INTEGER) WHEN CAST(n[length(n) - i] AS INTEGER) > 4 THEN 2 * CAST(n[length(n) - i] AS INTEGER) - 9
        ELSE 2 * CAST(n[length(n) - i] AS INTEGER) END)) % 10 = 0
    WHEN 3 THEN length(n) BETWEEN 10 AND 15
    WHEN 4 THEN length(v) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(range(0, length(v)), lambda i: CAST(ascii(v[(i + 4) % length(v) + 1]) AS BIGINT))),
        lambda a, x: CASE WHEN x < 65 THEN (a * 10 + x - 48) % 97 ELSE (a * 100 + x - 55) % 97 END) = 1
    ELSE length(f) BETWEEN 6 AND 13 AND ({" OR ".join(f"regexp_matches(f, '{x}')" for x in pii.SHAPES.values())}) END),
spans AS (SELECT * FROM ok WHERE kind < 4 UNION ALL
  SELECT * FROM ok WHERE kind >= 4 AND NOT EXISTS (
    SELECT 1 FROM ok o WHERE o.rid = ok.rid AND o.kind < least(ok.kind, 5) AND (o.kind < 4 OR ok.kind > 4) AND o.s < ok.e AND ok.s < o.e)),
near AS (
  SELECT x.*, translate(substr(t, greatest(s - {pii.BEFORE}, 0) + 1, s - greatest(s - {pii.BEFORE}, 0)), '{UPPER}', '{LOWER}') AS before,
    translate(substr(t, e + 1, {pii.AFTER}), '{UPPER}', '{LOWER}') AS after FROM spans x JOIN d USING (rid)),
w AS (SELECT *, unnest([before, after]) AS w FROM near),
h AS (SELECT rid, kind, s, e, any_value(before) AS before, any_value(after) AS after, bool_or(CASE {_near} END) AS raised,
    bool_or(regexp_matches(w, '(?:^|[^a-z])(?:{pii.AGAINST})(?:[^a-z]|$)')) AS lowered FROM w GROUP BY rid, kind, s, e),
r AS (SELECT rid, kind, s, e, least(100, greatest(0, CASE {_points} END + CASE WHEN raised THEN {pii.RAISE} ELSE 0 END - CASE WHEN lowered THEN {pii.LOWER} ELSE 0 END)) AS score,
    regexp_matches(before, '[a-z0-9]$') OR regexp_matches(after, '^[a-z0-9]') AS loose FROM h),
f AS (SELECT *, CASE {_names} END || ':' || s || ':' || e AS x FROM r WHERE kind < 4 OR (score >= {pii.LEAST} AND NOT loose)),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < 4) AS base, string_agg(x, ',' ORDER BY s, kind, e) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, kind, e) AS scores
  FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (rid)
"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_enc = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))

# Per byte of the decimal doc_id eight steps of the reflected polynomial.
_crc = "x"
for _ in range(8):
    _crc = f"[CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END FOR y IN [{_crc}]][1]"

OP12_SQL = f"""
WITH RECURSIVE
l AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, sha256({_enc} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256({_enc} || coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) AS altered,
    doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: [{_crc} FOR x IN [xor(a, b)]][1]), 4294967295) % 3 = 0 AS tampered
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
up(lvl, lang, i, n, h) AS (
  SELECT 0, lang, i, n, leaf FROM p
  UNION ALL
  SELECT lvl + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lvl, lang, i // 8, n),
subs AS (SELECT lang, max(lvl) AS top, arg_max(h, lvl) AS subroot FROM up GROUP BY lang),
s0 AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, top, subroot FROM subs),
rt(lvl, i, n, h) AS (
  SELECT 0, i, n, subroot FROM s0
  UNION ALL
  SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM rt WHERE n > 1 GROUP BY lvl, i // 8, n),
root AS (SELECT arg_max(h, lvl) AS root FROM rt),
nodes AS (SELECT lvl, lang, i, n, h FROM up),
step(rid, lvl, lang, i, n, cur, sib) AS (
  SELECT rid, 0, lang, i, n, CASE WHEN tampered THEN altered ELSE leaf END, '' FROM p
  UNION ALL
  SELECT s.rid, s.lvl + 1, s.lang, s.i // 8, any_value((s.n + 7) // 8),
    sha256(string_agg(CASE WHEN u.i = s.i THEN s.cur ELSE u.h END, '' ORDER BY u.i)), any_value(s.sib) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> s.i), '')
  FROM step s JOIN nodes u ON u.lvl = s.lvl AND u.lang IS NOT DISTINCT FROM s.lang AND u.i // 8 = s.i // 8 WHERE s.n > 1 GROUP BY s.rid, s.lvl, s.lang, s.i),
own AS (SELECT rid, arg_max(cur, lvl) AS cur, arg_max(sib, lvl) AS sib, any_value(lang) AS lang FROM step GROUP BY rid),
fold(rid, lvl, i, n, cur, sib) AS (
  SELECT rid, 0, s0.i, s0.n, own.cur, own.sib FROM own JOIN s0 ON own.lang IS NOT DISTINCT FROM s0.lang
  UNION ALL
  SELECT s.rid, s.lvl + 1, s.i // 8, any_value((s.n + 7) // 8), sha256(string_agg(CASE WHEN u.i = s.i THEN s.cur ELSE u.h END, '' ORDER BY u.i)),
    any_value(s.sib) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> s.i), '')
  FROM fold s JOIN rt u ON u.lvl = s.lvl AND u.i // 8 = s.i // 8 WHERE s.n > 1 GROUP BY s.rid, s.lvl, s.i),
done AS (SELECT rid, arg_max(cur, lvl) AS folded_root, arg_max(sib, lvl) AS sib FROM fold GROUP BY rid)
SELECT p.doc_id, p.leaf, s0.subroot, root.root, sha256(done.sib) AS proof_sha256, done.folded_root, done.folded_root = root.root AS verified
FROM p JOIN done USING (rid) JOIN s0 ON p.lang IS NOT DISTINCT FROM s0.lang, root
"""

OP13_SQL = rf"""
WITH q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS r FROM q GROUP BY item_id, term),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
u AS (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM u SEMI JOIN qt USING (term) GROUP BY rid, doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, c),
s AS (SELECT item_id, rid, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM tf JOIN qt USING (term) JOIN w USING (term), c GROUP BY item_id, rid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_rp_forest_neighbours, op3_warc_round_trip, op4_concat_and_cut, op5_secret_scan,
        op6_kneser_ney_quality, op7_source_mix, op8_license_scan, op9_pivot_top_k, op10_substring_dedup, op11_pii_scan,
        op12_merkle_manifest, op13_ranked_search,
    )
}
# The others have no SQL form: a sampled index (2), a tokenizer (4), fitted models (5, 6).
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op3_warc_round_trip": OP3_SQL,
    "op7_source_mix": OP7_SQL,
    "op8_license_scan": OP8_SQL,
    "op9_pivot_top_k": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_pii_scan": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
