"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, conversations, decontaminate, langid, media, resample, secrets, shingles, simhash, statements, tokenfiles, toxicity, urlfilter, warc
from tidelog.llm.common import documents, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "benchmark"))


#: Every aligned window, found by three words on end that agree: any window of an item of ten words or more that
#: overlaps has such. The items of the tables have more.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), b AS (
  SELECT min(item_id) AS item_id, count(*) AS n_items, w
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) GROUP BY w
), dg AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([concat_ws(' ', w[k], w[k + 1], w[k + 2]) FOR k IN range(1, len(w) - 1)]) AS g FROM d
), bg AS (
  SELECT item_id, unnest(range(1, len(w) - 1)) AS i, unnest([concat_ws(' ', w[k], w[k + 1], w[k + 2]) FOR k IN range(1, len(w) - 1)]) AS g FROM b
), diagonal AS (
  SELECT DISTINCT doc_id, item_id, dg.i - bg.i AS shift FROM dg JOIN bg USING (g)
), win AS (
  SELECT doc_id, item_id, n_items, least(16, len(b.w)) AS compared, shift, d.w AS dw, b.w AS bw,
         unnest(range(0, len(b.w) - least(16, len(b.w)) + 1)) AS s
  FROM diagonal JOIN d USING (doc_id) JOIN b USING (item_id)
), counted AS (
  SELECT doc_id, item_id, n_items, compared, shift + s AS doc_pos,
         list_sum([CASE WHEN shift + s + j BETWEEN 1 AND len(dw) AND dw[shift + s + j] = bw[s + j] THEN 1 ELSE 0 END
                   FOR j IN range(1, compared + 1)]) AS matched
  FROM win
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_pos) AS k FROM counted
)
SELECT doc_id, item_id, n_items, CAST(matched AS INTEGER) AS matched, CAST(compared AS INTEGER) AS compared,
       matched / compared AS similarity, CAST(doc_pos AS INTEGER) AS doc_pos
FROM best WHERE k = 1 AND matched >= ceil(compared * 0.8 - 1e-9)
"""

#: Host, path and verdict of the listed URL prefixes.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP2_SQL = """
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0
              THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM u
), r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b WHERE k = 1
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "lang_pred", F.round("lang_score", 6).alias("score")
    )


def _op3_sql() -> str:
    """Counts, smoothed log frequencies and backoff by joins. The training sample is all rows as long as no language
    has more than langid.SAMPLE_ROWS, as in the small tables."""
    # The polynomial and the first remainder of CRC-32, a bit at a time.
    crc = """xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]),
                           lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)), 4294967295::UBIGINT)"""
    limit = f"{langid.WORD_LIMIT}::DOUBLE"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, text, {crc} % 4 = 2 AS held_out, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS w FROM documents
), langs AS (
  SELECT lang, row_number() OVER (ORDER BY lang) AS l FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL AND NOT held_out AND len(w) > 0)
), counted AS (
  SELECT lang, ' ' || w || ' ' AS key, count(*) AS n FROM (SELECT lang, unnest(w) AS w FROM d WHERE lang IS NOT NULL AND NOT held_out) GROUP BY ALL
), gram AS (
  SELECT lang, size, key[i : i + size - 1] AS key, n FROM counted, (SELECT unnest([1, 2, 3, 4]) AS size) z, unnest(range(1, length(key) - size + 2)) t(i)
), top AS (
  SELECT lang, 0 AS size, key, n FROM counted WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, key) <= {langid.KEEP_WORDS}
  UNION ALL
  SELECT lang, size, key, sum(n) AS n FROM gram GROUP BY lang, size, key QUALIFY row_number() OVER (PARTITION BY lang, size ORDER BY sum(n) DESC, key) <= {langid.KEEP_GRAMS}
), cell AS (
  SELECT size, key, l, coalesce(n, 0) AS n FROM (SELECT DISTINCT size, key FROM top) CROSS JOIN langs LEFT JOIN top USING (size, key, lang)
), logs AS (
  SELECT size, key, l, ln((n + 0.5::DOUBLE) / (sum(n) OVER (PARTITION BY size, l) + 0.5::DOUBLE * count(*) OVER (PARTITION BY size, l))) AS x FROM cell
), entry AS (
  SELECT size, key, l, greatest(-{limit}, least({limit}, x - avg(x) OVER (PARTITION BY size, key))) AS x FROM logs
), word AS (
  SELECT DISTINCT ' ' || w || ' ' AS key FROM (SELECT unnest(w) AS w FROM d)
), piece AS (
  SELECT key AS word, 0 AS size, key FROM word
  UNION ALL
  SELECT key, size, key[i : i + size - 1] FROM word, (SELECT unnest([1, 2, 3, 4]) AS size) z, unnest(range(1, length(key) - size + 2)) t(i)
), used AS (
  SELECT word, size, p.key, rank() OVER (PARTITION BY word ORDER BY CASE size WHEN 0 THEN 9 ELSE size END DESC) AS k
  FROM piece p SEMI JOIN entry e ON p.size = e.size AND p.key = e.key
), scored AS (
  SELECT word, l, CASE WHEN size = 0 THEN sum(x) ELSE greatest(-{limit}, least({limit}, sum(x) / size)) END AS x
  FROM used JOIN entry USING (size, key) WHERE k = 1 GROUP BY word, size, l
), total AS (
  SELECT doc_id, l, coalesce(sum(x), 0) AS x FROM (SELECT doc_id, ' ' || unnest(w) || ' ' AS word FROM d) CROSS JOIN langs LEFT JOIN scored USING (word, l) GROUP BY doc_id, l
), best AS (
  SELECT doc_id, arg_min(lang, (-x, l)) AS lang_pred, max(x) AS top, list(x) AS xs FROM total JOIN langs USING (l) GROUP BY doc_id
)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(round(1 / list_sum([exp(x - top) FOR x IN xs]), 6), 0) AS score FROM d LEFT JOIN best USING (doc_id)
"""


def _rule_columns(spans) -> list:
    """The contract's columns of the rules: counts by kind, and a digest of their spans."""
    number = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["kind"] != "model")
    return [*map(number, ("assign", "access", "hex")), F.sha2(_listed(base), 256).alias("base_sha256")]


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' spans and those that the network adds; then how many places it scored, how many it added, and its highest score."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    spans, scores = F.col("secret_spans"), F.col("secret_scores")
    return secrets.scan(docs, secrets.train(docs), scores=True).select(
        "doc_id",
        *_rule_columns(spans),
        _listed(spans).alias("spans"),
        F.size(scores).cast("long").alias("n_scored"),
        F.size(F.filter(spans, lambda x: x["kind"] == "model")).cast("long").alias("n_model"),
        F.round(F.array_max(scores), 6).alias("top_score"),
    )


def secret_rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the secret scan that SQL expresses: the rules' columns, from the same operator."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    spans = F.filter("secret_spans", lambda x: x["kind"] != "model")
    return secrets.scan(docs, secrets.train(docs)).select("doc_id", *_rule_columns(spans), _listed(spans).alias("spans"))


#: The rules' spans. What the network scores is not for SQL; tests hold it against plain Python.
OP4_SQL = r'''
WITH rule(kind, place, least) AS (VALUES ('assign', 0, 6), ('access', 1, 20), ('hex', 2, 24)), d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT doc_id, kind, place, least,
         string_split(CASE kind WHEN 'assign' THEN regexp_replace(t, '(?i)((?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', chr(1) || '\1' || chr(2), 'g')
                                WHEN 'access' THEN regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\1' || chr(2), 'g')
                                ELSE regexp_replace(t, '([0-9a-f]+)', chr(1) || '\1' || chr(2), 'g') END, chr(1)) AS parts
  FROM d, rule
), part AS (
  SELECT doc_id, kind, place, least, unnest(parts) AS p, unnest(range(len(parts))) AS k FROM cut
), placed AS (
  SELECT doc_id, kind, place, least, split_part(p, chr(2), 1) AS m, k,
         sum(length(p) - (k > 0)::INT) OVER (PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start
  FROM part
), span AS (
  SELECT doc_id, kind, place, start, start + length(m) AS stop FROM placed
  WHERE k > 0 AND length(CASE WHEN kind = 'assign' THEN regexp_replace(m, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '') ELSE m END) >= least
), listed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) AS spans
  FROM span GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
'''


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenfiles.read(tokenfiles.write(documents(spark, sf_dir, "doc_id", "text"), path, end_id=2))


# Fixed value: white space of Unicode as a class of characters.
_WHITE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _op5_sql() -> str:
    """Normalise, split and merge by the tokenizers file, for texts without its special tokens; CRC-32 by its table."""
    return rf"""
WITH RECURSIVE file AS MATERIALIZED (
  SELECT CAST(content AS JSON) AS j FROM read_text('{public_tokenizers.path("word_bpe_49k.json")}')
), vocabulary AS MATERIALIZED (
  SELECT e.key AS x, e.value AS id FROM (SELECT unnest(map_entries(CAST(j -> '$.model.vocab' AS MAP(VARCHAR, INTEGER)))) AS e FROM file)
), pair AS (
  SELECT unnest(m) AS ab, unnest(range(len(m))) AS r FROM (SELECT CAST(j -> '$.model.merges' AS VARCHAR[][]) AS m FROM file)
), merge AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, r, c.id AS m FROM pair JOIN vocabulary a ON a.x = ab[1] JOIN vocabulary b ON b.x = ab[2] JOIN vocabulary c ON c.x = ab[1] || ab[2]
), letter AS MATERIALIZED (
  SELECT format('{{:02X}}', k) AS x, CASE WHEN seen THEN chr(CAST(k AS INTEGER)) ELSE chr(CAST(255 + sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (ORDER BY k) AS INTEGER)) END AS c
  FROM (SELECT k, k BETWEEN 33 AND 126 OR k BETWEEN 161 AND 172 OR k BETWEEN 174 AND 255 AS seen FROM range(256) t(k))
), cut AS (
  SELECT doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '''s|''t|''re|''ve|''m|''ll|''d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+') AS w FROM documents
), word AS MATERIALIZED (
  SELECT row_number() OVER () AS w, s, hex(encode(s)) AS x FROM (SELECT DISTINCT unnest(w) AS s FROM cut)
), byte AS (
  SELECT w, unnest(range(len(x) // 2)) AS p, unnest([x[2 * i + 1 : 2 * i + 2] FOR i IN range(len(x) // 2)]) AS x, len(x) // 2 AS size FROM word
), tok AS (
  SELECT w, p, id AS t, lead(id) OVER (PARTITION BY w ORDER BY p) AS u, lead(p) OVER (PARTITION BY w ORDER BY p) AS n
  FROM byte JOIN letter USING (x) JOIN vocabulary v ON v.x = letter.c || CASE WHEN p = size - 1 THEN '</w>' ELSE '' END
), step(w, p, n, t, u, r, m, i) AS (
  SELECT w, p, n, t, u, r, m, 0 FROM tok LEFT JOIN merge ON t = a AND u = b
  UNION ALL
  SELECT y.w, y.p, y.n, y.t, y.u, merge.r, merge.m, y.i + 1 FROM (
    SELECT s.w, s.p, s.i, CASE WHEN s.p = g.p THEN g.after ELSE s.n END AS n, CASE WHEN s.p = g.p THEN g.m ELSE s.t END AS t,
           CASE WHEN s.p = g.p THEN g.u WHEN s.n = g.p THEN g.m ELSE s.u END AS u
    FROM step s JOIN (
      SELECT b.w, b.best.m AS m, b.best.p AS p, c.p AS gone, c.n AS after, c.u
      FROM (SELECT w, min({{'r': r, 'p': p, 'n': n, 'm': m}}) AS best FROM step WHERE r IS NOT NULL GROUP BY w) b JOIN step c ON c.w = b.w AND c.p = b.best.n
    ) g ON g.w = s.w WHERE s.p <> g.gone) y LEFT JOIN merge ON y.t = merge.a AND y.u = merge.b
), last AS (SELECT w, max(i) AS i FROM step GROUP BY w
), coded AS (
  SELECT s, list(t ORDER BY p) AS ids FROM step JOIN last USING (w, i) JOIN word USING (w) GROUP BY s
), placed AS (
  SELECT doc_id, unnest(w) AS s, unnest(range(len(w))) AS k FROM cut
), joined AS (
  SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids FROM placed JOIN coded USING (s) GROUP BY doc_id
), ended AS (
  SELECT doc_id, list_append(coalesce(ids, []), 2) AS ids FROM cut LEFT JOIN joined USING (doc_id)
), crc AS MATERIALIZED (
  SELECT [list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END) FOR i IN range(256)] AS rest
)
SELECT doc_id, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len(ids) AS n_tokens,
       CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten([[id & 255, id >> 8 & 255, id >> 16 & 255, id >> 24] FOR id IN ids])::UBIGINT[]),
                lambda a, b: xor(rest[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8)), 4294967295::UBIGINT) AS BIGINT) AS ids_crc32
FROM ended, crc
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~out))
    p = F.col("toxic_score")
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


# The primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _op7_sql(seed: int = 42) -> str:
    """The hash by lanes of eight bytes in 128-bit arithmetic, the bits by 64 sums, the components by reachability."""
    p1, p2, p3, p4, p5 = _PRIMES
    m = 1 << 64
    big = lambda n: f"{n % m}::UHUGEINT"
    mul = lambda a, p: f"(({a}) * {big(p)} % {m}::UHUGEINT)"
    add = lambda a, b: f"((({a}) + ({b})) % {m}::UHUGEINT)"
    turn = lambda a, r: f"(({a}) * {big(1 << r)} % {m - 1}::UHUGEINT)"  # noqa: E731  # to the left by r bits
    lane = lambda acc, x: mul(turn(add(acc, mul(x, p2)), 31), p1)
    number = lambda at, size: "(" + " + ".join(f"b[{at} + {k + 1}] * {big(256**k)}" for k in range(size)) + ")"
    mix = lambda x: f"xor(h, {x})"
    starts = (seed + p1 + p2, seed + p2, seed, seed - p1)
    four = ", ".join(
        f"CASE WHEN n >= 32 THEN list_reduce(list_prepend({big(v)}, [lanes[4 * s + {j + 1}] FOR s IN range(n // 32)]), lambda a, x: {lane('a', 'x')}) END AS v{j + 1}"
        for j, v in enumerate(starts)
    )
    joined = add(add(turn("v1", 1), turn("v2", 7)), add(turn("v3", 12), turn("v4", 18)))
    eight = add(mul(turn(mix(lane(big(0), "x")), 27), p1), big(p4))
    bits = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
    value = " + ".join(f"CASE WHEN b{b} * 2 > n THEN {big(1 << b)} ELSE {big(0)} END" for b in range(64))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE [concat_ws(' ', w[i], w[i + 1], w[i + 2]) FOR i IN range(1, len(w) - 1)] END) AS shingle
  FROM d WHERE len(w) > 0
), bytes AS (
  SELECT shingle, len(x) // 2 AS n, [CAST('0x' || x[2 * k + 1 : 2 * k + 2] AS UHUGEINT) FOR k IN range(len(x) // 2)] AS b
  FROM (SELECT shingle, hex(encode(shingle)) AS x FROM (SELECT DISTINCT shingle FROM s))
), lane AS (
  SELECT shingle, n, b, [{number("8 * i", 8)} FOR i IN range(n // 8)] AS lanes FROM bytes
), stripes AS (
  SELECT shingle, n, b, lanes, {four} FROM lane
), begun AS (
  SELECT shingle, n, b, lanes, CASE WHEN n < 32 THEN {big(seed + p5)} ELSE list_reduce([{joined}, v1, v2, v3, v4],
         lambda h, x: {add(mul(mix(lane(big(0), "x")), p1), big(p4))}) END AS h FROM stripes
), eights AS (
  SELECT shingle, n, b, list_reduce(list_prepend({add("h", "n::UHUGEINT")}, lanes[4 * (n // 32) + 1 :]), lambda h, x: {eight}) AS h FROM begun
), fours AS (
  SELECT shingle, n, b, CASE WHEN n % 8 >= 4 THEN {add(mul(turn(mix(mul(number("n // 8 * 8", 4), p1)), 23), p2), big(p3))} ELSE h END AS h FROM eights
), ones AS (
  SELECT shingle, list_reduce(list_prepend(h, b[n // 4 * 4 + 1 :]), lambda h, x: {mul(turn(mix(mul("x", p5)), 11), p1)}) AS h FROM fours
), a1 AS (SELECT shingle, {mul(mix("h >> 33"), p2)} AS h FROM ones
), a2 AS (SELECT shingle, {mul(mix("h >> 29"), p3)} AS h FROM a1
), hashed AS (SELECT shingle, CAST(xor(h, h >> 32) AS UBIGINT) AS h FROM a2
), bits AS (
  SELECT doc_id, count(*) AS n, {bits} FROM s JOIN hashed USING (shingle) GROUP BY doc_id
), fps AS (
  SELECT d.doc_id, CAST(coalesce({value}, 0) AS UBIGINT) AS fp FROM d LEFT JOIN bits USING (doc_id)
), node AS (SELECT fp, min(doc_id) AS least FROM fps GROUP BY fp
), link AS (SELECT a.fp AS a, b.fp AS b FROM node a JOIN node b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 2
), reach(fp, least) AS (SELECT fp, least FROM node UNION SELECT link.b, reach.least FROM reach JOIN link ON reach.fp = link.a)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id, coalesce(n_links, 0) AS n_links
FROM fps JOIN (SELECT fp, min(least) AS component_id FROM reach GROUP BY fp) USING (fp)
LEFT JOIN (SELECT a AS fp, count(*) AS n_links FROM link GROUP BY a) USING (fp)
"""


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = stored(media.to_media(documents(spark, sf_dir, "doc_id", "text")), "media")
    return media.features(images).select(
        "doc_id",
        "n_bytes",
        F.col("samples").alias("payload_bytes"),
        F.col("samples_sha256").alias("payload_sha256"),
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        F.concat_ws(":", "height", "width", "dhash", F.sha2("tile", 256)).alias("feature"),
    )


def _op8_sql() -> str:
    """Files byte by byte as hex, box sums in whole numbers, CRC-32 a bit at a time."""
    low = lambda x, n: " || ".join(f"format('{{:02x}}', ({x}) >> {8 * k} & 255)" for k in range(n))  # noqa: E731  # little-endian
    npy = b"\x93NUMPY\x01\x00v\x00" + b"{'descr': '|u1', 'fortran_order': False, 'shape': (32, 32), }".ljust(117) + b"\n"
    return rf"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT doc_id, n, greatest((n + 63) // 64, 1) AS h, rpad(x, CAST(greatest((n + 63) // 64, 1) * 128 AS INTEGER), '0') AS x FROM d
), form AS (
  SELECT *, CASE WHEN h % 4 = 0 THEN 'BM' WHEN h % 4 = 1 AND h % 3 = 0 THEN 'P6' ELSE 'P5' END AS kind FROM p
), m AS (
  SELECT *, CASE WHEN kind = 'P6' THEN h // 3 ELSE h END AS rows, CASE WHEN kind = 'P6' THEN 1000 ELSE 1 END AS scale,
         lower(CASE kind WHEN 'BM' THEN hex(encode('BM')) || {low("1078 + h * 64", 4)} || '00000000' || {low("1078", 4)} || {low("40", 4)} || {low("64", 4)} || {low("4294967296 - h", 4)}
              || '0100' || '0800' || '00000000' || {low("h * 64", 4)} || {low("2835", 4)} || {low("2835", 4)} || {low("256", 4)} || {low("256", 4)}
              || array_to_string([repeat(format('{{:02x}}', i), 3) || '00' FOR i IN range(256)], '')
           WHEN 'P6' THEN hex(encode('P6' || chr(10) || '64 ' || h // 3 || chr(10) || '255' || chr(10)))
           ELSE hex(encode('P5' || chr(10) || '64 ' || h || chr(10) || '255' || chr(10))) END) || lower(x) AS media
  FROM form
), strip AS (
  SELECT doc_id, kind, rows, unnest(range(h)) AS j, unnest([x[128 * i + 1 : 128 * i + 128] FOR i IN range(h)]) AS x FROM m
), sample AS (
  SELECT doc_id, kind, rows, j * 64 + unnest(range(64)) AS k, unnest([CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT) FOR i IN range(64)]) AS v FROM strip
), pixel AS (
  SELECT doc_id, rows, k // 64 AS y, k % 64 AS x, v FROM sample WHERE kind <> 'P6'
  UNION ALL
  SELECT doc_id, rows, k // 192, k // 3 % 64, v * [299, 587, 114][k % 3 + 1] FROM sample WHERE kind = 'P6'
), grid(gh, gw) AS (VALUES (32, 32), (8, 9)
), line AS (
  SELECT doc_id, rows, gh, gw, y, c, sum(v * (least((x + 1) * gw, (c + 1) * 64) - greatest(x * gw, c * 64))) AS s
  FROM pixel, grid, unnest(range(x * gw // 64, ((x + 1) * gw - 1) // 64 + 1)) t(c) GROUP BY doc_id, rows, gh, gw, y, c
), box AS (
  SELECT doc_id, gh, r, c, CAST(sum(s * (least((y + 1) * gh, (r + 1) * rows) - greatest(y * gh, r * rows))) AS BIGINT) AS s
  FROM line, unnest(range(y * gh // rows, ((y + 1) * gh - 1) // rows + 1)) t(r) GROUP BY doc_id, gh, r, c
), tiles AS (
  SELECT doc_id, string_agg(format('{{:02x}}', (2 * s + rows * 64 * scale) // (2 * rows * 64 * scale)), '' ORDER BY r, c) AS t
  FROM box JOIN m USING (doc_id) WHERE gh = 32 GROUP BY doc_id
), hashes AS (
  SELECT doc_id, string_agg(format('{{:02x}}', n), '' ORDER BY r) AS dh
  FROM (SELECT a.doc_id, a.r, CAST(sum(CASE WHEN a.s < b.s THEN 1 << CAST(7 - a.c AS INTEGER) ELSE 0 END) AS BIGINT) AS n
        FROM box a JOIN box b ON a.doc_id = b.doc_id AND a.gh = 8 AND b.gh = 8 AND a.r = b.r AND b.c = a.c + 1 GROUP BY a.doc_id, a.r) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, h * 64 AS payload_bytes, sha256(unhex(x)) AS payload_sha256,
       CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, [CAST('0x' || right(x, 128)[2 * i + 1 : 2 * i + 2] AS UBIGINT) FOR i IN range(64)]),
         lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)), 4294967295::UBIGINT) AS BIGINT) AS tail_crc32,
       len(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
       concat_ws(':', rows, 64, dh, sha256(unhex('{npy.hex()}' || t))) AS feature
FROM m JOIN tiles USING (doc_id) JOIN hashes USING (doc_id)
"""


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log of ``pages``, as WARC text: each page's response, and 7,001 ticks on a revisit.

    A response is captured 10 times page_id seconds after 1970 (a tick is a second). Every third revisit has no entity tag, every
    fifth one that has changed meanwhile, every seventh neither validator.
    """
    pages = pages.withColumn("tag", F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"')))
    n, tag = F.col("page_id"), F.col("tag")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    of_day = lambda t: F.pmod(t, F.lit(86_400))
    clock = lambda t: F.concat_ws(":", two(F.floor(of_day(t) / 3600)), two(F.floor(of_day(t) % 3600 / 60)), two(of_day(t) % 60))
    iso = lambda t: F.concat(F.date_from_unix_date(F.floor(t / 86_400).cast("int")).cast("string"), F.lit("T"), clock(t), F.lit("Z"))
    response = warc.format_record(
        F.lit("response"),
        F.concat(F.lit("r"), n),
        F.col("url"),
        iso(n * 10),
        [("ETag", tag), ("Last-Modified", n * 10), ("Date", n * 10), ("Content-Type", F.lit("text/html"))],
        F.col("html"),
    )
    later = F.when(n % 5 == 0, F.concat(F.lit('"new-'), n, F.lit('"'))).otherwise(F.concat(F.lit("W/"), tag))
    revisit = warc.format_record(
        F.lit("revisit"),
        F.concat(F.lit("v"), n),
        F.col("url"),
        iso(n * 10 + 7001),
        [
            ("ETag", F.when((n % 3 != 0) & (n % 7 != 0), later)),
            ("Last-Modified", F.when(n % 7 != 0, n * 10)),
            ("Date", n * 10 + 7001),
            ("Content-Type", F.lit("text/plain")),
        ],
        F.lit(None).cast("string"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("warc"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = stored(warc.parse_records(crawl_records(pages)), "records")  # parsed once, read for resolving and for payloads
    header = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    found = warc.with_payload(warc.resolve(records), records)
    return found.select(
        "record_id",
        "canonical_url",
        "kind",
        F.unix_seconds("captured").alias("captured"),
        "response_id",
        "status",
        F.array_join(header, ";").alias("headers"),
        F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, '"' || md5(coalesce(html, '')) || '"' AS tag, md5(coalesce(html, '')) AS pm,
         split_part(substr(url, strpos(url, '://') + 3), '#', 1) AS rest, strpos(url, '://') > 0 AS ok
  FROM pages
), c AS (
  SELECT *, split_part(rest, '?', 1) AS base, split_part(split_part(rest, '?', 1), '/', 1) AS host FROM u
), k AS (
  SELECT *, list_sort([x FOR x IN string_split(substr(rest, length(base) + 2), '&')
              IF x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('ref', 'fbclid', 'gclid')]) AS q FROM c
), p AS (
  SELECT page_id, tag, pm,
         CASE WHEN ok THEN regexp_replace(regexp_replace(lower(host), '^www\.', ''), ':(80|443)$', '')
              || regexp_replace(substr(base, length(host) + 1), '/+$', '')
              || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS cu
  FROM k
), v AS (
  SELECT p.page_id, p.cu, p.page_id * 10 + 7001 AS t,
         CASE WHEN p.page_id % 3 <> 0 AND p.page_id % 7 <> 0
              THEN CASE WHEN p.page_id % 5 = 0 THEN '"new-' || p.page_id || '"' ELSE p.tag END END AS tag,
         CASE WHEN p.page_id % 7 <> 0 THEN p.page_id * 10 END AS lm,
         CASE WHEN p.page_id % 5 = 0 THEN '' ELSE 'W/' END AS weak,
         r.page_id AS rid, r.tag AS rtag, r.pm AS rpm,
         row_number() OVER (PARTITION BY p.page_id ORDER BY r.page_id DESC NULLS LAST) AS n
  FROM p LEFT JOIN p r ON r.cu = p.cu AND r.page_id * 10 < p.page_id * 10 + 7001
), w AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'orphan'
                 WHEN tag IS NOT NULL THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'changed' END
                 WHEN lm IS NOT NULL THEN CASE WHEN lm = rid * 10 THEN 'resolved' ELSE 'changed' END
                 ELSE 'unverified' END AS status
  FROM v WHERE n = 1
)
SELECT 'r' || page_id AS record_id, cu AS canonical_url, 'response' AS kind, page_id * 10 AS captured,
       'r' || page_id AS response_id, 'full' AS status,
       'content-type=text/html;date=' || page_id * 10 || ';etag=' || tag || ';last-modified=' || page_id * 10 AS headers, pm AS payload_md5
FROM p
UNION ALL
SELECT 'v' || page_id, cu, 'revisit', t, CASE WHEN status IN ('resolved', 'unverified') THEN 'r' || rid END, status,
       CASE WHEN status IN ('resolved', 'unverified')
            THEN 'content-type=text/html;date=' || t || ';etag=' || coalesce(weak || tag, rtag) || ';last-modified=' || rid * 10
            ELSE 'content-type=text/plain;date=' || t || coalesce(';etag=' || weak || tag, '') || coalesce(';last-modified=' || lm, '') END,
       CASE WHEN status IN ('resolved', 'unverified') THEN rpm END
FROM w
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def _op10_sql() -> str:
    """Merge pairs from the rank file, one contraction per word and round. A mark before the last of several white
    characters stands for the look-ahead of the pattern, which this dialect lacks."""
    return rf"""
WITH RECURSIVE rank AS MATERIALIZED (
  SELECT hex(from_base64(t)) AS x, r FROM read_csv('{public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'INTEGER'}})
), merge AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, c.r AS m FROM (SELECT x, r, unnest(range(1, len(x) // 2)) AS i FROM rank) c
  JOIN rank a ON a.x = c.x[1 : 2 * i] JOIN rank b ON b.x = c.x[2 * i + 1 :]
), d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT doc_id, list_concat(flatten([regexp_extract_all(s, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+')
    FOR s IN string_split(regexp_replace(t, '([{_WHITE}])([{_WHITE}][^{_WHITE}])', '\1' || chr(1) || '\2', 'g'), chr(1))]), []) AS w FROM d
), word AS MATERIALIZED (
  SELECT row_number() OVER () AS w, s, hex(encode(s)) AS x FROM (SELECT DISTINCT unnest(w) AS s FROM cut)
), byte AS (
  SELECT w, unnest(range(len(x) // 2)) AS p, unnest([x[2 * i + 1 : 2 * i + 2] FOR i IN range(len(x) // 2)]) AS x FROM word
), tok AS (
  SELECT w, p, r AS t, lead(r) OVER (PARTITION BY w ORDER BY p) AS u, lead(p) OVER (PARTITION BY w ORDER BY p) AS n FROM byte JOIN rank USING (x)
), step(w, p, n, t, u, m, i) AS (
  SELECT w, p, n, t, u, merge.m, 0 FROM tok LEFT JOIN merge ON t = a AND u = b
  UNION ALL
  SELECT y.w, y.p, y.n, y.t, y.u, merge.m, y.i + 1 FROM (
    SELECT s.w, s.p, s.i, CASE WHEN s.p = g.p THEN g.after ELSE s.n END AS n, CASE WHEN s.p = g.p THEN g.m ELSE s.t END AS t,
           CASE WHEN s.p = g.p THEN g.u WHEN s.n = g.p THEN g.m ELSE s.u END AS u
    FROM step s JOIN (
      SELECT b.w, b.best.m AS m, b.best.p AS p, c.p AS gone, c.n AS after, c.u
      FROM (SELECT w, min({{'m': m, 'p': p, 'n': n}}) AS best FROM step WHERE m IS NOT NULL GROUP BY w) b JOIN step c ON c.w = b.w AND c.p = b.best.n
    ) g ON g.w = s.w WHERE s.p <> g.gone) y LEFT JOIN merge ON y.t = merge.a AND y.u = merge.b
), last AS (SELECT w, max(i) AS i FROM step GROUP BY w
), coded AS (
  SELECT s, count(*) AS n, string_agg(CAST(t AS VARCHAR), ',' ORDER BY p) AS ids FROM step JOIN last USING (w, i) JOIN word USING (w) GROUP BY s
), placed AS (
  SELECT doc_id, unnest(w) AS s, unnest(range(len(w))) AS k FROM cut
), joined AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, string_agg(ids, ',' ORDER BY k) AS ids FROM placed JOIN coded USING (s) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_tokens, sha256(coalesce(ids, '')) AS ids_sha256, sha256(encode(t)) AS decoded_sha256 FROM d LEFT JOIN joined USING (doc_id)
"""


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "benchmark"), percent=25, seed=7)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the query's contract states; nulls count as one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    k = F.col("k")
    times = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("k"))
    cut = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), F.explode(F.array_repeat(F.lit(0), times)))
    return changed.drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, _ = conversations.repair(damaged(turns))
    every = turns.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").drop(found["conv_id"])
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shingles.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), fingerprints=False)
    alone = F.col("n_shingles") == 0  # texts without words are linked with nothing
    return found.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_url_filter, op3_language_id, op4_secret_scan, secret_rule_spans, op5_token_files, op6_toxicity, op7_simhash_near_dedup, op8_media_columns, op9_warc_revisits, op10_byte_bpe, op11_target_resampling, op12_conversation_repair, op13_ngram_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op2_url_filter": OP2_SQL,
        "op3_language_id": _op3_sql(),
        "secret_rule_spans": OP4_SQL,
        "op5_token_files": _op5_sql(),
        "op7_simhash_near_dedup": _op7_sql(),
        "op8_media_columns": _op8_sql(),
        "op9_warc_revisits": OP9_SQL,
        "op10_byte_bpe": _op10_sql(),
        "op11_target_resampling": statements.OP11_SQL,
        "op12_conversation_repair": statements.OP12_SQL,
        "op13_ngram_jaccard_join": statements.OP13_SQL,
    }
