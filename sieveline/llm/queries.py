"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.ann import nearest
from sieveline.llm.bpe import bpe_digests, encode_and_decode
from sieveline.llm.ego_join import linked_vectors
from sieveline.llm.filter_audit import audit_filters
from sieveline.llm.kneser_ney import train_pairs
from sieveline.llm.mixing import mix_sizes
from sieveline.llm.near_dup import near_duplicates
from sieveline.llm.pii import pseudonymise_documents
from sieveline.llm.quality_model import held_out, train_quality
from sieveline.llm.quality_rules import quality_filter
from sieveline.llm.secrets import count_kind, find_secrets, joined
from sieveline.llm.spelling import spelling_groups, word_counts
from sieveline.llm.url_filter import REFERENCES, UrlRule, filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


#: Every pair of texts that share a shingle, on full sets. The operator misses a pair at the threshold with probability 4e-6.
ORACLES["op7_minhash_near_dup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END)) AS s FROM d),
sized AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets AS a JOIN sets AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sized AS a ON a.doc_id = x JOIN sized AS b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(doc_id, y), doc_id) AS component_id, coalesce(least(doc_id, y), doc_id) = doc_id AS kept
FROM d LEFT JOIN sized USING (doc_id) LEFT JOIN least ON x = doc_id
"""

#: Scores from here on count as good.
GOOD = 0.3


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *[count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


ORACLES["op6_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w FROM d, unnest(range(1, len(ws) - 3)) AS r(i) WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(0, 5) AS o(k) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.t, d.lines, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(lines, lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')))
              - len(list_distinct(list_filter(lines, lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper_letters
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * len(lines) OR 10 * letters < 6 * word_chars OR (2 * upper_letters > letters AND letters > 0)
            OR 10 * (length(t) - length(replace(t, '!', ''))) > 3 * n_words
            OR 10 * len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) > 3 * len(lines)) AS kept
FROM b
"""

#: Verdict, host, path prefix.
URL_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def _rest(u: str) -> str:
    """SQL of what follows the first :// of a url."""
    return f"(CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END)"


def _host(u: str) -> str:
    return rf"translate(regexp_extract({_rest(u)}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(u: str) -> str:
    return rf"regexp_extract({_rest(u)}, '^[^/?#]*([^?#]*)', 1)"


def _query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*(\?[^#]*)', 1)"


def _address(u: str) -> str:
    """SQL of what aliases are compared by."""
    port = f"CASE WHEN regexp_matches({u}, '(?i)^https:') THEN regexp_replace({_host(u)}, ':443$', '') WHEN regexp_matches({u}, '(?i)^http:') THEN regexp_replace({_host(u)}, ':80$', '') ELSE regexp_replace({_host(u)}, ':(?:80|443)$', '') END"
    return f"CASE WHEN {_host(u)} <> '' THEN {port} || CASE WHEN {_path(u)} = '/' THEN '' ELSE {_path(u)} END || {_query(_rest(u))} END"


def _plain(t: str) -> str:
    """SQL of an attribute's text with its character references resolved."""
    for pattern, character in REFERENCES:
        t = f"regexp_replace({t}, '{pattern}', '{character.replace(chr(39), chr(39) * 2)}', 'g')"
    return t


def _without_dots(p: str) -> str:
    folded = rf"list_reduce(string_split({p}, '/'), lambda a, s: CASE WHEN s = '.' THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END)"
    return rf"CASE WHEN regexp_matches({p}, '/\.\.?(/|$)') THEN {folded} || CASE WHEN regexp_matches({p}, '/\.\.?$') THEN '/' ELSE '' END ELSE {p} END"


def _resolving(source: str, name: str, url: str, target: str) -> str:
    """SQL of tables ``name``_1 to _3 and ``name``: the rows of source, and as column ``name`` a target as a browser resolves it on a url."""
    scheme = "'^[A-Za-z][A-Za-z0-9+.-]*:'"
    return rf"""
{name}_1 AS (SELECT *, regexp_extract({target}, '^[^?#]*') AS tp, {_query(target)} AS tq, {_path(url)} AS up, regexp_extract({url}, {scheme}) AS us FROM {source}),
{name}_2 AS (SELECT *, CASE WHEN starts_with(tp, '/') THEN tp WHEN up = '' THEN '/' || tp ELSE regexp_extract(up, '(?s)^.*/') || tp END AS whole FROM {name}_1),
{name}_3 AS (SELECT *, 'http://' || {_host(url)} || CASE WHEN tp = '' THEN up || CASE WHEN tq <> '' THEN tq ELSE {_query(_rest(url))} END ELSE {_without_dots('whole')} || tq END AS moved FROM {name}_2),
{name} AS (
  SELECT * EXCLUDE (tp, tq, up, us, whole, moved),
         CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target} WHEN starts_with({target}, '//') THEN CASE WHEN us = '' THEN 'http:' ELSE us END || {target}
              WHEN NOT regexp_matches({target}, {scheme}) THEN moved END AS {name}
  FROM {name}_3)"""


def _ruled(source: str, host: str, path: str) -> str:
    """SQL of source's rows with ``best``, the longest rule that fits, or null."""
    return f"""SELECT *, (SELECT max(struct_pack(n := length(h || p), r := h || p, v := v)) FROM rules
          WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p)) AS best FROM {source}"""


HREF = r"""'(?i)\bhref\s*=\s*["'']?([^"''\s>]+)'"""
ORACLES["op9_url_filter"] = rf"""
WITH RECURSIVE rules(v, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
linked AS (
  SELECT url, html, trim({_plain(f"regexp_extract(regexp_extract(html, '(?i)<base{chr(92)}b[^>]*{chr(92)}bhref{chr(92)}s*=[^>]*>'), {HREF}, 1)")}) AS href
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
{_resolving("linked", "based", "url", "href")},
tags AS (
  SELECT url, CASE WHEN href <> '' THEN coalesce(based, url) ELSE url END AS base_url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM based),
targets AS (
  SELECT url, base_url, {_plain("t")} AS target
  FROM (SELECT url, base_url, CASE WHEN regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, {HREF}, 1)
                     WHEN regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b')
                     THEN regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1) END AS t FROM tags)
  WHERE t <> ''),
{_resolving("targets", "found", "base_url", "target")},
e AS (SELECT DISTINCT x, y FROM (SELECT {_address("url")} AS x, {_address("found")} AS y FROM found) WHERE x <> y),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
nodes AS (SELECT DISTINCT y AS node, 'x://' || regexp_replace(y, '^([^/?]*)(\?|$)', '\1/\2') AS u FROM reach),
placed AS (SELECT node, {_host("u")} AS nh, {_path("u")} AS np FROM nodes),
judged AS ({_ruled("placed", "nh", "np")}),
shared AS (SELECT reach.x AS address, min(best.v) AS v FROM reach JOIN judged ON judged.node = reach.y GROUP BY reach.x),
own AS (SELECT page_id, coalesce({_host("url")}, '') AS host, coalesce({_path("url")}, '') AS path, {_address("url")} AS address FROM pages),
ruled AS ({_ruled("own", "host", "path")})
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, shared.v, 'allow') AS verdict FROM ruled LEFT JOIN shared USING (address)
"""


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *bpe_digests())


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise_documents(docs)


@query
def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_pairs(docs.where(~held_out(folds=10)))
    scored = model.score(docs.withColumn("held_out", held_out(folds=10)))
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), thinned=199))


ORACLES["op11_spelling_groups"] = r"""
WITH RECURSIVE step(b, i, c) AS (
  SELECT CAST(range AS UBIGINT), 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM step WHERE i = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(x), 2), lambda i: CAST(('0x' || substr(x, i, 2)) AS UBIGINT))),
                                 lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS h
  FROM bytes, crc),
kept AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || '.' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, range(1, length(word) + 1) AS r(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut AS a JOIN cut AS b USING (hole) WHERE a.word <> b.word
  UNION SELECT v.word, cut.word, cut.n FROM v JOIN cut ON cut.rest = v.word
  UNION SELECT cut.word, v.word, v.n FROM v JOIN cut ON cut.rest = v.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other COLLATE C) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
follow(word, root) AS (SELECT word, word FROM v UNION ALL SELECT follow.word, form FROM follow JOIN formed ON formed.word = follow.root WHERE form IS NOT NULL),
ends AS (SELECT follow.word, root FROM follow JOIN formed ON formed.word = follow.root WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op12_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
marked AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN marked USING (doc_id)),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
orders(o) AS (
  SELECT '' UNION ALL
  SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS l(x) WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (SELECT o, k, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS before FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
hit AS (
  SELECT part, o, k, x, n, good, toxic, contains(fails, x) AS here, fails = x AS alone, fails <> '' AND before <> '' AND regexp_matches(fails, '[' || before || ']') AS earlier
  FROM cells, (SELECT o, k, x, CASE WHEN before = '' THEN '-' ELSE before END AS before FROM steps)),
each AS (
  SELECT part, o AS filter_order, k, x,
         coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(n) FILTER (here AND NOT earlier AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT earlier AND toxic), 0) AS toxic_lost
  FROM hit GROUP BY part, o, k, x)
SELECT part, filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM each
"""


@query
def op13_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op13_ego_join"] = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings),
near AS (
  SELECT a.r AS x, b.r AS y FROM v AS a JOIN v AS b
  ON a.r < b.r AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9),
both_ways AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
least AS (SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
counted AS (SELECT x AS r, count(*) AS n FROM both_ways GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, component_id IS NULL) AS kept
FROM v JOIN least USING (r) LEFT JOIN counted USING (r)
"""
