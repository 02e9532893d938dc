"""The queries of this folder: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import curve_packing, embed_dedup, hard_negatives, lang_id, minhash, mixing, packing, quality, topk, toxicity, url_filter, warc, whitening
from tabkit.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MIX = [5.0, 2.0, 1.0]
VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def query(sql: str | None = None) -> Callable:
    def keep(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("""WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT *, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_transform(string_split(url, ''), lambda c:
    CASE WHEN unicode(c) BETWEEN 0 AND 32 OR unicode(c) = 127 THEN printf('%%%02X', unicode(c)) ELSE c END), '') AS url FROM f""")
def op1_warc(spark, sf):
    """Archive all pages and read the archives back."""
    found = warc.round_trip(table(spark, sf, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def lang_model(docs: DataFrame) -> lang_id.LangModel:
    return lang_id.fit(docs, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))


@query()
def op2_language(spark, sf):
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf, "documents")
    found = lang_id.identify(docs, lang_model(docs), ["doc_id"])
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "ambiguous")


_HOST = """
u AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, CASE WHEN html IS NULL THEN NULL WHEN length(html) = 0 THEN 1
      WHEN length(html) - length(translate(html, '#%*$|{}<>', '')) - 2 * len(regexp_extract_all(html, '<[a-zA-Z/!]'))
           > 0.05 * length(html) THEN 1 ELSE 0 END AS bad FROM p),
"""


def _shrink(name: str, source: str, parent: str) -> str:
    return f"""{name}_s AS (SELECT coalesce(greatest(1.0, least(1000.0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000.0 END)), 1000.0)
      AS s FROM (SELECT (sum(n * (bad * 1.0 / n - {parent}) ** 2) - sum({parent} * (1 - {parent})))
      / nullif(sum((n - 1) * {parent} * (1 - {parent})), 0) AS rho FROM {source} WHERE n > 0)),
{name} AS (SELECT *, (bad + s * {parent}) / (n + s) AS mean, n + s AS size FROM {source}, {name}_s),
"""


@query(f"""WITH {_HOST}
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM s GROUP BY 1),
h1 AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)(ac|co|com|edu|gov|net|org)\\.[a-z][a-z]$')
       THEN regexp_extract(host, '((ac|co|com|edu|gov|net|org)\\.[a-z][a-z])$', 1)
       ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM h0),
h2 AS (SELECT *, regexp_extract(left(host, length(host) - length(suffix)), '([^.]*)\\.$', 1) AS label FROM h1),
hosts AS (SELECT *, CASE WHEN label <> '' THEN label || '.' || suffix ELSE host END AS domain FROM h2),
t AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS over FROM hosts),
sx0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(over) AS over FROM hosts, t GROUP BY 1),
{_shrink('sx', 'sx0', 'over')}
dm0 AS (SELECT domain, hosts.suffix, sum(hosts.n) AS n, sum(hosts.bad) AS bad, any_value(sx.mean) AS sm
        FROM hosts JOIN sx ON hosts.suffix = sx.suffix GROUP BY 1, 2),
{_shrink('dm', 'dm0', 'sm')}
hs0 AS (SELECT host, hosts.n, hosts.bad, dm.mean AS dmean FROM hosts JOIN dm ON hosts.domain = dm.domain),
{_shrink('hs', 'hs0', 'dmean')}
b AS (SELECT host, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS bound FROM hs),
r AS (SELECT page_id, host, path, mean, bound, CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
       WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
       ELSE CASE WHEN bound > 0.2 THEN 'block' ELSE 'allow' END END AS verdict,
       round(mean, 6) AS host_mean, round(bound, 6) AS host_bound FROM r
""")
def op3_url_filter(spark, sf):
    """Rules and host reputation for all pages; a page's outcome is whether its html is junk."""
    found = url_filter.filter_urls(table(spark, sf, "pages"), url_filter.junk_outcome(F.col("html")), RULES)
    return found.withColumns({c: F.round(c, 6) for c in ("host_mean", "host_bound")})


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM e)
SELECT * FROM r WHERE rank <= 10""")
def op4_topk(spark, sf):
    """Ten best of all vectors for every hundredth."""
    return topk.top_k(table(spark, sf, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


@query("""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
  coalesce(greatest(0.2, 1 - 5.0 * (length(text) - length(translate(text, '#%*$|&!=<>{}', ''))) / nullif(length(text), 0)), 0.2) AS w,
  CAST('0x' || substr(md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || coalesce(md5(text), '~')), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM documents),
k AS (SELECT *, -ln((u + 8.8817841970012523e-16) / (1 + 1.7763568394002505e-15)) / w AS key FROM d),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY 1),
w AS (SELECT *, 2.0 * source_size AS lim, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
      1.5 * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
      sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT arg_min((total - held) / open, lim / weight) FILTER (WHERE (total - held) / open * weight <= lim) AS level FROM o),
t AS (SELECT source, source_size, least(lim, coalesce(level, 1e300) * weight) AS target FROM w, l),
b AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM t),
c AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, epochs, floor(target - epochs * source_size)
        - sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) + size AS room
      FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken, CAST(epochs + CASE WHEN size > 0 AND room >= size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c
""")
def op5_mixing(spark, sf):
    """Mix all documents by source."""
    return mixing.mix(table(spark, sf, "documents"), MIX).withColumn("target", F.round("target", 6))


@query()
def op6_minhash(spark, sf):
    """Groups of near duplicates among all documents."""
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query()
def op7_packing(spark, sf):
    """Pack all documents into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf, "documents"), vocabulary())


def _held_out(folds: int, left_out: int):
    return F.coalesce(fold("doc_id", folds) == left_out, F.lit(False)).alias("held_out")


@query()
def op8_quality(spark, sf):
    """Quality of every document, learned from the labels of four fifths of the labelled ones."""
    docs = table(spark, sf, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf, "labels")), ["doc_id"])
    return found.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op9_toxicity(spark, sf):
    """Toxicity of every document, learned from the labels of four fifths of the labelled ones."""
    docs = table(spark, sf, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")), ["doc_id"])
    return found.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL
  AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN k USING (vec_id)"""


@query(_LINKS)
def op10_vectors(spark, sf):
    """Links and groups of near-equal vectors of the same label."""
    return embed_dedup.near_vectors(table(spark, sf, "embeddings"))


@query()
def op11_whitening(spark, sf):
    """The four strongest components of all vectors, whitened."""
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS no
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT a.no AS anchor, a.vec_id AS anchor_id, b.no, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.no <> b.no WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, no AS positive, vec_id AS positive_id, score AS positive_score FROM e WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, no) <= 5),
n AS (SELECT p.*, e.vec_id AS negative_id, e.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY e.score DESC, e.vec_id, e.no) AS INTEGER) AS rank
  FROM p JOIN e ON p.anchor = e.anchor AND NOT e.same AND 80 * positive_score <= 100 * e.score AND e.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op12_hard_negatives(spark, sf):
    """Five hard negatives for each of the five nearest positives of every hundredth vector, with every seventh label wrong."""
    vectors = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0, label=label)


@query()
def op13_curve_packing(spark, sf):
    """Pack all documents into sequences of 4096 tokens, neighbours on a curve together."""
    return curve_packing.pack(table(spark, sf, "documents"), vocabulary(WORD_VOCABULARY))
