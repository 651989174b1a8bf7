"""The registered queries of the operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redress.llm import (
    attention_lm, digest_merge, gam, line_spread, packing, periodic, piece_bpe, pivots, redirects, secrets, simhash,
    spill_align, warc,
)
from redress.llm.common import scratch_path

#: The rules that the url query applies.
RULES = [
    redirects.Rule("net", "/", "block"),
    redirects.Rule("example.net", "/en/", "allow"),
    redirects.Rule("example.com", "/de/", "block"),
    redirects.Rule("org", "/fr/", "allow"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path, every_row=True)
    found = warc.captures(warc.read_records(spark, path))
    return found.select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_page").cast("long")).alias("refers_to"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op5_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_merge.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the length and SHA-256 of what stays of its text."""
    left = line_spread.drop_boilerplate(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digest_rows(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = packing.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack_rows(sized, F.col("n_tokens"))


def op11_spill_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spill_align.link_counts(
        _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path(), digest=True
    )
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return attention_lm.score_texts(_table(spark, sf_dir, "documents"), tokenizer_path(), held_out)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of the documents whose id's CRC-32 h is divisible by
    10, the words from a = g % n on repeat with a period of
    p = 1 + floor((n - a) / (3 + g % 8)), where g = floor(h / 10) and n is the
    number of words.  Null ids and all other texts stay as they are."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = plain.withColumn("w", F.expr(r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0) END"))
    sized = words.withColumn("n", F.expr("size(w)")).withColumn("a", F.expr("CASE WHEN n > 0 THEN (h div 10) % n END"))
    period = sized.withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> w[CAST(if(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return period.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periods(_table(spark, sf_dir, "documents")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    rows = found.withColumn("b", best).withColumn("length", -F.col("b.less"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), "length",
        F.col("b.period").alias("period"), F.expr("length * 1000 div b.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_simhash, op3_pivots, op4_redirects, op5_gam, op6_digest_merge, op7_line_spread, op8_secrets,
    op9_piece_bpe, op10_packing, op11_spill_align, op12_attention_lm, op13_periodic,
)}

_HOST_PATH = """
SELECT page_id, url,
  CASE WHEN contains(url, '://') THEN
    lower(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')) ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN
    regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
FROM pages
"""

_HEAD = "regexp_extract({0}, '(?s)^.*?://[^/?]*')"


def _address_sql(x: str) -> str:
    head = _HEAD.format(x)
    return f"CASE WHEN contains({x}, '://') THEN lower({head}) || substr({x}, length({head}) + 1) ELSE {x} END"


def _attribute_sql(name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    value = " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3))
    return f"replace({value}, '&amp;', '&')"


#: The longest of RULES that fits a host and path.
_RULE = """CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""

#: Aliases by recursion over the edges of canonical links and refreshes in
#: both directions.  Dot parts of paths are not worked out here.
_ALIASES = rf"""
WITH RECURSIVE j AS ({_HOST_PATH}),
p AS (SELECT page_id, html, {_address_sql("regexp_replace(url, '(?s)#.*$', '')")} AS a FROM pages),
tags AS (SELECT a, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM p WHERE a IS NOT NULL),
named AS (
  SELECT a, {_attribute_sql("href")} AS t FROM tags WHERE regexp_matches(tag,
    '(?is)^<link\s(?:.*\s)?rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s/>])')
  UNION ALL
  SELECT a, regexp_extract({_attribute_sql("content")}, '(?is)\burl\s*=\s*["'']?\s*([^"'']*)', 1) FROM tags WHERE regexp_matches(tag,
    '(?is)^<meta\s(?:.*\s)?http-equiv\s*=\s*["'']?\s*refresh\s*["''\s/>]')),
split AS (SELECT a, trim(t, E' \t\n\x0b\x0c\r') AS t, {_HEAD.format("a")} AS head,
  regexp_extract(substr(a, length({_HEAD.format("a")}) + 1), '^[^?]*') AS path FROM named),
whole AS (SELECT a, regexp_replace(CASE
    WHEN t = '' OR starts_with(t, '#') THEN NULL
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR head = '' THEN NULL
    WHEN starts_with(t, '//') THEN regexp_extract(head, '^[^:]*:') || t
    WHEN starts_with(t, '/') THEN head || t
    WHEN starts_with(t, '?') THEN head || path || t
    WHEN contains(path, '/') THEN head || regexp_extract(path, '(?s)^.*/') || t
    ELSE head || '/' || t END, '(?s)#.*$', '') AS v FROM split),
edges AS (SELECT a AS u, {_address_sql("v")} AS v FROM whole WHERE v IS NOT NULL),
ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT DISTINCT u AS a, u AS url FROM ways UNION SELECT reach.a, ways.v FROM reach JOIN ways ON reach.url = ways.u),
nodes AS (SELECT a, {_RULE} AS rule FROM (SELECT a,
    regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?]*') AS host,
    regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?]*([^?]*)', 1) AS path
  FROM reach WHERE contains(url, '://'))),
votes AS (SELECT a, min(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END) AS inherited
  FROM nodes WHERE rule IS NOT NULL GROUP BY a),
d AS (SELECT *, {_RULE} AS rule FROM j)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(inherited, 'allow') END AS verdict
FROM d LEFT JOIN votes ON votes.a = {_address_sql("regexp_replace(d.url, '(?s)#.*$', '')")}
"""

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
    ((instr('0123456789abcdef', substr(h || '0', 1 + CAST(i * 5 // 4 AS INT), 1)) - 1) * 16
      + (instr('0123456789abcdef', substr(h || '0', 2 + CAST(i * 5 // 4 AS INT), 1)) - 1))
    >> CAST(3 - i * 5 % 4 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""",
    "op4_redirects": _ALIASES,
    "op6_digest_merge": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, CAST(first_value(doc_id) OVER w AS BIGINT) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id)
""",
    "op7_line_spread": r"""
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS raw, unnest(range(0, len(lines))) AS pos FROM parts),
t AS (SELECT doc_id, source, raw, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
wide AS (SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first
  FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5),
kept AS (SELECT t.doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text
  FROM t LEFT JOIN wide ON t.line = wide.line
  WHERE wide.first IS NULL OR (wide.first.doc_id = t.doc_id AND wide.first.pos = t.pos)
  GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
}
