"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import table
from loomdex.llm.decontaminate import find_contamination
from loomdex.llm.exact_dedup import exact_dedup
from loomdex.llm.language_id import identify_language
from loomdex.llm.minhash_tensor import remove_near_copies
from loomdex.llm.ngram_join import JaccardSettings, join_similar
from loomdex.llm.piece_encoding import encode_pieces
from loomdex.llm.quality import score_quality
from loomdex.llm.sharding import shard_rows
from loomdex.llm.spelling import spelling_variants
from loomdex.llm.suffix_dedup import remove_repeats
from loomdex.llm.url_filter import judge_urls
from loomdex.llm.warc import archive_and_read
from loomdex.llm.whitening import whiten

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH n AS (SELECT doc_id, sha256({ASCII_LOWER}) AS text_sha256, {ASCII_LOWER} AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY low)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g ON n.low = g.low""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


@query("""
WITH bits AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
              FROM (SELECT unnest(range(256)) AS b)),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
  md5('loomdex:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents, tab),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id, text_crc32, size) * 2 - 1)::DOUBLE
             / (count(*) OVER (PARTITION BY source) * 2)::DOUBLE AS place FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY place, source NULLS FIRST, k, doc_id, text_crc32, size) - 1 AS i,
             count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((i * 40) // n)::INT AS shard,
       i - ((i * 40) // n * n + 39) // 40 AS slot, NULL::INT AS grown_shard, source FROM o""")
def op10_proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), n_shards=40)


# Aliases in SQL: absolute links only, which is the common form; the tests compare
# relative ones with a brute-force version.
@query("""
WITH RECURSIVE
links AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?i)\\brel\\s*=\\s*[''"]?canonical\\b') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*[''"]?([^''">\\s]+)', 1)
                   WHEN regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*[''"]?refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*[''"]?([^''">\\s]+)', 1) END AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages)),
addr(url, address, host, path) AS (
  SELECT url, CASE WHEN h <> '' THEN h || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract(url, '://[^?#]*(\\?[^#]*)', 1) END, h, p
  FROM (SELECT url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS p
        FROM (SELECT url FROM pages UNION SELECT target FROM links))),
edges AS (
  SELECT a.address AS u, b.address AS v FROM links l JOIN addr a ON a.url = l.url JOIN addr b ON b.url = l.target
  WHERE a.address IS NOT NULL AND b.address IS NOT NULL),
ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(s, x) AS (SELECT u, u FROM ways UNION SELECT r.s, w.v FROM reach r JOIN ways w ON w.u = r.x),
ruled AS (
  SELECT url, address, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM addr),
spread AS (
  SELECT r.s AS address FROM reach r JOIN ruled k ON k.address = r.x GROUP BY r.s
  HAVING bool_or(k.rule IN ('net/', 'example.com/de/')) AND NOT bool_or(coalesce(k.rule IN ('example.net/en/', 'org/fr/'), false)))
SELECT p.page_id, k.host, k.path, k.rule,
  CASE WHEN k.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN k.rule IS NOT NULL THEN 'allow'
       WHEN k.address IN (SELECT address FROM spread) THEN 'block' ELSE 'allow' END AS verdict, k.address
FROM pages p JOIN ruled k ON k.url IS NOT DISTINCT FROM p.url""")
def op7_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query()
def op2_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query()
def op5_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM m""")
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


DECONTAMINATION_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
)


@query(f"""
WITH d AS (SELECT doc_id, {DECONTAMINATION_WORDS} AS w FROM documents),
b AS (SELECT item_id, {DECONTAMINATION_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
              array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.gram = dw.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""")
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op1_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"), JaccardSettings(width=4, threshold=Fraction(85, 100))).drop("text_hash")


@query()
def op8_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# One letter deleted at the same place from two words of one length: one replacement.
@query("""
WITH RECURSIVE
bits AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
         FROM (SELECT unnest(range(256)) AS b)),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(coalesce(doc_id::VARCHAR, '') || ':' || run), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM runs, tab),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  GROUP BY word HAVING sum(n) >= 2 AND length(word) >= 7),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN w ON w.word = c.cut
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN w ON w.word = c.cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
f AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form,
             CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n FROM w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
last AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, last.root FROM f JOIN last ON last.word = f.word""")
def op11_spelling_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_near_copies(table(spark, sf_dir, "documents")).drop("text_hash")
