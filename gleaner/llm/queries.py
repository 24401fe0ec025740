"""The queries of this subpackage and the SQL that some of them can be checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid_kn, license_scan, media_mpeg, minhash, mixing, packing, quality_knn, substring_tree, toxicity_cf, winnow
from gleaner.llm.common import Scratch, id_remainder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = media_mpeg.read_media(media_mpeg.store_media(documents(spark, sf_dir)))
    seek = F.crc32(F.concat_ws(",", F.col("seek_offsets").cast("array<string>")).cast("binary"))
    feature = F.format_string("mp3 frames=%d samples=%d rate=%d seconds=%.6f seek=%08x ok=%s", "frames", "samples", "sample_rate", "duration_s", seek, F.col("checks_ok").cast("string"))
    return x.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(quality_knn.score(docs, quality_knn.fit(docs, labels(spark, sf_dir))), 5, 0)


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_tree.removal_digests(documents(spark, sf_dir), Scratch(spark))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op5_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(toxicity_cf.score(docs, toxicity_cf.fit(docs, labels(spark, sf_dir))), 4, 2)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir), Scratch(spark), keep=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), Scratch(spark))


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), Scratch(spark), size=4)


def op9_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid_kn.identify(docs, langid_kn.fit(docs))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_along(documents(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM t),
v AS (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
x AS (SELECT arg_min(level, source_size / weight) AS level FROM v WHERE level * weight <= 2.0 * source_size),
r AS (SELECT v.source, v.source_size, least(2.0 * v.source_size, x.level * v.weight) AS target FROM v, x),
q AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.target / r.source_size AS rate,
    CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q
"""


OP3_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, p, md5(array_to_string(ws[p : p + 34], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35)),
r AS (SELECT rid, p FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS p FROM r),
words AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT u, v FROM t UNION SELECT r.u, t.v FROM r JOIN t ON t.u = r.v),
c AS (SELECT u, least(u, min(v)) AS m FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id, coalesce(c.m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.u = w.doc_id
"""


def _mixed(column: str, source: str) -> str:
    """CTE bodies that finish 64-bit hashes ``column`` of ``source`` as ``common.mix`` does, into m3."""
    return f"""
m1 AS (SELECT * REPLACE ((xor({column}, {column} >> 30) * 13787848793156543929::UHUGEINT) & 18446744073709551615::UHUGEINT AS {column}) FROM {source}),
m2 AS (SELECT * REPLACE ((xor({column}, {column} >> 27) * 10723151780598845931::UHUGEINT) & 18446744073709551615::UHUGEINT AS {column}) FROM m1),
m3 AS (SELECT * REPLACE (xor({column}, {column} >> 31) AS {column}) FROM m2)"""


def _doubled(step: int, power: int) -> str:
    """A CTE that joins polynomial hashes of ``step`` characters to hashes of twice as many."""
    return f"g{2 * step} AS (SELECT doc_id, k, n, p, (g * {power}::UHUGEINT + lead(g, {step}) OVER (PARTITION BY doc_id, k ORDER BY p)) & 18446744073709551615::UHUGEINT AS g FROM g{step})"


#: Texts and their edited forms as code points (a short text filled up as in ``winnow.fingerprints``), hashes of 16 by
#: doubling, the rightmost minimum of each 32 hashes by their upper halves, and likenesses of the sets.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nt,
    coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM documents WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT doc_id, 0 AS k, t FROM d UNION ALL SELECT doc_id, 1, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) FROM d),
x AS (SELECT doc_id, k, length(t) AS n, t FROM e WHERE t <> ''),
c AS (SELECT doc_id, k, n, unnest(range(1, greatest(n, 16) + 1)) AS p,
    unnest(list_transform(string_split(t, ''), lambda y: unicode(y)::UBIGINT) || CASE WHEN n < 16 THEN list_resize([]::UBIGINT[], 15 - n, 0::UBIGINT) || [n::UBIGINT << 24] ELSE [] END) AS code FROM x),
u AS (SELECT DISTINCT code, (code + 1)::UHUGEINT AS g FROM c),
{_mixed("g", "u").strip()},
g1 AS (SELECT doc_id, k, n, p, m3.g FROM c JOIN m3 USING (code)),
{_doubled(1, winnow._BASE)},
{_doubled(2, winnow._BASE**2 % 2**64)},
{_doubled(4, winnow._BASE**4 % 2**64)},
{_doubled(8, winnow._BASE**8 % 2**64)},
w AS (SELECT * FROM g16 WHERE g IS NOT NULL),
{_mixed("g", "w").strip().replace("m1", "f1").replace("m2", "f2").replace("m3", "f3")},
v AS (SELECT doc_id, k, n, p, (g >> 32)::UBIGINT * 4294967296::UBIGINT + (4294967295 - p)::UBIGINT AS key FROM f3),
z AS (SELECT doc_id, k, n, p, min(key) OVER (PARTITION BY doc_id, k ORDER BY p ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS key FROM v),
f AS (SELECT DISTINCT doc_id, k, key // 4294967296::UBIGINT AS h, 4294967294 - (key % 4294967296::UBIGINT)::BIGINT AS pos FROM z WHERE p <= greatest(1, n - 46)),
s AS (SELECT doc_id, k, count(*) || ':' || md5(string_agg(h::VARCHAR, ',' ORDER BY pos) || ';' || string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS print, count(DISTINCT h) AS size FROM f GROUP BY doc_id, k),
h AS (SELECT DISTINCT doc_id, k, h FROM f),
be AS (SELECT a.doc_id, count(*) AS b FROM h a JOIN h z ON a.doc_id = z.doc_id AND a.h = z.h AND a.k = 0 AND z.k = 1 GROUP BY 1),
bn AS (SELECT a.doc_id, count(*) AS b FROM h a JOIN d ON a.doc_id = d.doc_id AND a.k = 0 JOIN h z ON z.doc_id = d.next_id AND z.k = 0 AND z.h = a.h GROUP BY 1),
r AS (SELECT d.doc_id, d.n AS n_chars, sha256(e.t) AS edited_sha256, coalesce(s0.print, '0:' || md5(';')) AS fingerprint, coalesce(s1.print, '0:' || md5(';')) AS edited_fingerprint,
    coalesce(s0.size, 0) AS a, coalesce(s1.size, 0) AS b, coalesce(sn.size, 0) AS c, coalesce(be.b, 0) AS ab, coalesce(bn.b, 0) AS ac
    FROM d JOIN e ON e.doc_id = d.doc_id AND e.k = 1 LEFT JOIN s s0 ON s0.doc_id = d.doc_id AND s0.k = 0 LEFT JOIN s s1 ON s1.doc_id = d.doc_id AND s1.k = 1
    LEFT JOIN s sn ON sn.doc_id = d.next_id AND sn.k = 0 LEFT JOIN be ON be.doc_id = d.doc_id LEFT JOIN bn ON bn.doc_id = d.doc_id)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    CASE WHEN a + b = 0 THEN 1.0::DOUBLE ELSE ab::DOUBLE / (a + b - ab) END AS near_edited, CASE WHEN a + c = 0 THEN 1.0::DOUBLE ELSE ac::DOUBLE / (a + c - ac) END AS near_next FROM r
"""


def queries() -> dict:
    return {
        "op1_mpeg_media": op1_mpeg_media,
        "op2_quality_knn": op2_quality_knn,
        "op3_suffix_tree_dedup": op3_suffix_tree_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_toxicity_counterfactual": op5_toxicity_counterfactual,
        "op6_source_mixing": op6_source_mixing,
        "op7_certified_packing": op7_certified_packing,
        "op8_minhash_near_duplicates": op8_minhash_near_duplicates,
        "op9_language_kneser_ney": op9_language_kneser_ney,
        "op10_winnowing": op10_winnowing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_tree_dedup": OP3_SQL, "op6_source_mixing": OP6_SQL, "op8_minhash_near_duplicates": OP8_SQL, "op10_winnowing": OP10_SQL}
