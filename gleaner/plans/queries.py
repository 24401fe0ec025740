"""The audit's operators over ordinary tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.columns import listed, ratio4, sequence_dhash, severity_rank, shortened, split_of, stripped
from gleaner.operators import image_checks, label_checks, noise
from gleaner.operators.components import components
from gleaner.operators.duplicates import duplicate_members, farthest, group_summary
from gleaner.operators.findings import finding, flattened, score, union_all
from gleaner.operators.similarity import close_hashes, distinct_hashes
from gleaner.operators.tables import file_findings
from gleaner.sources.image_folder import with_derived
from gleaner.sources.scratch import Scratch

DIMENSIONS, BITS, NEAR = 64, 63, 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))


def class_distribution(spark, sf_dir):
    x = label_checks.class_distribution(_classes(spark, sf_dir))
    return x.select("label", "count", "total", ratio4(F.col("count"), F.col("total")).alias("ratio"))


def class_imbalance(spark, sf_dir):
    x = label_checks.class_distribution(_classes(spark, sf_dir)).where(F.col("ratio") < label_checks.MINORITY_RATIO)
    return x.select("label", "count", "total")


def _digests(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


def duplicate_entries(spark, sf_dir):
    return label_checks.repeated(_digests(spark, sf_dir), "digest")


def _copies(spark, sf_dir):
    members = _digests(spark, sf_dir).withColumnRenamed("digest", "component")
    return group_summary(members, "doc_id", "source").where("group_size > 1").withColumnRenamed("component", "digest")


def exact_leakage(spark, sf_dir):
    x = _copies(spark, sf_dir).where(F.size("splits") > 1)
    return x.select("digest", "group_size", F.size("splits").alias("n_splits"), F.concat_ws(",", "splits").alias("splits"))


def within_split_dups(spark, sf_dir):
    x = _copies(spark, sf_dir).where(F.size("splits") == 1)
    return x.select("digest", "group_size", F.element_at("splits", 1).alias("split"))


def missing_entries(spark, sf_dir):
    return label_checks.without(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


def labelled_semi(spark, sf_dir):
    return label_checks.within(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source")


def degenerate_docs(spark, sf_dir):
    n = F.col("n_chars")
    kind = F.when(n == 0, "empty").when(n < 20, "tiny").when(n > 20000, "huge")
    found = image_checks.by_kind(_table(spark, sf_dir, "documents").withColumn("kind", kind), "kind", "doc_id")
    return found.select("kind", "n", F.element_at("files", 1).alias("first_id"), F.element_at("files", -1).alias("last_id"))


def majority_lang(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return image_checks.majority(docs, ("lang",), "doc_id").select(F.col("major_lang").alias("lang"), F.col("major_n").alias("n"))


def lang_outliers(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return image_checks.outliers(docs, ("lang",), "doc_id").select("doc_id", "lang", "major_lang")


def first_label_per_key(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn("lineno", F.col("turn"))
    return noise.first_labels(turns, "conv_id").select("conv_id", "turn", "role")


def _hashed(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", sequence_dhash(F.col("embedding"), DIMENSIONS).alias("dhash"))


def embedding_dhash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("vec_id", "dhash")


def hamming_pairs(spark, sf_dir):
    """Pairs of different hashes, each named by its least vector."""
    hashes = Scratch(spark).keep(distinct_hashes(_hashed(spark, sf_dir), "vec_id", "dhash"))
    pairs = close_hashes(hashes.select("hash"), NEAR, BITS)
    named = pairs.join(hashes.select(F.col("hash").alias("a"), F.col("node").alias("x")), "a").join(hashes.select(F.col("hash").alias("b"), F.col("node").alias("y")), "b")
    return named.select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), "distance")


def _members(spark, sf_dir):
    scratch = Scratch(spark)
    return scratch.keep(duplicate_members(_hashed(spark, sf_dir), scratch, NEAR, "dhash", BITS))


def dup_components(spark, sf_dir):
    return _members(spark, sf_dir).select("vec_id", "component")


def dup_component_spread(spark, sf_dir):
    m, scratch = _members(spark, sf_dir), Scratch(spark)
    sizes = m.groupBy("component").agg(F.count("*").alias("group_size"))
    return sizes.join(farthest(m, scratch), "component").select("component", "group_size", "max_distance")


def linked_parts(spark, sf_dir):
    """Connected components of parts that share an order, over all lines: each part is linked to its order's least."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey is not null and l_partkey is not null")
    scratch = Scratch(spark)
    least = scratch.keep(lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("u")))  # written, so that the join may split a large order
    edges = lines.join(least, "l_orderkey").select("u", F.col("l_partkey").alias("v")).where("u <> v").distinct()
    return components(edges, scratch).select("node", "component")


def split_of_url(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.lower(F.element_at(F.split(F.parse_url(F.col("url"), F.lit("PATH")), "/"), 2)).alias("split"))


def split_of_path(spark, sf_dir):
    """Splits of paths that are made of part names: known names keep, others are 'all'."""
    top = F.element_at(F.array(*[F.lit(x) for x in ("Train", "test", "VAL", "holdout")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rel = F.concat(top, F.lit("/"), F.col("p_name"))
    return _table(spark, sf_dir, "part").select(split_of(rel).alias("split")).groupBy("split").agg(F.count("*").alias("n"))


def pixel_minmax(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.array_min("embedding").cast("double").alias("pmin"), F.array_max("embedding").cast("double").alias("pmax"))


def _findings(spark, sf_dir):
    """Findings over the tables: leaks, copies inside a source, rare classes, odd languages, class shares."""
    copies = _copies(spark, sf_dir)
    leaks, inside = copies.where(F.size("splits") > 1), copies.where(F.size("splits") == 1)
    rare = class_imbalance(spark, sf_dir)
    odd = lang_outliers(spark, sf_dir).groupBy("major_lang").agg(F.count("*").alias("n"))
    shares = class_distribution(spark, sf_dir).agg(F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("count").cast("string")))).alias("parts"))
    return union_all([
        finding(leaks, "error", "cross_split_leakage", F.format_string("copies %s in %d sources", "digest", F.size("splits")), F.col("splits")),
        finding(inside, "warning", "near_duplicates_within_split", F.format_string("copies %s in one source", "digest"), F.col("splits")),
        finding(rare, "warning", "class_imbalance", F.format_string("class %s is rare", "label")),
        finding(odd, "warning", "geometry_mode_inconsistency", F.format_string("%d texts are not in %s", "n", "major_lang")),
        finding(shares, "info", "class_distribution", F.concat(F.lit("shares: "), F.concat_ws(", ", "parts"))),
    ])


def health_score(spark, sf_dir):
    return score(_findings(spark, sf_dir))


def severity_counts(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("severity", "check").agg(F.count("*").alias("n"))


def findings_sorted_topk(spark, sf_dir):
    """The first ten findings in report order (a report's top: the limit is the feature)."""
    x = _findings(spark, sf_dir).select(severity_rank(F.col("severity")).alias("severity_rank"), "check", shortened(F.col("message")).alias("message"), F.concat_ws(", ", F.slice("files", 1, 4)).alias("files"))
    return x.orderBy("severity_rank", "check", "message").limit(10)


def flattened_files(spark, sf_dir):
    """Distinct files named per check."""
    return flattened(_findings(spark, sf_dir)).groupBy("check").agg(F.count("*").alias("n_files"), F.bool_or(F.col("file") == "src0").alias("names_src0"))


def set_intersect(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return labels.where("quality = 1").select("doc_id").intersect(labels.where("toxic = 1").select("doc_id"))


def set_subset(spark, sf_dir):
    """Whether all toxic documents are labelled documents of the corpus."""
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    rest = toxic.subtract(_table(spark, sf_dir, "documents").select("doc_id"))
    return rest.agg((F.count("*") == 0).alias("is_subset"), F.count("*").alias("n_outside"))


def _scanned(spark, sf_dir):
    """Documents as a scan of image files: what lengths and languages say stands for what a decoder would."""
    n, top = F.col("n_chars"), F.when(F.col("lang") == "en", "Train").when(F.col("lang") == "de", "test").otherwise("more")
    ok = n >= 100
    low = F.when(n <= 140, 0).when(n <= 180, 7).when(n > 15000, 255).otherwise(0)
    high = F.when(n <= 140, 0).when(n <= 180, 7).otherwise(255)
    images = _table(spark, sf_dir, "documents").select(
        F.concat(top, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("rel"), ok.alias("ok"), F.when(n < 50, "UnsupportedFormat: short").when(~ok, "CorruptImage: short").alias("error"),
        F.when(n >= 50, ok).alias("decodable"), F.when(n > 8000, 64).otherwise(96).alias("width"), F.lit(96).alias("height"), F.lit("RGB").alias("mode"),
        F.when(ok, low).alias("pmin"), F.when(ok, high).alias("pmax"), F.lit(None).cast("long").alias("dhash"),
    )
    return with_derived(images)


def _joined(findings):
    return findings.withColumn("files", F.concat_ws(",", "files"))


def scan_stats(spark, sf_dir):
    return image_checks.image_stats(_scanned(spark, sf_dir)).withColumn("splits", F.concat_ws(",", "splits"))


def scan_findings(spark, sf_dir):
    """Broken, undecoded, blank and odd files of a scan, with their details."""
    images = _scanned(spark, sf_dir)
    return _joined(image_checks.file_checks(image_checks.summary(images)).unionByName(image_checks.geometry(images)))


def long_findings(spark, sf_dir):
    """The same file by file."""
    return file_findings(_scanned(spark, sf_dir), Scratch(spark)).select("severity", "check", "file")


def near_findings(spark, sf_dir):
    """Groups of near-duplicate vectors, as leaks between classes or repeats inside one."""
    images = _hashed(spark, sf_dir).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("rel"), F.col("label").cast("string").alias("split"), "dhash", F.lit(True).alias("ok"))
    return _joined(image_checks.duplicates(images, Scratch(spark), NEAR))


def entry_findings(spark, sf_dir):
    """Conversations as label rows: one with several turns is labelled twice, a short turn cannot be decoded, one by the system is missing."""
    state = F.when(F.col("role") == "system", "missing").when(F.length("text") < 20, "unreadable").otherwise("usable")
    rows = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("filepath"), state.alias("state"))
    return _joined(label_checks.entry_checks(rows))


def share_findings(spark, sf_dir):
    return label_checks.share_checks(label_checks.class_distribution(_classes(spark, sf_dir))).select("severity", "check", "message")


def finding_lines(spark, sf_dir):
    """Findings as a terminal shows them."""
    return _findings(spark, sf_dir).select("severity", "check", shortened(F.col("message"), 40).alias("message"), listed(F.col("files"), 2, " and %d more").alias("files"))


def trimmed_turns(spark, sf_dir):
    text = stripped(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.cast("binary")).alias("digest"), F.length(text).alias("n"))


def dealt_folds(spark, sf_dir):
    """Stratified folds of the vectors by class."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("filepath"), "label")
    return noise.stratified_folds(rows, "label", "filepath", 3, 7)


def noise_flags(spark, sf_dir):
    """Vectors whose class a cross-validated model contradicts (threshold 0: every disagreement)."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("filepath"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"))
    flags, _ = noise.noise_flags(e, confidence=0.0)
    return flags if flags is not None else spark.createDataFrame([], "filepath string, label string, predicted_label string, confidence double")


_D = "WITH d AS (SELECT doc_id, source, md5(text) AS digest FROM documents), c AS (SELECT digest, count(*) AS group_size, list_sort(list(DISTINCT source)) AS splits FROM d GROUP BY digest HAVING count(*) > 1)"
_L = "WITH l AS (SELECT concat_ws('/', quality, toxic) AS label FROM labels), g AS (SELECT label, count(*) AS count, (SELECT count(*) FROM l) AS total FROM l GROUP BY label)"
_H = (
    "WITH RECURSIVE h AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1::BIGINT << (63 - i) ELSE 0::BIGINT END)) AS BIGINT) AS dhash FROM embeddings), "
    "u AS (SELECT dhash, min(vec_id) AS node, count(*) AS n FROM h GROUP BY dhash), "
    "p AS (SELECT a.dhash AS a, b.dhash AS b, a.node AS x, b.node AS y, CAST(bit_count(xor(a.dhash, b.dhash)) AS INT) AS distance FROM u a JOIN u b ON a.dhash < b.dhash WHERE bit_count(xor(a.dhash, b.dhash)) <= 16), "
    "s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b), "
    "g AS (SELECT u.dhash, least(u.dhash, coalesce(min(r.b), u.dhash)) AS component FROM u LEFT JOIN r ON r.a = u.dhash GROUP BY u.dhash, u.n HAVING u.n > 1 OR count(r.b) > 0), "
    "m AS (SELECT h.vec_id, h.dhash, g.component FROM h JOIN g ON g.dhash = h.dhash)"
)
_F = (
    _D + ", l AS (SELECT concat_ws('/', quality, toxic) AS label FROM labels), g AS (SELECT label, count(*) AS count, (SELECT count(*) FROM l) AS total FROM l GROUP BY label), "
    "j AS (SELECT lang AS major_lang FROM documents GROUP BY lang ORDER BY count(*) DESC, min(doc_id) LIMIT 1), "
    "f AS (SELECT 'error' AS severity, 'cross_split_leakage' AS \"check\", 'copies ' || digest || ' in ' || len(splits) || ' sources' AS message, splits AS files FROM c WHERE len(splits) > 1 "
    "UNION ALL SELECT 'warning', 'near_duplicates_within_split', 'copies ' || digest || ' in one source', splits FROM c WHERE len(splits) = 1 "
    "UNION ALL SELECT 'warning', 'class_imbalance', 'class ' || label || ' is rare', [] FROM g WHERE count / total < 0.05 "
    "UNION ALL SELECT 'warning', 'geometry_mode_inconsistency', count(*) || ' texts are not in ' || major_lang, [] FROM documents, j WHERE lang IS DISTINCT FROM major_lang GROUP BY major_lang "
    "UNION ALL SELECT 'info', 'class_distribution', 'shares: ' || string_agg(label || '=' || count, ', ' ORDER BY label), [] FROM g)"
)

_I = (
    "WITH i AS (SELECT CASE lang WHEN 'en' THEN 'Train' WHEN 'de' THEN 'test' ELSE 'more' END || '/' || doc_id || '.png' AS rel, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'test' ELSE 'all' END AS split, "
    "n_chars >= 100 AS ok, n_chars < 50 AS unknown, CASE WHEN n_chars < 100 THEN NULL WHEN n_chars <= 140 THEN 'all_black' WHEN n_chars <= 180 THEN 'constant' WHEN n_chars > 15000 THEN 'all_white' END AS kind, "
    "CASE WHEN n_chars > 8000 THEN 64 ELSE 96 END AS width FROM documents), "
    "j AS (SELECT width AS major FROM i WHERE ok GROUP BY width ORDER BY count(*) DESC, min(rel) LIMIT 1), o AS (SELECT i.*, major FROM i, j WHERE ok AND width <> major), "
    "k AS (SELECT kind, count(*) AS n, list(rel ORDER BY rel) AS files FROM i WHERE kind IS NOT NULL GROUP BY kind)"
)
_N = (
    _H + ", y AS (SELECT a.component, max(bit_count(xor(a.dhash, b.dhash))) AS far FROM m a JOIN m b ON a.component = b.component GROUP BY a.component), "
    "z AS (SELECT component, count(*) AS n, array_to_string(list_sort(list('v' || vec_id)), ',') AS files, list_sort(list(DISTINCT label::VARCHAR)) AS splits, any_value(far) AS far FROM m JOIN embeddings USING (vec_id) JOIN y USING (component) GROUP BY component)"
)
_E = (
    "WITH p AS (SELECT 'c' || conv_id AS f, count(*) AS n, bool_or(role = 'system') AS missing, bool_or(role IS DISTINCT FROM 'system' AND length(text) < 20) AS unreadable FROM conversations GROUP BY conv_id), "
    "q AS (SELECT 'warning' AS severity, 'duplicate_label_entries' AS \"check\", 'path(s) are labelled more than once.' AS told, f FROM p WHERE n > 1 "
    "UNION ALL SELECT 'error', 'missing_labeled_files', 'labelled file(s) do not exist.', f FROM p WHERE missing UNION ALL SELECT 'warning', 'unreadable_labeled_files', 'labelled file(s) cannot be decoded.', f FROM p WHERE unreadable)"
)

#: Query -> SQL; none for the model, whose optimiser SQL does not have.
ORACLES = {
    "class_distribution": _L + " SELECT label, count, total, CAST(round_even(CAST(count AS DOUBLE) / total, 4) AS DOUBLE) AS ratio FROM g",
    "class_imbalance": _L + " SELECT label, count, total FROM g WHERE count / total < 0.05",
    "duplicate_entries": _D + " SELECT digest, group_size AS n FROM c",
    "exact_leakage": _D + " SELECT digest, group_size, CAST(len(splits) AS INT) AS n_splits, array_to_string(splits, ',') AS splits FROM c WHERE len(splits) > 1",
    "within_split_dups": _D + " SELECT digest, group_size, splits[1] AS split FROM c WHERE len(splits) = 1",
    "missing_entries": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "labelled_semi": "SELECT doc_id, lang, source FROM documents SEMI JOIN labels USING (doc_id)",
    "degenerate_docs": "SELECT kind, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 20 THEN 'tiny' WHEN n_chars > 20000 THEN 'huge' END AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY kind",
    "majority_lang": "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1",
    "lang_outliers": "WITH j AS (SELECT lang AS major_lang FROM documents GROUP BY lang ORDER BY count(*) DESC, min(doc_id) LIMIT 1) SELECT doc_id, lang, major_lang FROM documents, j WHERE lang IS DISTINCT FROM major_lang",
    "first_label_per_key": "SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id",
    "embedding_dhash": _H + " SELECT vec_id, dhash FROM h",
    "hamming_pairs": _H + " SELECT least(x, y) AS vec_a, greatest(x, y) AS vec_b, distance FROM p",
    "dup_components": _H + " SELECT vec_id, component FROM m",
    "dup_component_spread": _H + " SELECT i.component, any_value(i.n) AS group_size, CAST(max(bit_count(xor(a.dhash, b.dhash))) AS INT) AS max_distance FROM (SELECT component, count(*) AS n FROM m GROUP BY component) i JOIN m a USING (component) JOIN m b USING (component) GROUP BY i.component",
    # Labels sink along edges for more rounds than these tables' components are wide.
    "linked_parts": (
        "WITH RECURSIVE l AS (SELECT l_orderkey, l_partkey, min(l_partkey) OVER (PARTITION BY l_orderkey) AS m FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL), "
        "e AS (SELECT DISTINCT l_partkey AS u, m AS v FROM l WHERE l_partkey <> m UNION SELECT DISTINCT m, l_partkey FROM l WHERE l_partkey <> m), "
        "r AS (SELECT DISTINCT u AS node, u AS label, 0 AS i FROM e UNION ALL SELECT node, min(label), i + 1 FROM "
        "(SELECT node, label, i FROM r UNION ALL SELECT e.v, r.label, r.i FROM r JOIN e ON e.u = r.node) WHERE i < 40 GROUP BY node, i) "
        "SELECT node, label AS component FROM r WHERE i = 40"
    ),
    "split_of_url": "SELECT page_id, lower(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[2]) AS split FROM pages",
    "split_of_path": "SELECT split, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'all' END AS split FROM part) GROUP BY split",
    "pixel_minmax": "SELECT vec_id, CAST(list_min(embedding) AS DOUBLE) AS pmin, CAST(list_max(embedding) AS DOUBLE) AS pmax FROM embeddings",
    "health_score": _F + " SELECT CAST(greatest(0, 100 - sum(CASE severity WHEN 'error' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END)) AS INT) AS health_score, count_if(severity = 'error')::BIGINT AS n_errors, count_if(severity = 'warning')::BIGINT AS n_warnings, count_if(severity = 'info')::BIGINT AS n_info FROM f",
    "severity_counts": _F + ' SELECT severity, "check", count(*) AS n FROM f GROUP BY severity, "check"',
    "findings_sorted_topk": _F + " SELECT CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INT) AS severity_rank, \"check\", CASE WHEN length(message) > 90 THEN substr(message, 1, 87) || '...' ELSE message END AS message, array_to_string(files[1:4], ', ') AS files FROM f ORDER BY 1, 2, 3 LIMIT 10",
    "flattened_files": _F + ' SELECT "check", count(DISTINCT file) AS n_files, bool_or(file = \'src0\') AS names_src0 FROM (SELECT "check", unnest(files) AS file FROM f) GROUP BY "check"',
    "scan_stats": _I + " SELECT count(*) AS n_files, count_if(ok)::BIGINT AS n_ok, count_if(NOT ok AND NOT unknown)::BIGINT AS n_corrupt, count_if(kind IS NOT NULL)::BIGINT AS n_degenerate, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM i",
    "scan_findings": (
        _I + " SELECT severity, \"check\", message, files, details FROM (SELECT 'error' AS severity, 'corrupt_files' AS \"check\", count(*) || ' image file(s) cannot be read; a loader would fail on them or skip them silently.' AS message, string_agg(rel, ',' ORDER BY rel) AS files, "
        "to_json({'errors': map(list(rel ORDER BY rel), list('CorruptImage: short' ORDER BY rel))})::VARCHAR AS details, count(*) AS n FROM i WHERE NOT ok AND NOT unknown "
        "UNION ALL SELECT 'info', 'undecoded_images', count(*) || ' image file(s) are of formats that no decoder here reads; they were not checked.', string_agg(rel, ',' ORDER BY rel), '{}', count(*) FROM i WHERE unknown "
        "UNION ALL SELECT 'warning', 'degenerate_images', sum(n)::BIGINT || ' image(s) carry no signal (' || string_agg(n || ' ' || kind, ', ' ORDER BY kind) || ').', array_to_string(list_sort(flatten(list(files))), ','), "
        "to_json({'by_type': map(list(kind ORDER BY kind), list(files ORDER BY kind)), 'hint': 'Black scans are often failed acquisitions, white ones overexposed or empty.'})::VARCHAR, sum(n)::BIGINT FROM k "
        "UNION ALL SELECT 'warning', 'geometry_mode_inconsistency', count(*) || ' image(s) differ from the usual ' || any_value(major) || 'x96, mode RGB; resize or convert them before batching.', string_agg(rel, ',' ORDER BY rel), "
        "to_json({'majority': {'width': any_value(major), 'height': 96, 'mode': 'RGB'}, 'offenders': map(list(rel ORDER BY rel), list({'width': width, 'height': 96, 'mode': 'RGB'} ORDER BY rel))})::VARCHAR, count(*) FROM o) WHERE n > 0"
    ),
    "long_findings": _I + " SELECT 'error' AS severity, 'corrupt_files' AS \"check\", rel AS file FROM i WHERE NOT ok AND NOT unknown UNION ALL SELECT 'info', 'undecoded_images', rel FROM i WHERE unknown UNION ALL SELECT 'warning', 'degenerate_images', rel FROM i WHERE kind IS NOT NULL UNION ALL SELECT 'warning', 'geometry_mode_inconsistency', rel FROM o",
    "near_findings": (
        _N + " SELECT 'error' AS severity, 'cross_split_leakage' AS \"check\", 'Leak: ' || n || ' near-duplicate image(s) lie in several splits [' || array_to_string(splits, ', ') || '] (largest Hamming distance ' || far || '); results measured on them are too good.' AS message, files, "
        "to_json({'splits': splits, 'group_size': n})::VARCHAR AS details FROM z WHERE len(splits) > 1 "
        "UNION ALL SELECT 'warning', 'near_duplicates_within_split', n || ' near-duplicate image(s) inside split ''' || splits[1] || '''; repeats bias training.', files, to_json({'split': splits[1], 'group_size': n})::VARCHAR FROM z WHERE len(splits) = 1"
    ),
    "entry_findings": _E + " SELECT severity, \"check\", count(*) || ' ' || told AS message, string_agg(f, ',' ORDER BY f) AS files, '{}' AS details FROM q GROUP BY severity, \"check\", told",
    "share_findings": (
        _L + " SELECT 'warning' AS severity, 'class_imbalance' AS \"check\", 'class ''' || label || ''': ' || count || ' of ' || total || ' labels (' || printf('%.1f%%', round_even(CAST(count AS DOUBLE) / total * 100, 1)) || '), under 5%; consider stratified sampling, class weights or more data.' AS message FROM g WHERE count / total < 0.05 "
        "UNION ALL SELECT 'info', 'class_distribution', 'Class shares: ' || string_agg(label || '=' || count || ' (' || printf('%.1f%%', round_even(CAST(count AS DOUBLE) / total * 100, 1)) || ')', ', ' ORDER BY label) FROM g"
    ),
    "finding_lines": _F + " SELECT severity, \"check\", CASE WHEN length(message) > 40 THEN substr(message, 1, 37) || '...' ELSE message END AS message, array_to_string(files[1:2], ', ') || CASE WHEN len(files) > 2 THEN ' and ' || (len(files) - 2) || ' more' ELSE '' END AS files FROM f",
    "trimmed_turns": "SELECT conv_id, turn, md5(t) AS digest, CAST(length(t) AS INT) AS n FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}\\x1c-\\x1f]+', ''), '[\\s\\p{Z}\\x1c-\\x1f]+$', '') AS t FROM conversations)",
    "dealt_folds": "SELECT vec_id::VARCHAR AS filepath, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':7'), vec_id::VARCHAR) - 1) % 3 AS INT) AS fold FROM embeddings",
    "set_intersect": "SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1",
    "set_subset": "SELECT count(*) = 0 AS is_subset, count(*) AS n_outside FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM documents)",
}

QUERIES = {f.__name__: f for f in (
    class_distribution, class_imbalance, duplicate_entries, exact_leakage, within_split_dups, missing_entries, labelled_semi, degenerate_docs, majority_lang, lang_outliers, first_label_per_key,
    embedding_dhash, hamming_pairs, dup_components, dup_component_spread, linked_parts, split_of_url, split_of_path, pixel_minmax, health_score, severity_counts, findings_sorted_topk,
    flattened_files, scan_stats, scan_findings, long_findings, near_findings, entry_findings, share_findings, finding_lines, trimmed_turns, dealt_folds, set_intersect, set_subset, noise_flags,
)}
