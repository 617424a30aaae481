"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, dedup_exact, fingerprints, language, merkle, mixing, near_text, near_vectors, packing, private, quality, repeats, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _documents(spark, sf_dir), language.held_out("doc_id", 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out).select("doc_id", "quality")
    model = quality.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = language.held_out("doc_id", 4, 2)
    found = language.identify(docs, language.fit_dictionaries(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op7_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_dedup(_documents(spark, sf_dir))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(private.find_private(_documents(spark, sf_dir)))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(_documents(spark, sf_dir))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's leaf is folded again as it reads without line ends, for every row whose id has an even checksum."""
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    read = columns | {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    proven = merkle.manifest(_documents(spark, sf_dir), tuple(columns), carried={"read": merkle.leaf(read)}).withColumn("folded_root", merkle.folded(F.col("read"), F.col("path")))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_packing, op4_repeats, op5_quality, op6_language, op7_near_text, op8_near_vectors, op9_token_counts, op10_private, op11_fingerprints, op12_manifest, op13_alignment)}


def _manifest_sql(levels: int = 16, group_levels: int = 8) -> str:
    """Level by level for up to 3 ** ``levels`` leaves a source and 3 ** ``group_levels`` sources. s: what each leaf folds to so far."""
    value = lambda e: f"coalesce(strlen({e}) || ':' || {e}, '-')"
    row = lambda t: f"sha256({value('doc_id::VARCHAR')} || {value('source')} || {value('lang')} || {value('n_chars::VARCHAR')} || {value(t)})"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"
    steps = [
        f"""leaves AS MATERIALIZED (
  SELECT doc_id, source, {row('text')} AS leaf, {row(f"CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS read FROM documents),
placed AS MATERIALIZED (
  SELECT doc_id, leaf, read, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
t0 AS MATERIALIZED (SELECT tree, pos, n, leaf AS h FROM placed),
s0 AS MATERIALIZED (SELECT doc_id, leaf, tree, pos, read AS folded, '' AS proof FROM placed)"""
    ]

    def climb(t: str, s: str, k: int, others: str, key: str) -> None:
        """From level k to k + 1 of the trees ``t`` and the leaves' state ``s``."""
        run, whole = "PARTITION BY tree, pos // 3 ORDER BY pos", f"(n + {3**k - 1}) // {3**k}"
        steps.append(f"""{t}{k}x AS MATERIALIZED (
  SELECT *, {whole} > 1 AS up, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {t}{k}),
{t}{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, any_value(n) AS n, CASE WHEN any_value(up) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {t}{k}x GROUP BY tree, pos // 3),
{s}{k + 1} AS MATERIALIZED (
  SELECT s.doc_id, s.leaf, {others} s.pos // 3 AS pos, CASE WHEN up THEN sha256(a || folded || b) ELSE folded END AS folded, CASE WHEN up THEN proof || a || b ELSE proof END AS proof
  FROM {s}{k} s JOIN {t}{k}x x ON {key} x.pos = s.pos)""")

    for k in range(levels):
        climb("t", "s", k, "s.tree,", "x.tree = s.tree AND")
    steps.append(f"""g0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM t{levels}),
r0 AS MATERIALIZED (SELECT doc_id, leaf, t.h AS subroot, s.tree AS pos, folded, proof FROM s{levels} s JOIN t{levels} t ON t.tree = s.tree)""")
    for k in range(group_levels):
        climb("g", "r", k, "s.subroot,", "")
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM r{group_levels} JOIN g{group_levels} ON true"""


ORACLES = {
    "op12_manifest": _manifest_sql(),
    "op1_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g'))) / greatest(length(text), 1)), 1.0::DOUBLE) AS quality,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place, 3.0::DOUBLE * source_size AS cap FROM sources),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING) - cap))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
marked AS (SELECT *, cap <= level * weight AS is_full FROM levels),
final AS (SELECT level AS final_level FROM marked WHERE NOT is_full ORDER BY cap / weight, place LIMIT 1),
targets AS (SELECT source, source_size, round(CASE WHEN is_full THEN cap ELSE (SELECT final_level FROM final) * weight END, 6) AS target FROM marked),
keyed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(u) / quality, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN epochs + CASE WHEN 2 * (target - epochs * source_size - before) > size THEN 1 ELSE 0 END ELSE 0 END * size)::BIGINT AS taken
FROM keyed""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_repeats": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
starts AS (SELECT doc_id, pos, md5_number(h[pos + 1 : pos + 100]) AS gram FROM (SELECT doc_id, h, unnest(range(greatest(octet_length(h) - 99, 0))) AS pos FROM d)),
firsts AS (SELECT gram, min((doc_id, pos)) AS first FROM starts GROUP BY gram HAVING count(*) > 1),
again AS (SELECT doc_id, pos FROM starts JOIN firsts USING (gram) WHERE (doc_id, pos) <> first),
edges AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS behind FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, octet_length(h) + 1, NULL FROM d)),
left_over AS (SELECT doc_id, string_agg(hex(h[behind + 1 : least(a, octet_length(h))]), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (octet_length(h))::BIGINT AS n_bytes, coalesce(s.removed, 0)::BIGINT AS n_removed, coalesce(s.n, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN left_over USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id""",
    "op7_near_text": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * met.n >= 75 * (p.n + q.n - met.n)),
ends AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT a AS node, a AS other FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON e.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON node = d.doc_id""",
    "op8_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
ends AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT a AS node, a AS other FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON e.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM ends GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN roots ON roots.node = vec_id LEFT JOIN counts ON counts.node = vec_id""",
}
