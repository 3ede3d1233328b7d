"""One query per operator over the given tables, with SQL twins where SQL can say the same."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, lang_id, merkle, mixing, ngram_join, passages, repeats, secret_scan, url_filter, vector_dedup, whitening
from .common import ascii_lower, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TREE = ["domain", "lang", "source"]
# depth of a node, its path, its weight; other nodes weigh 1
WEIGHTS = [
    (1, "large", None, None, 0.5),
    (1, "even", None, None, 0.3),
    (1, "odd", None, None, 0.2),
    (2, "large", "en", None, 0.6),
    (2, "large", "de", None, 0.2),
    (2, "large", "fr", None, 0.1),
    (2, "large", "es", None, 0.1),
    (2, "even", "es", None, 3.0),
    (2, "odd", "en", None, 2.0),
    (3, "odd", "en", "src1", 4.0),
]
MIX_SHARE = 1.0
MIX_EPOCHS = 4
MIX_SEED = 7


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(table(spark, sf_dir, "documents"))


def tokenizer(spark: SparkSession) -> bpe.Bpe:
    return bpe.Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = tokenizer(spark).round_trip(docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = secret_scan.scan_secrets(docs, secret_scan.labelled_samples(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP5_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM split
)
SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = lang_id.train(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text")
    return lang_id.predict(rows, profiles).select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP7_SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)
"""


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def domain_of(source: Column) -> Column:
    """The domain of a source: the large one, or by its last digit."""
    odd = F.substring(source, -1, 1).isin("1", "3", "5", "7", "9")
    return F.when(source == "src0", "large").when(odd, "odd").otherwise("even")


def mixture(spark: SparkSession, docs: DataFrame) -> DataFrame:
    weights = spark.createDataFrame(WEIGHTS, "depth int, domain string, lang string, source string, weight double")
    return mixing.mix(docs.withColumn("domain", domain_of(docs["source"])), weights, TREE, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, table(spark, sf_dir, "documents"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_links(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM comp c
"""


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    changed = merkle.leaf(*[ascii_lower(docs[c]) if c == "text" else docs[c] for c in LEAF])
    out = merkle.manifest(docs, LEAF, carry={"changed": F.when(hit, changed)})
    out = out.withColumn("folded_root", merkle.folded(F.col("path"), F.coalesce("changed", "leaf")))
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _manifest_sql(depth: int, upper: int) -> str:
    """The trees level by level, for groups of up to 16^depth leaves and up to 16^upper groups."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    start = " || ".join(field.format(c) for c in LEAF[:-1])
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
    ctes = [
        f"""leaves AS (SELECT doc_id, coalesce('=' || source, '') AS key, sha256({start} || {field.format("text")}) AS leaf,
      CASE WHEN {crc} % 5 = 0 THEN sha256({start} || {field.format(low)}) END AS changed FROM documents)""",
        "n0 AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS idx, leaf AS d, doc_id, leaf, coalesce(changed, leaf) AS acc FROM leaves)",
        "f0 AS (SELECT key, idx, doc_id, leaf, acc, '' AS proof FROM n0)",
    ]

    def climb(n: str, f: str, k: int) -> None:
        ctes.append(f"""{n}r{k} AS (SELECT key, idx // 16 AS run, list(d ORDER BY idx) AS ds, max(c) AS c
      FROM (SELECT key, idx, d, count(*) OVER (PARTITION BY key) AS c FROM {n}{k}) GROUP BY key, idx // 16)""")
        ctes.append(f"{n}{k + 1} AS (SELECT key, run AS idx, CASE WHEN c = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {n}r{k})")
        around = "array_to_string(ds[1:idx % 16], '')", "array_to_string(ds[idx % 16 + 2:], '')"
        more = ", subroot" if n == "u" else ""
        ctes.append(f"""{f}{k + 1} AS (SELECT key, idx // 16 AS idx, doc_id, leaf{more}, CASE WHEN c = 1 THEN acc ELSE sha256({around[0]} || acc || {around[1]}) END AS acc,
      CASE WHEN c = 1 THEN proof ELSE proof || {around[0]} || {around[1]} END AS proof FROM {f}{k} JOIN {n}r{k} USING (key) WHERE idx // 16 = run)""")

    for k in range(depth):
        climb("n", "f", k)
    ctes.append(f"u0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS idx, key AS source_key, d FROM n{depth})")
    ctes.append(f"g0 AS (SELECT '' AS key, u0.idx, doc_id, leaf, d AS subroot, acc, proof FROM f{depth} f JOIN u0 ON f.key = u0.source_key)")
    for k in range(upper):
        climb("u", "g", k)
    body = ",\n".join(ctes)
    return f"WITH {body}\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = d AS verified FROM g{upper} JOIN u{upper} USING (key)"


OP11_SQL = _manifest_sql(5, 3)


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)
), found AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM found)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_repeats": op3_repeats,
    "op4_secrets": op4_secrets,
    "op5_url_rules": op5_url_rules,
    "op6_language": op6_language,
    "op7_exact": op7_exact,
    "op8_main_text": op8_main_text,
    "op9_mix": op9_mix,
    "op10_vectors": op10_vectors,
    "op11_manifest": op11_manifest,
    "op12_passages": op12_passages,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op5_url_rules": OP5_SQL, "op7_exact": OP7_SQL, "op10_vectors": OP10_SQL, "op11_manifest": OP11_SQL, "op12_passages": OP12_SQL}
