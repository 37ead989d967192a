"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.llm import (centroid_clusters, conversation_repair, fingerprints, main_text, mixing, packing, personal_data, quality_rules,
                         secret_scan, simhash, token_counts, token_files, toxicity)
from assayer.llm.common import table

MIX_EPOCHS = 1.0
MIX_SEED = 42
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED = 40, 5, 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark, sf):
    """Every source gets the same share of the output's characters; the output is as large as the input."""
    mixed = mixing.mix_sources(table(spark, sf, "documents"), None, MIX_EPOCHS, MIX_SEED)
    return mixed.withColumn("copy", mixed["copy"].cast("int"))


def op2_pack_sequences(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), 4096, end_id=1)


def op3_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    lexicon = toxicity.learn(toxicity.train_rows(docs, table(spark, sf, "labels")))
    return toxicity.score(docs, lexicon, 0.3)


def op4_simhash_near_duplicates(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_files(spark, sf):
    folder, ids = token_files.tokenize_to_files(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read_files(spark, folder, ids)


def op6_secret_scan(spark, sf):
    return secret_scan.scan(table(spark, sf, "documents"))


def op7_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_version_fingerprints(spark, sf):
    return fingerprints.version_fingerprints(table(spark, sf, "documents"))


def op9_quality_rules(spark, sf):
    found = quality_rules.judged(table(spark, sf, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_main_text(spark, sf):
    return main_text.extract(table(spark, sf, "pages"))


def op11_conversation_repair(spark, sf):
    return conversation_repair.repaired(table(spark, sf, "conversations"))


def op12_centroid_clusters(spark, sf):
    return centroid_clusters.cluster(table(spark, sf, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED)


def op13_personal_data(spark, sf):
    return personal_data.scan(table(spark, sf, "documents"))


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pack_sequences, op3_toxicity, op4_simhash_near_duplicates, op5_token_files,
                                   op6_secret_scan, op7_token_counts, op8_version_fingerprints, op9_quality_rules, op10_main_text,
                                   op11_conversation_repair, op12_centroid_clusters, op13_personal_data, pipeline)}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"



def _clusters_sql() -> str:
    """The rounds one after the other: each assigns every vector (a) and moves the centroids (c)."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = "SELECT r, min(struct_pack(d := {far}, c := c.c)) AS best FROM kept v, c{k} c GROUP BY r"
    moved = """c{n} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
    SELECT a.best.c AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{k} a JOIN kept USING (r), range(1, 65) AS t(i) GROUP BY 1, 2) GROUP BY c) m ON m.c = c.c)"""
    rounds = ",\n".join(f"a{k} AS MATERIALIZED ({near.format(far=far, k=k)})" + (",\n" + moved.format(k=k, n=k + 1) if k < CLUSTER_ROUNDS else "")
                        for k in range(CLUSTER_ROUNDS + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS c, q FROM (
    SELECT sha256('{CLUSTER_SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM kept ORDER BY h, q LIMIT {CLUSTERS})),
{rounds}
SELECT vec_id, a.best.c AS cluster, CAST(a.best.d AS BIGINT) AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{CLUSTER_ROUNDS} a JOIN kept USING (r) JOIN c{CLUSTER_ROUNDS} c ON c.c = a.best.c"""


SQL = {
    "op12_centroid_clusters": _clusters_sql(),
    "op1_mix_sources": f"""
WITH sizes AS (
  SELECT coalesce(source, '') AS s, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY 1),
total AS (
  SELECT CAST(sum(chars) AS BIGINT) AS all_chars, sum(CASE WHEN chars > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ws FROM sizes),
rates AS (
  SELECT s, CASE WHEN chars > 0 THEN {MIX_EPOCHS}::DOUBLE * all_chars * 1.0::DOUBLE / ws / chars ELSE 0.0::DOUBLE END AS rate
  FROM sizes, total),
factorials AS (
  SELECT k, coalesce(sum(ln(k::DOUBLE)) FILTER (WHERE k > 0) OVER (ORDER BY k), 0.0) AS f FROM range(0, 2000) AS t(k)),
cdf AS (
  SELECT s, list(c ORDER BY k) AS cs FROM (
    SELECT s, k, sum(exp(k * ln(rate) - rate - f)) OVER (PARTITION BY s ORDER BY k) AS c
    FROM rates, factorials WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 24)) GROUP BY s),
drawn AS (
  SELECT d.*, cs, (('0x' || substr(md5(concat_ws('|', '{MIX_SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, {mixing.HEX_DIGITS}))::BIGINT::DOUBLE + 0.5)
    / {float(16 ** mixing.HEX_DIGITS)!r}::DOUBLE AS u
  FROM documents d JOIN cdf ON coalesce(d.source, '') = cdf.s),
counted AS (
  SELECT * EXCLUDE (cs, u), unnest(range(0, len(list_filter(cs, lambda c: c < u)))) AS k FROM drawn)
SELECT * EXCLUDE (k), CAST(k AS INTEGER) AS copy,
  md5(concat_ws('|', 'shuffle{MIX_SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(k AS VARCHAR))) AS shuffle_key
FROM counted""",
    "op9_quality_rules": rf"""
WITH worded AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    row_number() OVER () AS r
  FROM documents),
windows AS (
  SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM worded)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, coalesce(source, '') AS h, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM worded LEFT JOIN covered USING (r)),
ruled AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
failed AS (
  SELECT *, base_failed OR 10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines OR word_chars > 25 * n_words AS rule_failed FROM ruled),
tally AS (
  SELECT h, count(*)::DOUBLE AS docs, sum(CASE WHEN rule_failed THEN 1 ELSE 0 END)::DOUBLE AS bad FROM failed GROUP BY h),
total AS (
  SELECT count(*)::DOUBLE AS k, sum(docs) AS n, sum(bad) AS f, sum(docs * docs) AS nn, sum(bad) / sum(docs) AS m FROM tally),
spread AS (
  SELECT round(sum(docs * pow(bad / docs - m, 2)), 6) AS ss FROM tally, total),
moments AS (
  SELECT m, greatest(ss - (k - 1) * m * (1 - m), 0) / nullif(n - nn / n, 0) AS v FROM total, spread),
verdicts AS (
  SELECT h, CASE WHEN coalesce(v, 0) <= 0 THEN m ELSE (bad + greatest(m * (1 - m) / v - 1, 1) * m) / (docs + greatest(m * (1 - m) / v - 1, 1)) END AS shrunk
  FROM tally, moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed OR shrunk >= {quality_rules.BLOCKED_RATE} THEN false WHEN shrunk >= {quality_rules.STRICT_RATE} THEN NOT rule_failed ELSE true END AS kept
FROM failed JOIN verdicts USING (h)""",
}
