"""Registered queries over the given tables, with their SQL where it can express them."""

import public_tokenizers
from pyspark.sql import functions as F

from ionforge.llm import ann, bpe, exact_dedup, lattice_lm, mixing, packing, prefix_trie, secrets, simhash, substring_dedup, toxicity, url_rules, whitening
from ionforge.llm.common import documents

BPE_FILE = "word_bpe_49k.json"


def op1_bpe(spark, sf_dir):
    path = public_tokenizers.path(BPE_FILE)
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    rows = bpe.decode(encoded.drop("text"), path)
    return rows.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    settings = toxicity.Settings()
    machine = toxicity.fit(docs, documents(spark, sf_dir, "labels"), settings, lambda c: ~toxicity.held_out(c))
    rows = toxicity.score(docs, machine, score_col="score")
    return rows.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= settings.threshold, 1).otherwise(0).alias("predicted"),
    )


def op3_learned_ann(spark, sf_dir):
    return ann.search(documents(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op4_lattice_lm(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = lattice_lm.score(docs, public_tokenizers.path("piece_bpe_32k.model"), ~lattice_lm.held_out("doc_id"))
    return rows.select("doc_id", lattice_lm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_url_filter(spark, sf_dir):
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, url_rules.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "pattern", "verdict")


def op6_mixing(spark, sf_dir):
    rows = mixing.decide(documents(spark, sf_dir))
    return rows.select("doc_id", "source", "lang", "topic", "tokens", F.round("ratio", 6).alias("ratio"), F.round("probability", 6).alias("probability"), "sampled")


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.decide(documents(spark, sf_dir), keep="largest")


def op8_substring_dedup(spark, sf_dir):
    rows = substring_dedup.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark, sf_dir):
    return simhash.resolve(documents(spark, sf_dir))


def op10_secrets(spark, sf_dir):
    rows = secrets.scan(
        documents(spark, sf_dir).select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    base = F.filter("secrets", lambda s: s["kind"] != "random")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op11_whitening(spark, sf_dir):
    rows = whitening.whiten(documents(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_prefix_trie(spark, sf_dir):
    found = prefix_trie.sequences(documents(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.regrown(found)).drop("turn_id")


def op13_best_fit_packing(spark, sf_dir):
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


OP5_SQL = """
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rhost, rpath, rule, verdict) AS (VALUES {address}),
patterns(pattern) AS (VALUES {pattern}),
address AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
), pattern AS (
  SELECT url, max(struct_pack(n := length(pattern), p := pattern)).p AS pattern
  FROM (SELECT DISTINCT url FROM parts) JOIN patterns ON regexp_matches(url, pattern) GROUP BY url
)
SELECT page_id, p.host, p.path, a.rule, m.pattern, coalesce(a.verdict, CASE WHEN m.pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM parts p LEFT JOIN address a ON a.host = p.host AND a.path = p.path LEFT JOIN pattern m ON m.url = p.url
"""


def op5_sql():
    address = ", ".join(f"('{h}', '{p}', '{h}{p}', '{v}')" for h, p, v in url_rules.ADDRESS_RULES)
    return OP5_SQL.format(address=address, pattern=", ".join(f"('{e}')" for e, _ in url_rules.PATTERN_RULES))


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""

OP6_HEAD = r"""
WITH docs AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
    CASE WHEN contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'table'
      WHEN contains(text, '%%%') OR contains(text, '&&&') OR contains(text, '$$$') OR contains(text, '***') OR contains(text, '###') THEN 'noise'
      WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END AS topic
  FROM documents
), cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
w0 AS (SELECT source, lang, topic, tokens / (SELECT sum(tokens) FROM cells) AS share, tokens / (SELECT sum(tokens) FROM cells) AS weight FROM cells)"""
OP6_ROUNDS = 25


def op6_sql():
    """The raking rounds written out one after another."""
    text, at = OP6_HEAD, 0
    for d in mixing.DIMENSIONS:
        text += f",\nt_{d} AS MATERIALIZED (SELECT {d}, x / sum(x) OVER () AS target FROM (SELECT {d}, pow(sum(share), {mixing.TEMPER}) AS x FROM w0 GROUP BY {d}))"
    for _ in range(OP6_ROUNDS):
        for d in mixing.DIMENSIONS:
            text += (f",\nw{at + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, share, weight * target / sum(weight) OVER (PARTITION BY c.{d}) AS weight"
                     f" FROM w{at} c JOIN t_{d} t ON t.{d} IS NOT DISTINCT FROM c.{d})")
            at += 1
    return text + f""",
r AS (SELECT source, lang, topic, weight / share AS ratio, round(weight / share / max(weight / share) OVER (), 9) AS probability FROM w{at})
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(coalesce(ratio, 1), 6) AS ratio, round(coalesce(probability, 1), 6) AS probability,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656 < coalesce(probability, 1) AS sampled
FROM docs d LEFT JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.lang IS NOT DISTINCT FROM d.lang AND r.topic = d.topic
"""


def all_queries():
    """Name: (query, SQL or None)."""
    return {
        "op1_bpe": (op1_bpe, None),
        "op2_toxicity": (op2_toxicity, None),
        "op3_learned_ann": (op3_learned_ann, None),
        "op4_lattice_lm": (op4_lattice_lm, None),
        "op5_url_filter": (op5_url_filter, op5_sql()),
        "op6_mixing": (op6_mixing, op6_sql()),
        "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
        "op8_substring_dedup": (op8_substring_dedup, None),
        "op9_simhash": (op9_simhash, None),
        "op10_secrets": (op10_secrets, None),
        "op11_whitening": (op11_whitening, None),
        "op12_prefix_trie": (op12_prefix_trie, None),
        "op13_best_fit_packing": (op13_best_fit_packing, None),
    }
