"""The queries of this package on the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.sources.tables import table

QUERIES, ORACLES = {}, {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]), shingle=3, similarity=(85, 100))


_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t-\\r]+'), lambda x: x <> '')"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets of DuckDB lists, links by counting shared shingles, and the
#: smallest id reachable by a recursive walk.
NEAR_DUPLICATES_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, {words} AS w FROM {docs}
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING {den} * count(*) >= {num} * (any_value(x.n) + any_value(y.n) - count(*))
), walk AS (
  SELECT doc_id AS a, doc_id AS b FROM {docs}
  UNION
  SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a
), roots AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN roots ON sets.doc_id = roots.doc_id
"""


def near_duplicates_sql(docs: str, k: int, num: int, den: int) -> str:
    text = _WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))
    return NEAR_DUPLICATES_SQL.format(words=text, docs=docs, k=k, num=num, den=den)


ORACLES["op1_minhash_near_dedup"] = near_duplicates_sql("documents", 3, 85, 100)


#: Fixed values of the query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages", ["page_id", "url"]), rules)


ORACLES["op5_url_filter"] = """
WITH rules(h, p, v) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
split AS (SELECT page_id, {lower} AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM hosts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM (SELECT s.*, (SELECT arg_max({{'rule': h || p, 'v': v}}, length(h || p)) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM split s)
""".format(rules=", ".join(str(r) for r in URL_RULES), lower=_ASCII_LOWER.format("raw"))


@_query
def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


ORACLES["op6_chat_perspectives"] = """
WITH said AS (
  SELECT DISTINCT conv_id, turn, turn // 64 AS segment, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
pieces AS (
  SELECT s.*, p.perspective, coalesce(role = perspective, false) AS own,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM said s LEFT JOIN speakers p ON s.conv_id = p.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn, role, text) AS upto FROM pieces
)
SELECT conv_id, perspective, segment, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || upto::BIGINT, ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask,
  count(*)::BIGINT AS n_messages, coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_target_chars
FROM placed GROUP BY conv_id, perspective, segment
"""


@_query
def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


#: The same bisections as recursive steps, and the same order of every source.
MIXING_SQL = """
WITH RECURSIVE counted AS (
  SELECT doc_id, source, len({words})::BIGINT AS n_tokens,
    ('0x' || substr(md5('0:' || source || ':' || doc_id), 1, 8))::BIGINT AS draw FROM {docs}
), totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY source),
live AS (SELECT *, tokens / (SELECT sum(tokens) FROM totals) AS p, (SELECT sum(tokens) FROM totals)::BIGINT AS budget,
  ln((SELECT count(*) FROM totals WHERE tokens > 0)) AS most FROM totals WHERE tokens > 0),
by_entropy AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN fits THEN mid ELSE lo END, CASE WHEN fits THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid, (SELECT -sum(w / z * ln(w / z)) >= 0.95 * any_value(most) FROM (
      SELECT pow(p, (lo + hi) / 2) AS w, sum(pow(p, (lo + hi) / 2)) OVER () AS z, most FROM live)) AS fits FROM by_entropy WHERE k < 40)
), by_repeats AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(w / z * budget / tokens) > 4.0 FROM (
      SELECT pow(p, (lo + hi) / 2) AS w, sum(pow(p, (lo + hi) / 2)) OVER () AS z, budget, tokens FROM live)) AS over FROM by_repeats WHERE k < 40)
), exponent AS (
  SELECT greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) >= 0.95 * any_value(most) FROM live) THEN 1.0 ELSE (SELECT lo FROM by_entropy WHERE k = 40) END,
    CASE WHEN (SELECT max(budget / (SELECT count(*) FROM live) / tokens) <= 4.0 FROM live) THEN 0.0 ELSE (SELECT hi FROM by_repeats WHERE k = 40) END) AS a
), weights AS (
  SELECT source, tokens, budget, round(pow(p, a) / sum(pow(p, a)) OVER () * 1000000000000000)::HUGEINT AS weight FROM live, exponent
), due AS (
  SELECT *, weight * budget // sum(weight) OVER () AS whole, weight * budget % sum(weight) OVER () AS rest FROM weights
), shared AS (
  SELECT source, budget, (whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= budget - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS q FROM due
), quotas AS (
  SELECT t.source, t.tokens, coalesce(q, 0) AS quota,
    greatest(1, ceil(coalesce(budget, 0) / 1048576))::BIGINT AS blocks FROM totals t LEFT JOIN shared w ON t.source = w.source
), placed AS (
  SELECT c.*, tokens, quota, blocks, coalesce(sum(n_tokens) OVER (PARTITION BY c.source ORDER BY draw % 4096, draw, doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot
  FROM counted c JOIN quotas q ON c.source = q.source
), reads AS (
  SELECT *, unnest(range(0, CASE WHEN tokens = 0 THEN 1 ELSE ceil((quota - spot) / tokens) END::BIGINT)) AS copy FROM placed
)
SELECT doc_id, source, n_tokens, copy::BIGINT AS copy,
  CASE WHEN quota > 0 THEN least(floor((spot + copy * tokens) / quota * blocks), blocks - 1) ELSE 0 END::BIGINT AS block,
  ('0x' || substr(md5('1:' || source || ':' || doc_id || ':' || copy), 1, 8))::BIGINT AS place
FROM reads
"""
ORACLES["op8_temperature_mixing"] = MIXING_SQL.format(words=_WORDS.format("coalesce(text, '')"), docs="documents")


@_query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.secrets import scan_secrets, span_digest

    return span_digest(scan_secrets(table(spark, sf_dir, "documents", ["doc_id", "text"])))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]), byte_bpe())


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm import fm

    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    return fm.score(docs, fm.train(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm import rules

    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    learnt = rules.learn_rules(rules.text_statistics(docs), table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    judged = rules.apply_rules(rules.text_statistics(docs), learnt)
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "rule")


@_query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))


#: All pairs of a label by their cosine, and the smallest id reachable.
ORACLES["op7_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), walk AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT walk.a, pairs.b FROM walk JOIN pairs ON walk.b = pairs.a
), roots AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN roots ON vec_id = roots.a LEFT JOIN links ON vec_id = links.a
"""


@_query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm import html_extract

    pages = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return html_extract.extract_text(pages, html_extract.train(pages))


def multi_bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@_query
def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.bpe import decode_documents, encode_documents

    ranks, pattern = multi_bpe()
    ids = encode_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]), ranks, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode_documents(ids, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                               F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm import merkle

    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "lang", "n_chars", "text"])
    tampered = merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered)
    rows = merkle.manifest(docs, docs.columns, "lang", "doc_id", {"doc_id": F.col("doc_id"), "altered": altered})
    return merkle.verified(rows, F.coalesce("altered", "leaf")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: CRC-32 bit by bit, all levels by recursion, and a walk from each leaf upward.
ORACLES["op12_merkle_manifest"] = """
WITH RECURSIVE given AS (SELECT row_number() OVER () AS r, * FROM documents),
sums AS (
  SELECT r, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM given
), hashed AS (
  SELECT given.r, doc_id, lang, {leaf} AS leaf, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN {tampered} ELSE {leaf} END AS offered
  FROM given JOIN sums ON given.r = sums.r
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2
), tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, lang FROM nodes WHERE n = 1
), over AS (
  SELECT level, i, n, h FROM tops
  UNION ALL
  SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM over WHERE n > 1 GROUP BY level, i // 2
), climb AS (
  SELECT r, lang, 0 AS level, i, n, '' AS proof, offered AS h FROM leaves
  UNION ALL
  SELECT c.r, c.lang, c.level + 1, c.i // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
    sha256(CASE WHEN c.i % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END)
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1
), ascend AS (
  SELECT c.r, t.h AS subroot, 0 AS level, t.i, t.n, c.proof, c.h FROM climb c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.r, c.subroot, c.level + 1, c.i // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
    sha256(CASE WHEN c.i % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END)
  FROM ascend c LEFT JOIN over s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, a.h AS folded_root, a.h = root.h AS verified
FROM leaves JOIN ascend a ON leaves.r = a.r AND a.n = 1, (SELECT h FROM over WHERE n = 1) root
""".format(**{name: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n, "text")) + ")"
              for name, n in (("leaf", "n_chars"), ("tampered", "(n_chars + 1)"))})


def _with_repeats(docs: DataFrame) -> DataFrame:
    """The contract's repeats: in one of ten documents the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumns({"_w": F.when(h % 10 == 0, words), "_g": F.floor(h / 10)}).withColumn("_n", F.size("_w"))
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    docs = docs.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    again = F.transform(F.sequence(F.col("_a"), F.col("_n") - 1), lambda i: F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    repeated = F.array_join(F.concat(F.slice("_w", 1, F.col("_a")), again), " ")
    return docs.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.llm.runs import detect_runs

    found = detect_runs(_with_repeats(table(spark, sf_dir, "documents", ["doc_id", "text"])))
    rank = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumns({"best": F.array_max(rank)["run"], "lines": F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))})
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
