"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import byte_bpe, chat, fill_middle, kd_search, lm_score, manifest, mixing, near_dedup, packing, quality, token_counts, toxicity, warc
from colloquy.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n: the folds of the held-out queries."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    model, words = lm_score.train(docs.where(~held_out))
    return lm_score.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, words)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests need a whole conversation in one row; the operator's windows do not."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = materialise(chat.windows(rows, budget=2048, history=256), "chat")
    told = chat.read_back(made).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("w", lambda w: w["targets"])), "")
    return told.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata are languages; at most 5 % of the good documents of each are rejected by its cutoff, with 95 % confidence for all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = materialise(quality.features(docs.select("doc_id", "lang", "text")).drop("text"), "quality-features")
    thresholds = quality.learn(scored, labels, "lang", risk=0.05, doubt=0.05)
    return quality.judge(scored, thresholds, "lang").drop("lang")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), room=1024, end=2)
    return packing.pack(cut, room=1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, learn_from=crc_mod("doc_id", 4) != 2)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", held_out, "text"), model, limit=0.3).drop("text")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    back = byte_bpe.decode_ids(encoded.select("doc_id", "ids"), ranks)
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return back.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1).drop("text")
    text = fill_middle.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document by its id's crc32 is folded with the line ends of its text deleted."""
    fields = lambda text: (*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    text = F.col("text")
    other = F.when(crc_mod("doc_id", 2) == 0, F.translate(text, "\n", "")).otherwise(text)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", manifest.leaf_of(*fields(text)).alias("leaf"), manifest.leaf_of(*fields(other)).alias("found"))
    proven = manifest.manifest(rows, "source", "doc_id")
    reached = manifest.folded(F.col("found"), F.col("proof")).alias("folded_root")
    proven = proven.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), reached)
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_near_dedup, op3_warc, op4_chat_windows, op5_mixing, op6_quality_rules, op7_token_counts, op8_top_k_search, op9_packing, op10_toxicity, op11_byte_bpe, op12_fill_middle, op13_manifest)}


#: DuckDB has no base32, so the digest's 32 signs are read off its 40 hexadecimal ones, five of these at a time.
_BASE32 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, payload_bytes, max(page_id) AS first_id, count(*) AS copies FROM p GROUP BY hex, payload_bytes),
d AS (SELECT p.*, CASE WHEN g.copies > 1 AND g.first_id IS NOT NULL AND (p.page_id IS NULL OR p.page_id < g.first_id) THEN g.first_id END AS refers_to
      FROM p JOIN g USING (hex, payload_bytes))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM d
"""

_TOP_K = """
WITH e AS (
  SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON len(q.v) = len(c.v) AND c.id IS DISTINCT FROM q.id WHERE q.id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""


_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<s>[INST] ' || regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') || ' [/INST] '
  || regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') || '</s>' AS form FROM c),
t AS (SELECT *, ((octet_length(encode(form)) + 3) // 4)::BIGINT AS tokens FROM f),
r AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT conv_id, tokens AS system_tokens, length(form) AS system_chars FROM r WHERE n = 0 AND role = 'system'),
h AS (SELECT r.*, system_tokens, system_chars, greatest(2, 2048 - coalesce(system_tokens, 0) - 256) // 2 AS half
  FROM r LEFT JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
b AS (SELECT *, tokens > half AS alone, (begin + tokens - 1) // half AS slice FROM h),
d AS (SELECT *, 2 * sum(alone::INT) OVER (PARTITION BY conv_id, slice ORDER BY n ROWS UNBOUNDED PRECEDING) - alone::INT AS side FROM b),
spans AS (SELECT conv_id, slice, side, min(n) AS first_n, min(begin) AS first_begin, bool_or(alone) AS alone,
  sum(length(form)) + CASE WHEN min(n) > 0 THEN coalesce(any_value(system_chars), 0) ELSE 0 END AS chars FROM d GROUP BY conv_id, slice, side),
told AS (SELECT p.conv_id, p.first_n, sum(length(d.form)) AS chars FROM spans p JOIN d ON p.conv_id IS NOT DISTINCT FROM d.conv_id
  AND NOT p.alone AND d.n < p.first_n AND p.first_begin - d.begin <= 256 AND NOT (d.n = 0 AND d.system_chars IS NOT NULL) GROUP BY ALL),
z AS (SELECT spans.conv_id, sum(spans.chars + coalesce(told.chars, 0))::BIGINT AS formatted_chars
  FROM spans LEFT JOIN told ON spans.conv_id IS NOT DISTINCT FROM told.conv_id AND spans.first_n = told.first_n GROUP BY spans.conv_id),
g AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss FROM r GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g JOIN z ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(concat_ws(chr(31), 'mix', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
l AS (SELECT *, CASE WHEN size >= 4096 THEN 0.9::DOUBLE WHEN size >= 32 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS liking FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM l GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS tie, [3.0, 1.0, 2.0][((tie) % 3 + 1)::INT]::DOUBLE AS weight,
  (2 * source_size) AS lim, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM s),
o AS (SELECT *, lim::DOUBLE / weight AS ratio,
  (total - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / sum(weight) OVER (ORDER BY lim::DOUBLE / weight, tie ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(lim::DOUBLE, coalesce((SELECT arg_min(level, (ratio, tie)) FROM o WHERE ratio > level) * weight, lim::DOUBLE)) AS target FROM o),
k AS (SELECT source, liking, sum(size)::BIGINT AS size FROM l GROUP BY source, liking),
kt AS (SELECT k.*, t.target, liking * size AS weight, 2 * size AS lim FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
ko AS (SELECT *, CASE WHEN weight > 0 THEN lim::DOUBLE / weight END AS ratio,
  (target - coalesce(sum(lim) OVER (PARTITION BY source ORDER BY CASE WHEN weight > 0 THEN lim::DOUBLE / weight END NULLS FIRST, liking ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / nullif(sum(weight) OVER (PARTITION BY source ORDER BY CASE WHEN weight > 0 THEN lim::DOUBLE / weight END NULLS FIRST, liking ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM kt),
kl AS (SELECT source, arg_min(level, (ratio, liking)) AS level FROM ko WHERE ratio > level GROUP BY source),
km AS (SELECT ko.*, least(2.0::DOUBLE, CASE WHEN size > 0 THEN least(lim::DOUBLE, coalesce(kl.level * weight, lim::DOUBLE)) / size ELSE 0 END) AS m
  FROM ko LEFT JOIN kl ON ko.source IS NOT DISTINCT FROM kl.source),
kp AS (SELECT *, floor(m + 1e-12::DOUBLE)::BIGINT AS sure, greatest(0.0::DOUBLE, m - floor(m + 1e-12::DOUBLE)) AS p FROM km),
rest AS (SELECT source, any_value(target) - sum(sure * size) AS rest FROM kp GROUP BY source),
q AS (SELECT l.*, t.source_size, t.target, kp.sure, rest.rest,
    CASE WHEN kp.p > 1e-12::DOUBLE AND l.size > 0 THEN (l.u / (1 - l.u)) / (kp.p / (1 - kp.p)) END AS q
  FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source JOIN kp ON l.source IS NOT DISTINCT FROM kp.source AND l.liking = kp.liking
  JOIN rest ON l.source IS NOT DISTINCT FROM rest.source),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, size, u ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target,
  (size * (sure + CASE WHEN q IS NOT NULL AND upto - size < rest AND upto - rest <= rest - upto + size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


_GRID = ", ".join(map(str, quality.GRID))
_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
ws AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM ws WHERE len(w) >= 5),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i+4], ' ')) AS times FROM places),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 5)) AS p FROM win WHERE times > 1) GROUP BY rid),
c AS (SELECT ws.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_distinct(w)) AS n_distinct,
  length(t) - length(replace(t, '!', '')) AS shouts, len(regexp_extract_all(t, '\p{{Lu}}')) AS capitals,
  length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines
  FROM ws LEFT JOIN rep ON ws.rid = rep.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  greatest(n_symbols / greatest(n_words, 1)::DOUBLE / 0.3::DOUBLE, shouts / greatest(n_words, 1)::DOUBLE / 0.3::DOUBLE,
    capitals / greatest(word_chars, 1)::DOUBLE / 0.4::DOUBLE, n_repeat_words / greatest(n_words, 1)::DOUBLE / 0.2::DOUBLE,
    n_dup_lines / n_lines::DOUBLE / 0.3::DOUBLE,
    CASE WHEN n_words >= 50 THEN 1 - n_distinct / greatest(n_words, 1)::DOUBLE ELSE 0 END / 0.8::DOUBLE) AS badness FROM c),
g AS (SELECT doc_id, (min(quality) = 1)::INT AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT f.lang, badness, good FROM f JOIN g ON f.doc_id = g.doc_id WHERE NOT base_failed),
t AS (SELECT lang, cut, sum(good) AS n_good, sum(CASE WHEN badness > cut THEN good ELSE 0 END)::BIGINT AS k,
  sum(CASE WHEN badness > cut THEN 1 - good ELSE 0 END) AS poor
  FROM h, (SELECT unnest([{_GRID}])::DOUBLE AS cut) GROUP BY lang, cut),
p AS (SELECT *, CASE WHEN k >= n_good * 0.05 THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(k + 1), lambda j:
  exp((CASE WHEN j = 0 THEN 0 ELSE lgamma(n_good + 1.0) - lgamma(j + 1.0) - lgamma(n_good - j + 1.0) END)
    + j * ln(0.05::DOUBLE) + (n_good - j) * ln(0.95::DOUBLE)))) END AS tail FROM t),
a AS (SELECT lang, arg_max(cut, (poor - k, cut)) AS cut FROM p
  WHERE tail <= 0.05 / (len([{_GRID}]) * (SELECT greatest(1, count(*)) FROM (SELECT DISTINCT lang FROM h))) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, badness,
  NOT base_failed AND NOT coalesce(badness > cut, false) AS kept
FROM f LEFT JOIN a ON f.lang IS NOT DISTINCT FROM a.lang
"""


_FILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

#: crc32 bit by bit: DuckDB has no such function. The trees are climbed level by level, then every leaf is folded up.
_MANIFEST = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *,
    (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1))))) % 2 = 0 AS other FROM documents),
e AS (SELECT rid, doc_id, source, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
    CASE WHEN other THEN replace(text, chr(10), '') ELSE text END AS told FROM d),
l AS (SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(told) || ':' || told, '-')) AS found FROM e),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM p
  UNION ALL SELECT g, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 3),
top AS (
  SELECT 0 AS level, g AS pos, count(*) OVER () AS n, h FROM up WHERE n = 1
  UNION ALL SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3),
around AS (
  SELECT a.g, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM up a LEFT JOIN up b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos WHERE a.n > 1 GROUP BY ALL),
above AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM top a LEFT JOIN top b ON a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT p.rid, a.level, a.l, a.r FROM p JOIN around a ON a.g = p.g AND a.pos = p.pos // (3 ** a.level)::BIGINT
  UNION ALL SELECT p.rid, 100 + a.level, a.l, a.r FROM p JOIN above a ON a.pos = p.g // (3 ** a.level)::BIGINT),
ways AS (SELECT rid, list({'l': l, 'r': r} ORDER BY level) AS s, string_agg(l || r, '' ORDER BY level) AS beside FROM steps GROUP BY rid),
fold AS (
  SELECT p.rid, 1 AS k, found AS h FROM p
  UNION ALL SELECT f.rid, k + 1, sha256(s[k].l || h || s[k].r) FROM fold f JOIN ways w ON f.rid = w.rid WHERE k <= len(s)),
done AS (SELECT rid, arg_max(h, k) AS folded FROM fold GROUP BY rid)
SELECT p.doc_id, leaf, u.h AS subroot, t.h AS root, sha256(coalesce(beside, '')) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM p JOIN done ON p.rid = done.rid LEFT JOIN ways w ON p.rid = w.rid JOIN up u ON u.g = p.g AND u.n = 1 JOIN top t ON t.n = 1
"""


def statements() -> dict[str, str]:
    return {"op3_warc": _BASE32, "op4_chat_windows": _CHAT, "op5_mixing": _MIX, "op6_quality_rules": _QUALITY, "op8_top_k_search": _TOP_K, "op12_fill_middle": _FILL, "op13_manifest": _MANIFEST}
