"""Queries over the driver's tables, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, exact, langid, merkle, mix, phrases, pieces, shards, shingles, toxicity, vectors, warc, winnow
from weftline.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fold(parts: int) -> F.Column:
    """The part that crc32 of the id's digits deals a document to; null ids go to none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dedup(table(spark, sf_dir, "embeddings"), Scratch(spark, "op1"))


#: What a text could take for the template's own marks.
TRICKY = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.digests(chat.read_back(chat.format_chat(turns.unionByName(extra))))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op3")).drop("copies")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sequence, read back from its shard."""
    out = shards.read(shards.write(table(spark, sf_dir, "documents"), model_path(), Scratch(spark, "op4")))
    return out.select("slot", "shard", "byte_offset", "n_tokens", "doc_ids", F.sha2("tokens", 256).alias("tokens_sha256"))


def op5_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"), Scratch(spark, "op6"))).drop("payload")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model_path(), ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs.where(fold(4) != 2)))
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op11_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.neighbours(table(spark, sf_dir, "documents"))


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is verified as it would be found with a third of its texts lower-cased."""
    text = F.when(fold(3) == 0, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), Scratch(spark, "op12"), found={"text": text})


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES = {
    "op1_vectors": op1_vectors,
    "op2_chat": op2_chat,
    "op3_mix": op3_mix,
    "op4_shards": op4_shards,
    "op5_shingles": op5_shingles,
    "op6_warc": op6_warc,
    "op7_pieces": op7_pieces,
    "op8_toxicity": op8_toxicity,
    "op9_langid": op9_langid,
    "op10_exact": op10_exact,
    "op11_winnow": op11_winnow,
    "op12_manifest": op12_manifest,
    "op13_phrases": op13_phrases,
}

#: The same control strings in the other engine's regular expressions.
_ESC = r"""regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|NEXT\])', '\1\2\\\3', 'g')"""
#: A value of a leaf in the other engine.
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"

ORACLE: dict[str, str] = {
    "op1_vectors": """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component c ON e.vec_id = c.a LEFT JOIN counted k ON e.vec_id = k.a""",
    "op2_chat": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
marked AS (
  SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS opens
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(3 + sum(opens) * 17 + sum(opens * length({_ESC.format("role")})) + sum(length({_ESC.format("text")})) + 6 * (count(*) - sum(opens)) AS BIGINT) AS formatted_chars,
  CAST(sum(opens) AS BIGINT) AS n_blocks
FROM marked GROUP BY conv_id""",
    "op3_mix": f"""
WITH docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(sha256('{mix.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM docs GROUP BY source),
capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, row_number() OVER o AS k,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
    (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS w_left,
    1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM sources WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST)),
level AS (SELECT arg_min((total - full_words) / w_left, k) AS level FROM capped WHERE (total - full_words) / w_left <= most / w),
plan AS (
  SELECT source, source_size, target, base, target - base * source_size AS rest FROM (
    SELECT *, floor(target / source_size) AS base FROM (
      SELECT source, source_size, coalesce(least(most, w * level), most) AS target FROM capped, level))),
kinds AS (SELECT source, sqrt(sqrt(sqrt(size::DOUBLE))) AS prior, sum(size) AS words FROM docs WHERE size > 0 GROUP BY source, prior),
tried AS (
  SELECT k.source, prior, (rest - coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY prior DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(words * prior) OVER (PARTITION BY k.source ORDER BY prior ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level
  FROM kinds k JOIN plan s ON k.source IS NOT DISTINCT FROM s.source),
levels AS (SELECT source, arg_max(level, prior) AS level FROM tried WHERE level * prior <= 1 GROUP BY source),
chances AS (
  SELECT d.*, source_size, target, coalesce(base, 0) AS base, rest,
    CASE WHEN rest > 0 AND size > 0 THEN CASE WHEN level IS NULL THEN 1 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, level * sqrt(sqrt(sqrt(size::DOUBLE))))) END ELSE 0 END AS p
  FROM docs d JOIN plan s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN levels l ON d.source IS NOT DISTINCT FROM l.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / ((1 - u) * p) END AS q FROM chances),
cut AS (
  SELECT *, p >= 1 OR p > 0 AND sum(size) OVER (PARTITION BY source ORDER BY p > 0 DESC, q, name, size) <= rest AS taken FROM q),
gaps AS (SELECT *, rest - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM cut),
near AS (
  SELECT source, arg_min({{'q': q, 'name': name, 'size': size}}, {{'off': abs(size - gap), 'q': q, 'name': name, 'size': size}}) AS x
  FROM gaps WHERE p > 0 AND NOT taken AND abs(size - gap) < gap GROUP BY source),
extra AS (
  SELECT g.source, x FROM gaps g JOIN near n ON g.source IS NOT DISTINCT FROM n.source AND name = x.name AND size = x.size
  GROUP BY g.source, x HAVING abs(count(*) * any_value(size) - any_value(gap)) < any_value(gap))
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN taken OR p > 0 AND x.q = q AND x.name = name AND x.size = size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM gaps e LEFT JOIN extra ON e.source IS NOT DISTINCT FROM extra.source""",
    "op5_shingles": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN component c ON s.doc_id = c.a""",
    "op6_warc": """
WITH paid AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM paid)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - i % 4 * 5)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM ranked""",
    "op10_exact": """
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
kept AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM plain)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM kept""",
    "op12_manifest": f"""
WITH RECURSIVE divided AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
crc AS (
  SELECT doc_id, source, lang, n_chars, text, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]))) AS crc
  FROM documents, divided),
texts AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, '{CAPITALS}', '{SMALL}') ELSE text END AS found,
  {" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM crc),
told AS (SELECT doc_id, lang, sha256(head || {_FIELD.format("text")}) AS leaf, sha256(head || {_FIELD.format("found")}) AS now FROM texts),
leaves AS MATERIALIZED (SELECT doc_id, leaf, now, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM told),
levels AS (
  SELECT tree, 0 AS level, pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS d FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY tree, level, pos // 8, n),
sub AS MATERIALIZED (SELECT tree, d AS subroot, level AS height FROM levels WHERE n = 1),
over_ AS (
  SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, subroot AS d FROM sub
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY level, pos // 8, n),
nodes AS (SELECT * FROM levels UNION ALL SELECT -1, * FROM over_),
beside AS MATERIALIZED (
  SELECT tree, level, pos, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, pos // 8 ORDER BY pos)),
steps AS MATERIALIZED (
  SELECT e.tree, e.pos, b.level AS k, l, r FROM leaves e JOIN beside b ON b.tree = e.tree AND b.pos = e.pos >> (3 * b.level)
  UNION ALL SELECT e.tree, e.pos, height + b.level, l, r FROM leaves e JOIN sub s ON s.tree = e.tree JOIN beside b ON b.tree = -1 AND b.pos = e.tree >> (3 * b.level)),
proofs AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM steps GROUP BY tree, pos),
fold AS (
  SELECT tree, pos, 0 AS k, now AS d FROM leaves
  UNION ALL SELECT f.tree, f.pos, f.k + 1, sha256(l || d || r) FROM fold f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k),
roots AS (SELECT tree, pos, arg_max(d, k) AS folded_root FROM fold GROUP BY tree, pos),
whole AS (SELECT d AS root FROM over_ WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN sub USING (tree) JOIN roots USING (tree, pos) LEFT JOIN proofs USING (tree, pos), whole""",
    "op13_phrases": f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM texts),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
runs AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS t(k)),
counts AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, cut, array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ') AS rest
  FROM counts c, (VALUES (1), (2)) AS t(cut) WHERE cut < c.k),
tried AS (
  SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = first JOIN counts y ON y.lang = c.lang AND y.phrase = rest),
best AS (SELECT lang, k, phrase, a, arg_min({{'l': l, 'r': r, 'score': score}}, {{'score': score, 'cut': cut}}) AS b FROM tried GROUP BY ALL),
inner_ AS (SELECT lang, array_to_string(string_split(phrase, ' ')[cut:cut + 1], ' ') AS phrase, max(f) AS longer FROM counts, (VALUES (1), (2)) AS t(cut) WHERE k = 3 GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.b.score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_ i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, n, CAST(b.score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
