"""The registered queries of this subpackage: thin adapters from an operator's own output to its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embdedup, extract, idfiles, merkle, mixing, pieces, secrets, sharding, simhash, topk, toxicity, trie, warc
from .common import table

#: A document is rejected as toxic from this score on.
TOXIC = 0.3


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> F.Column:
    """Rows that nothing is learned from; one without an id has no remainder and isn't one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.audit(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_mixing,
        op3_html_extraction,
        op4_sentencepiece,
        op5_token_id_files,
        op6_warc,
        op7_embedding_near_dedup,
        op8_secret_scan,
        op9_exact_top_k,
        op10_simhash_near_dedup,
        op11_sharding,
        op12_merkle_manifest,
        op13_conversation_trie,
    )
}

_MIX = mixing.Mix()

#: Water-filling in closed form: by cap per weight, the sources that come first are clamped as long as the level of the rest reaches them.
_OP2 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('{_MIX.seed}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM d GROUP BY source),
s1 AS (SELECT *, {list(_MIX.weights)}[(r % {len(_MIX.weights)} + 1)::INT]::DOUBLE AS w, {_MIX.max_epochs} * source_size::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / w, r) AS o FROM s1),
s3 AS (SELECT *, ({_MIX.share} * (SELECT sum(source_size) FROM s1) - coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
lv AS (SELECT min_by(level, o) AS level FROM s3 WHERE cap > w * level), s AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT level FROM lv), cap)) AS target FROM s3),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s), q AS (SELECT *, round(target)::BIGINT - whole * source_size AS extra FROM p),
c AS (SELECT d.doc_id, d.size, q.*, sum(size) OVER (PARTITION BY q.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM c"""

_BASE32 = "list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (substr(bits, (i * 5 + 1)::BIGINT, 5)::BIT::INT)::INT]), 'string_agg', '')"
_OP6 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', x[(i + 1)::BIGINT])]), 'string_agg', '') AS bits FROM g)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b"""

_GOOD = "len(e) > 0 AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR isnan(x) OR isinf(x)))"
_OP7 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), ok AS (SELECT * FROM v WHERE {_GOOD} AND list_bool_or(list_transform(e, lambda x: x <> 0)) AND label IS NOT NULL),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.w, r.root FROM reach r JOIN l ON l.u = r.u), c AS (SELECT u AS vec_id, min(root) AS component_id FROM reach GROUP BY u), n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

_OP9 = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), z AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * x)) AS z FROM v WHERE {_GOOD}),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.z, x.z)::BIGINT AS score FROM z q JOIN z x ON q.vec_id <> x.vec_id AND len(q.z) = len(x.z) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

#: CRC-32 over a list of bytes (b), by the table of its reversed polynomial.
_CRC_TABLE = "ct AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END) AS v FROM (SELECT range::BIGINT AS i FROM range(256))))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295::BIGINT)"
_DECIMAL = "list_transform(string_split(({c})::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
_BYTES = "list_transform(range(strlen({t})), lambda i: (16 * instr('0123456789ABCDEF', hx[2 * i + 1]) + instr('0123456789ABCDEF', hx[2 * i + 2]) - 17)::BIGINT)"

_K = sharding.Shards()
#: The search is a recursion over (low, high, shard, place): a step moves the greedy cut on by one shard, or halves the range of capacities.
_OP11 = f"""WITH RECURSIVE {_CRC_TABLE}, d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT + {_K.row_bytes} AS size FROM documents),
g0 AS (SELECT t, sum(size)::BIGINT AS bytes, min(doc_id) AS first FROM d GROUP BY t), tot AS (SELECT sum(bytes)::BIGINT AS total, max(bytes) AS largest FROM g0),
g AS MATERIALIZED (SELECT t, (sum(bytes) OVER (ORDER BY CASE WHEN bytes >= floor({_K.large} * total / {_K.count}) THEN -bytes ELSE 0 END, first NULLS LAST, sha256(t) ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM g0, tot),
p AS MATERIALIZED (SELECT upto FROM g UNION ALL SELECT 0), w AS (SELECT total, greatest(largest, (total + {_K.count} - 1) // {_K.count}) AS low, total AS high, 0::BIGINT AS k, 0::BIGINT AS spot FROM tot
UNION ALL SELECT total, CASE WHEN n < total AND k + 1 = {_K.count} THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN n >= total THEN (low + high) // 2 ELSE high END, CASE WHEN n >= total OR k + 1 = {_K.count} THEN 0 ELSE k + 1 END, CASE WHEN n >= total OR k + 1 = {_K.count} THEN 0 ELSE n END
FROM (SELECT w.*, (SELECT max(upto) FROM p WHERE upto <= w.spot + (w.low + w.high) // 2) AS n FROM w WHERE w.low < w.high)),
cap AS MATERIALIZED (SELECT total, min(high) AS cap FROM w GROUP BY total), e AS (SELECT {_K.count}::BIGINT AS k, total AS spot, cap, total FROM cap
UNION ALL SELECT k - 1, (SELECT min(upto) FROM p WHERE upto >= e.spot - e.cap), cap, total FROM e WHERE k > 1), early AS MATERIALIZED (SELECT k - 1 AS k, spot FROM e),
c AS (SELECT 0::BIGINT AS k, 0::BIGINT AS spot, cap, total FROM cap UNION ALL SELECT k, least(greatest(CASE WHEN near <= spot OR 2 * (total - spot) > (near + far - 2 * spot) * rest THEN far ELSE near END, e_spot), most), cap, total
FROM (SELECT c.k + 1 AS k, c.spot, c.cap, c.total, {_K.count} - c.k AS rest, early.spot AS e_spot, (SELECT max(upto) FROM p WHERE upto <= c.spot + (c.total - c.spot) // ({_K.count} - c.k)) AS near, coalesce((SELECT min(upto) FROM p WHERE upto > c.spot + (c.total - c.spot) // ({_K.count} - c.k)), c.total) AS far, (SELECT max(upto) FROM p WHERE upto <= c.spot + c.cap) AS most
FROM c JOIN early ON early.k = c.k + 1 WHERE c.k + 1 < {_K.count})), s AS MATERIALIZED (SELECT g.t, g.upto, (SELECT count(*) FROM c WHERE c.k > 0 AND c.spot < g.upto)::INT AS shard, tab, string_split(hex(g.t), '') AS hx FROM g, ct),
z AS MATERIALIZED (SELECT t, upto, shard, {_CRC.format(b=_BYTES.format(t="t"))} AS crc FROM s)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM d JOIN z USING (t)"""

_VALUE = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c=c) for c in merkle.COLUMNS) + ")"
#: Nodes of all levels of both kinds of tree; a leaf's siblings are looked up level by level, and folded likewise.
_OP12 = f"""WITH RECURSIVE {_CRC_TABLE}, d AS MATERIALIZED (SELECT *, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} AS claimed, coalesce({_CRC.format(b=_DECIMAL.format(c="doc_id"))} % 7 = 0, false) AS tampered FROM documents, ct),
l AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, leaf, CASE WHEN tampered THEN claimed ELSE leaf END AS other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS level, pos, leaf AS h, n FROM l UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
tn AS MATERIALIZED (SELECT * FROM t), top AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM tn WHERE n = 1),
u AS (SELECT 0 AS level, pos, h, n FROM top UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n), un AS MATERIALIZED (SELECT * FROM u),
way AS MATERIALIZED (SELECT l.r, b.level, x.h AS sib, (l.pos >> b.level) % 2 AS side FROM l JOIN tn b ON b.lang IS NOT DISTINCT FROM l.lang AND b.pos = l.pos >> b.level AND b.n > 1 LEFT JOIN tn x ON x.lang IS NOT DISTINCT FROM l.lang AND x.level = b.level AND x.pos = xor(b.pos, 1)
UNION ALL SELECT l.r, 1000 + b.level, x.h, (q.pos >> b.level) % 2 FROM l JOIN top q ON q.lang IS NOT DISTINCT FROM l.lang JOIN un b ON b.pos = q.pos >> b.level AND b.n > 1 LEFT JOIN un x ON x.level = b.level AND x.pos = xor(b.pos, 1)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS i FROM way),
f AS (SELECT r, other AS h, 0::BIGINT AS i FROM l UNION ALL SELECT f.r, sha256(CASE WHEN o.sib IS NULL THEN f.h WHEN o.side = 1 THEN o.sib || f.h ELSE f.h || o.sib END), o.i FROM f JOIN o ON o.r = f.r AND o.i = f.i + 1),
z AS (SELECT r, max_by(h, i) AS folded_root FROM f GROUP BY r), y AS (SELECT r, string_agg(sib, '' ORDER BY i) AS sibs FROM o GROUP BY r)
SELECT doc_id, leaf, top.h AS subroot, root.h AS root, sha256(coalesce(sibs, '')) AS proof_sha256, folded_root, folded_root = root.h AS verified
FROM l JOIN top ON top.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM un WHERE n = 1) root ON true JOIN z USING (r) LEFT JOIN y USING (r)"""

#: Each node is summed over all that start with it: the ways of these tables are short.
_OP13 = f"""WITH {_CRC_TABLE}, t AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (SELECT c, c - c % 100 AS base, {_CRC.format(b=_DECIMAL.format(c="c"))} % 6 AS h FROM (SELECT DISTINCT c FROM t), ct),
r AS (SELECT k.c, t.pos, role, text FROM k JOIN t ON t.c = k.base AND t.pos < k.h UNION ALL SELECT k.c, t.pos, role, text FROM k JOIN t ON t.c = k.c AND t.pos >= k.h),
q AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, len(text) AS points, list(len(role) || ':' || role || len(text) || ':' || text) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS way FROM r),
m AS MATERIALIZED (SELECT c, depth, points, way FROM q UNION ALL SELECT c, 0, 0, []::VARCHAR[] FROM k),
n AS MATERIALIZED (SELECT way, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(points) AS saved FROM m GROUP BY way, depth),
e AS (SELECT way, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(way, depth) AS way FROM m GROUP BY c) GROUP BY way),
ch AS MATERIALIZED (SELECT way[:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT up, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM (SELECT unnest(list_transform(range(depth + 1), lambda i: way[:i])) AS up, saved, ch.up IS NULL AS leaf FROM n LEFT JOIN ch ON ch.up = n.way) GROUP BY up)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.up = n.way LEFT JOIN ch ON ch.up = n.way LEFT JOIN e ON e.way = n.way LEFT JOIN n p ON n.depth > 0 AND p.way = n.way[:n.depth - 1]"""

#: The others need a trained model, a tokenizer, a parser of pages or XXH64.
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": _OP2,
    "op6_warc": _OP6,
    "op7_embedding_near_dedup": _OP7,
    "op9_exact_top_k": _OP9,
    "op11_sharding": _OP11,
    "op12_merkle_manifest": _OP12,
    "op13_conversation_trie": _OP13,
}
