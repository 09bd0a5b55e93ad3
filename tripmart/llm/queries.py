"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, embedding_dedup, line_dedup, max_score, minhash, packing, quality, repair, span_dedup, suffix_dedup, url_filter
from .common import table

PLANTED = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    turns = chat.format_turns(rows.unionByName(own))
    return chat.digest(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP1_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\\', '\\\\'), '<turn>', '\\<turn>'), '<says>', '\\<says>'), '</turn>', '\\</turn>') AS safe
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(19 + length(role) + length(safe)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps of its lines."""
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
common AS (
  SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 40 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of repeated runs."""
    out = span_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in every document, with the best and its score."""
    out = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.get("matches", 0)
    return out.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
        best["item"].alias("best_item"), best["score"].alias("best_score"), F.transform("matches", lambda m: m["item"]).alias("items"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


_COMPONENTS = """
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""
OP6_SQL = (
    """
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (
  SELECT * FROM nodes WHERE label IS NOT NULL AND x IS NOT NULL AND list_sum(list_transform(x, lambda v: v * v)) > 0),
links AS (
  SELECT a.id AS u, b.id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.id < b.id AND list_cosine_similarity(a.x, b.x) >= 0.93),
"""
    + _COMPONENTS
    + """
SELECT n.id AS vec_id, (SELECT count(*) FROM both_ways b WHERE b.u = n.id) AS n_links, component_id, n.id = component_id AS kept
FROM nodes n JOIN component c ON c.id = n.id
"""
)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP8_SQL = (
    r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM split),
nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id AS id, unnest(s) AS g FROM sets),
shared AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN nodes x ON x.id = u JOIN nodes y ON y.id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
"""
    + _COMPONENTS
    + """
SELECT n.id AS doc_id, n.n AS n_shingles, component_id, n.id = component_id AS kept FROM nodes n JOIN component c ON c.id = n.id
"""
)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when all 400-byte strings that occur twice are gone."""
    out = suffix_dedup.drop_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults that a checksum of their ids chooses; a row that is dropped stays as one that is not ``there``."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(cell("text"), ".!?", "")).otherwise(cell("text"))
    role = F.when(kind == 4, "user").otherwise(cell("role"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and repair of all damaged conversations."""
    return repair.repair(damaged(table(spark, sf_dir, "conversations")), F.col("there"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY k) AS t
  FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS k))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS crc_key FROM conversations),
kinds AS (
  SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(crc_key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM keyed k, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_open,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before
  FROM placed),
rows AS (
  SELECT *, is_blank OR is_again AS must_go, is_open AND NOT (is_blank OR is_again) AS is_cut FROM judged),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again AND NOT is_blank) AS duplicate, count(*) FILTER (is_cut) AS truncated,
    count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id),
inserts(state, n, after, lines) AS (VALUES
  ('', 0, '', CAST([] AS VARCHAR[])), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']), ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
  ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('u', 2, 'u', ['assistant:', 'user:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:']), ('a', 2, 'a', ['user:', 'assistant:'])),
edits(before, letter, initial, after, cost, name) AS (VALUES
  ('', 'D', NULL, '', 3, NULL), ('s', 'D', NULL, 's', 3, NULL), ('u', 'D', NULL, 'u', 3, NULL), ('a', 'D', NULL, 'a', 3, NULL),
  ('', 'K', 's', 's', 0, NULL), ('', 'K', 'u', 'u', 0, NULL), ('s', 'K', 'u', 'u', 0, NULL), ('u', 'K', 'a', 'a', 0, NULL), ('a', 'K', 'u', 'u', 0, NULL),
  ('', 'R', NULL, 'u', 2, 'user'), ('s', 'R', NULL, 'u', 2, 'user'), ('u', 'R', NULL, 'a', 2, 'assistant'), ('a', 'R', NULL, 'u', 2, 'user')),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counted
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
      SELECT w.conv_id, r.i, e.after AS state, w.cost + 2 * g.n + e.cost + CASE WHEN r.is_cut AND e.letter <> 'D' THEN 1 ELSE 0 END AS cost,
        w.audit || repeat('I', g.n) || e.letter AS audit,
        list_concat(w.lines, g.lines, CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.name, r.role) || ':' || r.text] END) AS lines
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
      JOIN inserts g ON g.state = w.state
      JOIN edits e ON e.before = g.after AND (e.initial IS NULL OR e.initial = r.initial) AND (e.letter = 'D' OR NOT r.must_go)) AS ways) AS best
  WHERE place = 1),
ended AS (
  SELECT w.conv_id, w.cost + 2 * g.n AS cost, w.audit || repeat('I', g.n) AS audit, list_concat(w.lines, g.lines) AS lines,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * g.n, w.audit || repeat('I', g.n)) AS place
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts g ON g.state = w.state AND g.after IN ('', 'a'))
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.place = 1
"""


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20."""
    return max_score.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP12_SQL = """
WITH finite AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
weights AS (SELECT vec_id, list_transform(x, lambda v: floor(64 * v)) AS w FROM finite),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score
  FROM weights q JOIN weights d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language in all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS f
  FROM placed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k >= 2 AND f >= 30),
longer AS (
  SELECT lang, w, k, a, unnest(range(1, k + 1)) AS i, m FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k),
around AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS outer_f FROM longer WHERE i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE o.outer_f IS NULL OR 100 * CAST(o.outer_f AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM kept),
parts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM parts),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_line_dedup": op2_line_dedup,
    "op3_span_dedup": op3_span_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_packing": op7_packing,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_top_k": op12_top_k,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op1_chat_format": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "op8_minhash": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_top_k": OP12_SQL, "op13_collocations": OP13_SQL}
