"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.archives import convert_arc, read_warc, write_arc
from scorelake.llm.common import stage, table, tokenizer_model
from scorelake.llm.decontaminate import find_leaks
from scorelake.llm.disclosure import sanitise
from scorelake.llm.histogram_shards import shard_by_bytes
from scorelake.llm.jaccard_join import jaccard_join
from scorelake.llm.lattice import lattice_dedup
from scorelake.llm.line_dedup import dedup_lines
from scorelake.llm.piece_bpe import encode_documents
from scorelake.llm.prefix_trie import prefix_trie, turn_sequences
from scorelake.llm.quality import fit_quality, score_quality
from scorelake.llm.secrets import scan_secrets
from scorelake.llm.spot_signatures import ANCHORS, beside_next, likeness, signatures
from scorelake.llm.structure_repair import plan_repairs, repaired_digests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


LINE_DEDUP_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM split
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), owners AS (
  SELECT line_key, min(doc_id) AS owner FROM keyed WHERE length(line_key) >= 10 GROUP BY line_key
), judged AS (
  SELECT doc_id, pos, line, coalesce(owner <> doc_id, FALSE) AS gone FROM keyed LEFT JOIN owners USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_histogram_shards")
def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = shard_by_bytes(docs.withColumn("text_crc32", crc))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_quality_trees")
def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(documents, table(spark, sf_dir, "labels"))
    return score_quality(documents, trees).select("doc_id", "held_out", "score", "predicted")


def span_digest(found: DataFrame, base: list[str]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, from an array of spans."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(F.array_join(F.transform(of_base, written), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
    )


@query("op4_zstd_novelty")
def op4_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), ["assign", "access", "hex"])


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), best AS (
  SELECT html, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN coalesce(best, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN best USING (html)
"""


@query("op5_arc_to_warc", WARC_SQL)
def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = write_arc(table(spark, sf_dir, "pages"))
    records = read_warc(spark, convert_arc(spark, arcs))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_piece_bpe")
def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_model("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op9_spaced_seeds")
def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(documents, table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "words", "matches", "doc_word", "item_word")


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classed.select("doc_id", "class_id", "n_links", "kept")


@query("op8_lattice_hashing")
def op8_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice_dedup(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


@query("op7_disclosure")
def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(sanitise(table(spark, sf_dir, "documents").select("doc_id", "text")), ["email", "ip", "card", "phone"])


# CRC-32 of a decimal number by the usual table, over the codes of its digits.
CRC_TABLE_SQL = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


TRIE_SQL = f"""
WITH {CRC_TABLE_SQL}, turns AS (
  SELECT conv_id, turn, role, {{'key': sha256(strlen(role) || ':' || role || text), 'bytes': strlen(text)}} AS told
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) q
), own AS (
  SELECT conv_id, list(told ORDER BY turn NULLS FIRST, role, told.key) AS turns FROM turns GROUP BY conv_id
), taken AS (
  SELECT conv_id, turns, ({crc_sql("conv_id::VARCHAR")} % 9)::INT AS h FROM own, crc
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(o.turns[1:h], []), c.turns[h + 1:]) AS turns FROM taken c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5
), steps AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt
), paths AS (
  SELECT conv_id, d, d = len(turns) AS ends, CASE WHEN d > 0 THEN turns[d].bytes ELSE 0 END AS bytes,
    sha256(array_to_string(list_transform(turns[1:d], lambda t: t.key), ',')) AS id,
    CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda t: t.key), ',')) END AS parent
  FROM steps
), nodes AS (
  SELECT id, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY id, d
), kids AS (
  SELECT parent AS id, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT p.id, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens, count(*) FILTER (k.id IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN kids k ON k.id = n.id JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.id
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below ON below.id = n.id LEFT JOIN kids ON kids.id = n.id LEFT JOIN nodes up ON up.id = n.parent
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation opens with turns of the one its group of five begins with, then goes on with its own."""
    own = stage(turn_sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    opening = own.select(F.col("conv_id").alias("opener"), F.slice("turns", 1, 8).alias("opening"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = F.coalesce(F.expr("slice(opening, 1, taken)"), F.expr("filter(turns, t -> false)"))
    rest = F.expr("slice(turns, taken + 1, size(turns))")
    joined = own.select("*", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % 5).alias("opener")).join(opening, "opener", "left")
    return prefix_trie(joined.select("conv_id", F.concat(first, rest).alias("turns")))


SPOT_SQL = r"""
WITH told AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS doc_id, coalesce(text, '') AS text FROM documents
), paired AS (
  SELECT *, row_number() OVER o AS place,
    coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text,
    coalesce(lead(row_id) OVER o, first_value(row_id) OVER o) AS next_row, row_id
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id, text) AS row_id FROM told)
  WINDOW o AS (ORDER BY row_id)
), versions AS (
  SELECT row_id, 'own' AS version, text FROM paired
  UNION ALL
  SELECT row_id, 'edited', substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) FROM paired
), split AS (
  SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS ws FROM versions
), parts AS (
  SELECT *, list_filter(ws, lambda w: NOT list_contains([ANCHORS], w)) AS cs,
    list_filter(list_transform(ws, lambda w, i: CASE WHEN list_contains([ANCHORS], w) THEN i END), lambda i: i IS NOT NULL) AS ps
  FROM split
), chained AS (
  SELECT *, list_filter(list_transform(ps, lambda p, j: CASE WHEN p - j + 2 <= len(cs)
    THEN ws[p] || ' ' || cs[p - j + 1] || ' ' || cs[p - j + 2] END), lambda c: c IS NOT NULL) AS chains FROM parts
), signed AS (
  SELECT row_id, version, text, list_sort(list_distinct(list_transform(
    CASE WHEN len(chains) > 0 THEN chains WHEN len(ws) > 0 THEN list_transform(ws, lambda w: ' ' || w) ELSE [chr(10) || text] END,
    lambda c: CAST('0x' || substr(md5(c), 1, 15) AS BIGINT)))) AS sigs
  FROM chained
), met AS (
  SELECT p.doc_id, length(p.text) AS n_chars, sha256(e.text) AS edited_sha256, o.sigs AS a, e.sigs AS b, n.sigs AS c
  FROM paired p
  JOIN signed o ON o.row_id = p.row_id AND o.version = 'own'
  JOIN signed e ON e.row_id = p.row_id AND e.version = 'edited'
  JOIN signed n ON n.row_id = p.next_row AND n.version = 'own'
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
  len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS near_edited,
  len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) AS near_next
FROM met
""".replace("[ANCHORS]", "['" + "', '".join(sorted(set(ANCHORS))) + "']")


@query("op12_spot_signatures", SPOT_SQL)
def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the documents and of their texts with the last quarter replaced by the next document's opening."""
    rows = beside_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    length = F.char_length("text")
    cut = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    told = rows.select(F.col("did").alias("doc_id"), length.cast("long").alias("n_chars"), edited.alias("edited"), "signatures", "next_signatures")
    told = told.withColumn("edited_signatures", signatures(F.col("edited")))
    return told.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.concat_ws(",", F.col("signatures").cast("array<string>")).alias("fingerprint"),
        F.concat_ws(",", F.col("edited_signatures").cast("array<string>")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# Row by row the least (cost, audit) of every state: at most two insertions, then an edit.
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}, told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), struck AS (
  SELECT *, {crc_sql("place")} % 20 AS damage FROM told, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM struck, range(2) copies(c) WHERE damage <> 0 AND (c = 0 OR damage = 3)
), placed AS (
  SELECT *, trim(text, {_BLANKS_SQL}) AS bare, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
), follows(q, r) AS (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
), added(q, r, price, letters, lines) AS (VALUES ('-', '-', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
  ('-', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']), ('a', 'u', 3, 'I', ['user:']),
  ('-', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])
), edits AS (
  SELECT conv_id, pos, q, q AS r, 4 AS price, 'D' AS letter, [] AS lines FROM judged, (VALUES ('-'), ('s'), ('u'), ('a')) s(q)
  UNION ALL
  SELECT conv_id, pos, q, r, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM judged JOIN follows ON r = initial
  WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL
  SELECT conv_id, pos, q, r, 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'R', [CASE r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM judged JOIN follows ON r IN ('u', 'a') WHERE fault IS NULL OR fault = 'truncated'
), state AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, '-' AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM conversations
  UNION ALL
  SELECT conv_id, pos, q, min(best) FROM (
    SELECT s.conv_id, e.pos, e.r AS q, {{'cost': s.best.cost + i.price + e.price, 'audit': s.best.audit || i.letters || e.letter,
      'lines': list_concat(list_concat(s.best.lines, i.lines), e.lines)}} AS best
    FROM state s JOIN added i ON i.q = s.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.pos = s.pos + 1 AND e.q = i.r) made
  GROUP BY conv_id, pos, q
), ended AS (
  SELECT s.conv_id, min({{'cost': s.best.cost + i.price, 'audit': s.best.audit || i.letters, 'lines': list_concat(s.best.lines, i.lines)}}) AS best
  FROM state s JOIN added i ON i.q = s.q AND i.r IN ('-', 'a') LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE s.pos = coalesce(c.n, 0) GROUP BY s.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op13_structure_repair", REPAIR_SQL)
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows damaged by the hash of their place, and the cheapest repair of what is left."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", named("conv_id"), named("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), fault.alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    damaged = told.filter("damage <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")
    plans = stage(plan_repairs(damaged, rows.select("conv_id")))
    digests = repaired_digests(damaged, plans).withColumnRenamed("conv_id", "of")
    return plans.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
