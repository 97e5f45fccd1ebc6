"""The queries of the operators and, where SQL can say it, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm import (
    chunk_recipes, fingerprints, hard_negatives, licenses, mixing, near_duplicates, packing, quality, rows, secrets, sharding, spelling,
    token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


MIX = mixing.Target(budget=1.0, entropy=0.97, repetition=4.0)
TREE = sharding.even_tree(16)
#: CRC-32 of each half byte.
CRC_TABLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_CRC_LOW = f"xor(c >> 4, ({CRC_TABLE})[(xor(c, b) & 15) + 1])"
#: CRC-32 of the UTF-8 bytes of ``t``: the low half of each byte, then the high half.
CRC = f"""xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: ('0x' || b)::BIGINT),
    lambda c, b: xor({_CRC_LOW} >> 4, ({CRC_TABLE})[(xor({_CRC_LOW}, b >> 4) & 15) + 1]), 4294967295::BIGINT))"""


def _drawn(of: str, key: str = "doc_id") -> str:
    return f"('0x' || substr(md5(concat_ws(':', {of}, coalesce({key}::VARCHAR, 'null'))), 1, 13))::BIGINT"


_MIX_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens FROM documents),
shares AS (
  SELECT source, count(*) AS documents, sum(tokens)::BIGINT AS source_tokens, (sum(sum(tokens)) OVER ())::BIGINT AS all_tokens,
         sum(tokens)::DOUBLE / (sum(sum(tokens)) OVER ())::DOUBLE AS share FROM sized GROUP BY source),
by_entropy(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN h < goal THEN low ELSE mid END, CASE WHEN h < goal THEN mid ELSE high END FROM (
    SELECT step, low, high, mid, ln(sum(share ** mid)) - any_value(mid) * sum(share ** mid * ln(share)) / sum(share ** mid) AS h,
           {MIX.entropy} * ln(count(*)) AS goal
    FROM (SELECT *, (low + high) / 2 AS mid FROM by_entropy WHERE step < 30), shares GROUP BY step, low, high, mid)),
by_repeats(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN r <= {MIX.repetition} THEN low ELSE mid END, CASE WHEN r <= {MIX.repetition} THEN mid ELSE high END FROM (
    SELECT step, low, high, mid, {MIX.budget} * max(share ** mid / share) / sum(share ** mid) AS r
    FROM (SELECT *, (low + high) / 2 AS mid FROM by_repeats WHERE step < 30), shares GROUP BY step, low, high, mid)),
chosen AS (
  SELECT round(greatest((SELECT high FROM by_entropy WHERE step = 30), (SELECT high FROM by_repeats WHERE step = 30)), 6) AS a),
quotas AS (
  SELECT source, source_tokens, round(share ** a / (sum(share ** a) OVER ()) * all_tokens * {MIX.budget})::BIGINT AS quota,
         greatest(floor(sqrt(documents)), 1)::BIGINT AS blocks FROM shares, chosen),
placed AS (
  SELECT doc_id, source, tokens, source_tokens, quota, rank, floor(rank::DOUBLE / 4503599627370496.0 * blocks)::BIGINT AS block
  FROM (SELECT *, ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, 'null'), ({CRC})::VARCHAR)), 1, 13))::BIGINT AS rank
        FROM sized) JOIN quotas USING (source)),
turns AS (
  SELECT *, epoch * source_tokens + coalesce(sum(block_tokens) OVER (
      PARTITION BY source, epoch ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, ('0x' || substr(md5(concat_ws(':', 'mix', epoch::VARCHAR, block::VARCHAR)), 1, 13))::BIGINT AS turn
        FROM (SELECT *, unnest(range(greatest(ceil(quota / source_tokens)::BIGINT, 1))) AS epoch FROM (
                SELECT source, block, source_tokens, quota, sum(tokens) AS block_tokens FROM placed GROUP BY ALL)))),
starts AS (
  SELECT p.doc_id, p.source, p.tokens, t.epoch, p.quota, t.before + coalesce(sum(p.tokens) OVER (
      PARTITION BY p.source, p.block, t.epoch ORDER BY p.rank, p.doc_id, p.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed p JOIN turns t ON p.source = t.source AND p.block = t.block)
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch::INTEGER AS epoch, start::DOUBLE / quota::DOUBLE AS position
FROM starts WHERE start < quota"""


@query("op1_mix_sources", _MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(rows.documents(spark, sf_dir), MIX).select("doc_id", "source", "tokens", "epoch", "position")


def _tree_values(tree) -> tuple[str, str, str]:
    regions, racks, shards = sharding.levels(tree)
    return (", ".join(f"('{c}', {w})" for c, w in regions.items()),
            ", ".join(f"('{p}', '{c}', {w})" for p, of in racks.items() for c, w in of.items()),
            ", ".join(f"('{p}', '{c}', {w})" for p, of in shards.items() for c, w in of.items()))


def _descent(name: str, tree) -> str:
    regions, racks, shards = _tree_values(tree)
    chance = f"-ln(({_drawn("'tree', n.child", "k.doc_id")} + 0.5) / 4503599627370496.0) / n.weight"
    return f"""
{name}_1 AS (SELECT k.doc_id, arg_min(n.child, {chance}) AS region FROM ids k, (VALUES {regions}) n(child, weight) GROUP BY k.doc_id),
{name}_2 AS (SELECT k.doc_id, k.region, arg_min(n.child, {chance}) AS rack FROM {name}_1 k JOIN (VALUES {racks}) n(parent, child, weight) ON n.parent = k.region GROUP BY ALL),
{name} AS (SELECT k.doc_id, k.region, k.rack, substr(arg_min(n.child, {chance}), 2)::INTEGER AS shard FROM {name}_2 k JOIN (VALUES {shards}) n(parent, child, weight) ON n.parent = k.rack GROUP BY ALL)"""


_SHARD_SQL = f"""
WITH sized AS (SELECT *, {CRC} AS text_crc32 FROM (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN text IS NULL THEN 1 ELSE strlen(text) + 1 END AS size FROM documents)),
ids AS (SELECT DISTINCT doc_id FROM documents),
{_descent("now", TREE)},
{_descent("then_", sharding.grown(TREE))}
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, n.shard,
  row_number() OVER (PARTITION BY n.shard ORDER BY {_drawn("'slot'", "s.doc_id").replace("'null')", "'null'), s.text_crc32::VARCHAR")}, s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot,
  g.shard AS grown_shard, n.region, n.rack
FROM sized s JOIN now n ON s.doc_id IS NOT DISTINCT FROM n.doc_id JOIN then_ g ON s.doc_id IS NOT DISTINCT FROM g.doc_id"""


@query("op3_shard_tree", _SHARD_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(rows.documents(spark, sf_dir), TREE, sharding.grown(TREE))


def _spans_sql(pattern: str, kind: int, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT row_id, {kind} AS kind, hits[i] AS hit, vals[i] AS value,
    coalesce(list_sum(list_transform(gaps[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[:i-1], lambda g: length(g))), 0) AS start
  FROM (SELECT row_id, regexp_extract_all(t, '{quoted}', 0) AS hits, regexp_extract_all(t, '{quoted}', {group}) AS vals,
          regexp_split_to_array(t, '{quoted}') AS gaps, unnest(range(1, len(regexp_extract_all(t, '{quoted}', 0)) + 1)) AS i FROM docs)
  WHERE length(vals[i]) >= {least}"""


_SECRET_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
base AS (SELECT *, start + length(hit) AS stop FROM (
  {_spans_sql(secrets.ASSIGN, 0, 2, secrets.LEAST_VALUE)} UNION ALL {_spans_sql(secrets.ACCESS_LONG, 1, 0, 0)} UNION ALL {_spans_sql(secrets.HEX_LONG, 2, 0, 0)})),
further AS (SELECT *, start + length(hit) AS stop FROM ({_spans_sql(secrets.CANDIDATE, 3, 0, 0)}) c
  WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) >= {secrets.LEAST_DIGITS} AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= {secrets.LEAST_DIFFERENT}),
extra AS (SELECT * FROM further e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = e.row_id AND b.start < e.stop AND e.start < b.stop)),
owners AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (source, lang)) AS repos, count(DISTINCT t) AS texts
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) JOIN docs USING (row_id) GROUP BY value),
judged AS (SELECT s.*, owners, owners >= {secrets.EXAMPLE_OWNERS} OR repos >= {secrets.EXAMPLE_REPOS} OR texts >= {secrets.EXAMPLE_TEXTS} OR NOT (
    length(regexp_replace(value, '[^0-9]', '', 'g')) >= {secrets.LEAST_DIGITS} AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= {secrets.LEAST_DIFFERENT}) AS example
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) s JOIN owners USING (value)),
found AS (SELECT * FROM judged WHERE kind < 3 OR (NOT example AND owners = 1)),
texts AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM found)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans,
  count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example
FROM docs d LEFT JOIN texts x USING (row_id) GROUP BY d.row_id, d.doc_id"""


@query("op4_secret_ownership", _SECRET_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(rows.documents(spark, sf_dir)))


def _quality_sql() -> str:
    cut = lambda e: f"(({e}) >> greatest(length(bin({e})) - {quality.DIGITS}, 0)) << greatest(length(bin({e})) - {quality.DIGITS}, 0)"
    per = {"symbols": "1000 * n_symbols // greatest(n_words, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
           "long_words": "1000 * word_chars // greatest(n_words, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)"}
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {d}" for m, d in quality.MEASURES.items()) + " END"
    quantiles = ("q10", "q50", "q90")
    drawn = lambda n, own, wide: ", ".join(f"({n} * {own}{q} + {quality.HALF_WAY} * {wide}{q}) // ({n} + {quality.HALF_WAY}) AS {q}" for q in quantiles)

    def usual(of: str, by: str, values: tuple) -> str:
        """The median over groups, weighted by their documents up to HALF_WAY."""
        middle = ", ".join(f"min(cell) FILTER (value = '{v}' AND 2 * upto >= whole) AS {v}" for v in values)
        return f"""SELECT {by}, max(whole) AS w, {middle} FROM (
          SELECT {by}, value, cell, sum(weight) OVER (PARTITION BY {by}, value ORDER BY cell) AS upto, sum(weight) OVER (PARTITION BY {by}, value) AS whole
          FROM (SELECT {by}, value, least(n, {quality.HALF_WAY}) AS weight, {cut("v")} AS cell FROM (UNPIVOT {of} ON {", ".join(values)} INTO NAME value VALUE v)))
          GROUP BY {by}"""

    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
windows AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w) AS times FROM (
    SELECT row_id, i, array_to_string(words[i:i+4], ' ') AS w FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM split))),
repeats AS (SELECT row_id, count(DISTINCT i + k) AS n FROM windows, range(5) r(k) WHERE times > 1 GROUP BY row_id),
feats AS (SELECT row_id, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN repeats USING (row_id)),
measured AS (SELECT *, {", ".join(f"{e} AS {m}" for m, e in per.items())} FROM feats),
cells AS (SELECT row_id, lang, source, measure, {cut("value")} AS cell FROM (UNPIVOT measured ON {", ".join(per)} INTO NAME measure VALUE value)),
groups AS (SELECT lang, source, measure, n, {", ".join(f"cells[({t} * n + 9) // 10] AS {q}" for q, t in quality.QUANTILES.items())}
  FROM (SELECT lang, source, measure, count(*) AS n, list(cell ORDER BY cell) AS cells FROM cells GROUP BY ALL)),
by_all AS ({usual("groups", "measure", quantiles)}),
by_lang AS (SELECT o.lang, o.measure, {drawn("o.w", "o.", "a.")} FROM ({usual("groups", "lang, measure", quantiles)}) o JOIN by_all a USING (measure)),
own AS (SELECT o.lang, o.source, o.measure, o.n, {drawn("o.n", "o.", "w.")} FROM groups o
  JOIN by_lang w ON o.lang IS NOT DISTINCT FROM w.lang AND o.measure = w.measure),
spread AS (SELECT *, ({quality.SPREAD} * (q90 - q50) + {least})::BIGINT AS above, ({quality.SPREAD} * (q50 - q10) + {least})::BIGINT AS below, {least} AS least FROM own),
limits AS (SELECT s.lang, s.source, measure, s.q50 + least(s.above, u.above + s.least // 4) AS most, s.q50 - least(s.below, u.below + s.least // 4) AS fewest
  FROM spread s JOIN ({usual("spread", "measure", ("above", "below"))}) u USING (measure)),
wide AS (SELECT lang, source, {", ".join(f"max(most) FILTER (measure = '{m}') AS max_{m}" for m in per)},
    {", ".join(f"max(fewest) FILTER (measure = '{m}') AS min_{m}" for m in quality.LOWER)} FROM limits GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words)
    AND {" AND ".join([f"{m} <= max_{m}" for m in per] + [f"{m} >= min_{m}" for m in quality.LOWER])} AS kept,
  {", ".join(f"{m}::BIGINT AS {m}" for m in quality.MEASURES)}, {", ".join(f"max_{m}::BIGINT AS max_{m}" for m in quality.MEASURES)},
  {", ".join(f"min_{m}::BIGINT AS min_{m}" for m in quality.LOWER)}
FROM measured m JOIN wide w ON m.lang IS NOT DISTINCT FROM w.lang AND m.source IS NOT DISTINCT FROM w.source"""


@query("op8_adaptive_quality", _quality_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(rows.documents(spark, sf_dir))


#: Longest sequence of both tokenizers' models.
CONTEXT = 4096


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(rows.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), CONTEXT)


@query("op6_pack_sequences")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        rows.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), closing_id=2, largest=CONTEXT)


@query("op2_toxicity_cnn")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.assess(rows.documents(spark, sf_dir), rows.labels(spark, sf_dir), ["doc_id", "lang"])
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "rejected")


@query("op9_license_blocks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(rows.documents(spark, sf_dir))


@query("op10_spot_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(rows.documents(spark, sf_dir))


@query("op7_minhash_hamming")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(rows.documents(spark, sf_dir), percent=85)


_EQUAL_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""


@query("op11_chunk_recipes", _EQUAL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.equal_texts(rows.documents(spark, sf_dir)).drop("n_chunks")


_MINE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same AND vec_id <> anchor_id)
  WHERE place <= {hard_negatives.POSITIVES})
SELECT * FROM (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= {hard_negatives.NEGATIVES}"""


@query("op12_strassen_negatives", _MINE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


_SPELLING_SQL = f"""
WITH RECURSIVE each AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, times, {CRC} AS h FROM (
  SELECT run, count(*) AS times, coalesce(doc_id::VARCHAR, 'null') || ':' || run AS t FROM each GROUP BY doc_id, run)),
v AS (SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.LEAST_TIMES}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM cut a JOIN v ON a.rest = v.word),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near END AS form,
    CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near_n END AS form_n FROM v LEFT JOIN best b ON b.word = v.word AND place = 1),
chain(word, root, step) AS (SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c USING (word)"""


@query("op13_partenum_spelling", _SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(rows.documents(spark, sf_dir))
