"""The training-data operators bound to the shared tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podspark.llm import decontaminate, html_extract, language_id, lm_score, mixing, near_join, periodic_runs, pii, quality, sharding, substring_dedup, suffix_dedup, whitening
from podspark.llm.common import let, table, words_of


def _held_out(parts: int, part: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts == part


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", ~F.coalesce(_held_out(5, 1), F.lit(False)))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return lm_score.score(docs).withColumn("held_out", ~F.col("train")).select(*columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.apply_rules(table(spark, sf_dir, "documents")).select(*columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), ["doc_id"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.join(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_held_out(4, 2), F.lit(False)))
    return language_id.identify(docs, language_id.train(docs.filter("not held_out")), ["doc_id", "held_out"])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeats planted into the words of those whose hashed id ends in 0."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def tail(w):
        n, g = F.size(w), F.floor(h / 10)
        start = (g % n).cast("int")
        period = 1 + F.floor((n - start) / (3 + g % 8)).cast("int")
        again = lambda s, p: F.transform(w, lambda x, i: F.when(i < s, x).otherwise(F.get(w, s + (i - s) % p)))
        return F.when(n > 0, let(F.struct(start.alias("s"), period.alias("p")), lambda v: F.array_join(again(v["s"], v["p"]), " "))).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words_of(F.col("text")), tail)).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_near_join": op9_near_join,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP4 = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_TOKEN}') AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM starts),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TOKEN}') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, i, spots.n, item FROM spots JOIN wins ON spots.n = wins.n AND array_to_string(w[i:i + spots.n - 1], ' ') = win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words}))
_OP6 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM docs WHERE len(w) > 5),
same AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM wins),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM same WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
stops AS (SELECT doc_id, count(*) AS n_stop FROM (SELECT doc_id, unnest(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D.,;:!?()"]+')) AS p FROM docs) WHERE p IN ({_STOPS}) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop
  FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN stops USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 10 AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / word_chars <= 0.05
  AND (n_words < 40 OR n_stop / n_words >= 0.02) AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.40 AS kept
FROM b
"""

_OP7 = rf"""
WITH docs AS (SELECT doc_id, text, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sums),
fill AS (SELECT *, source_size * 3 / weight AS full_at FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM fill),
chosen AS (SELECT arg_min(level, full_at) AS level FROM levels WHERE level <= full_at),
goal AS (SELECT source, source_size, CASE WHEN full_at <= chosen.level THEN source_size * 3.0::DOUBLE ELSE coalesce(chosen.level, 0) * weight END AS target FROM levels LEFT JOIN chosen ON true),
parts AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM goal),
need AS (SELECT *, target - whole * source_size AS missing FROM parts),
steps AS (SELECT source, size, count(*) AS n FROM docs WHERE size > 0 GROUP BY source, size),
rated AS (SELECT s.source, size, (missing - coalesce(sum(size * n) OVER (PARTITION BY s.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(size * size * n) OVER (PARTITION BY s.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM steps s JOIN need ON s.source IS NOT DISTINCT FROM need.source),
rates AS (SELECT source, arg_max(rate, size) AS rate FROM rated WHERE rate * size <= 1 GROUP BY source),
chances AS (SELECT d.*, source_size, target, whole, missing, least(1.0, coalesce(rate, 1.0) * size) AS pi,
  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS u
  FROM docs d JOIN need ON d.source IS NOT DISTINCT FROM need.source LEFT JOIN rates ON d.source IS NOT DISTINCT FROM rates.source),
ranks AS (SELECT *, u / (1 - u) * (1 - pi) / pi AS rank FROM chances WHERE size > 0 AND missing > 0 AND pi > 0),
running AS (SELECT doc_id, missing, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranks),
drawn AS (SELECT doc_id, 1 AS extra FROM running WHERE before < missing AND before + size / 2 <= missing)
SELECT doc_id, size, source_size, target, CAST((whole + coalesce(extra, 0)) * size AS BIGINT) AS taken FROM chances LEFT JOIN drawn USING (doc_id)
"""

_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d WHERE len(h) >= 200),
named AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 200)) AS x FROM wins),
again AS (SELECT doc_id, i FROM named QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
begun AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS fresh FROM again),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM begun),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 99 AS e FROM numbered GROUP BY doc_id, k),
before AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS upto FROM runs),
cut AS (SELECT doc_id, any_value(h) AS h, count(*) AS n, sum(e - s + 1) AS gone, string_agg(substr(h, 2 * upto + 1, 2 * (s - upto - 1)), '' ORDER BY s) AS kept, max(e) AS last
  FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN d.h ELSE kept || substr(d.h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
again AS (SELECT doc_id, i FROM wins QUALIFY row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.root AS component_id FROM s JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = s.doc_id
"""



def _crc_steps(value: int, bits: int) -> int:
    """The register of CRC-32 after that many zero bits."""
    for _ in range(bits):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _crc_list(shift: int, bits: int) -> str:
    return "[" + ", ".join(f"{_crc_steps(n << shift, bits)}::BIGINT" for n in range(16)) + "]"


def _crc_ctes(source: str) -> str:
    """CTEs that end in ``crcs (id, crc)`` from ``source (id, t)``: checksums of the UTF-8 bytes of ``t``.

    Texts are cut into pieces of 64 bytes; checksums of pieces are joined by shifting the earlier ones.
    The four bytes in front bring the register from 0 to all ones, so zeros before them change nothing.
    """
    shifted = _crc_list(0, 512) + "[(c & 15) + 1]"
    for k in range(4, 32, 4):
        shifted = f"xor({shifted}, {_crc_list(k, 512)}[((c >> {k}) & 15) + 1])"
    return f"""
hexed AS (SELECT id, '62F52692' || hex(encode(t)) AS h FROM {source}),
padded AS (SELECT id, repeat('0', (128 - length(h) % 128) % 128) || h AS h FROM hexed),
numbered_pieces AS (SELECT id, h, unnest(range(length(h) // 128)) AS k FROM padded),
pieces AS MATERIALIZED (SELECT id, k, substr(h, 1 + 128 * k, 128) AS g FROM numbered_pieces),
digits AS (SELECT id, k, [instr('123456789ABCDEF', g[i - 1 + 2 * (i % 2)])::BIGINT FOR i IN range(1, 129)] AS d FROM pieces),
piece_crcs AS (SELECT id, k, list_reduce(list_prepend(0::BIGINT, d), lambda c, x: xor(c >> 4, {_crc_list(0, 4)}[(xor(c, x) & 15) + 1])) AS r FROM digits),
crcs AS (SELECT id, xor(list_reduce(list(r ORDER BY k), lambda c, x: xor(x, {shifted})), 4294967295) AS crc FROM piece_crcs GROUP BY id)"""


_OP12 = f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents), {_crc_ctes("texts")},
sized AS (SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, crc FROM texts JOIN crcs USING (id)),
placed AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS nth, sum(size) OVER () AS total FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, CAST((2 * upto - size) * {sharding.SHARDS} // (2 * total) AS INT) AS shard FROM placed)
SELECT doc_id, size, crc AS text_crc32, '{sharding.LAW}' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM cut
"""

_OP13 = rf"""
WITH texts AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS t FROM documents WHERE doc_id IS NOT NULL), {_crc_ctes("texts")},
plain AS (SELECT doc_id, {_WORDS} AS w, crc AS h, crc // 10 AS g FROM documents LEFT JOIN crcs ON id = doc_id),
aimed AS (SELECT doc_id, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a, g FROM plain),
docs AS (SELECT doc_id, w, coalesce(a, len(w)) AS a, coalesce(1 + (len(w) - a) // (3 + g % 8), 1) AS p FROM aimed),
words AS (SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT doc_id, w, a, p, len(w) AS n, unnest(range(len(w))) AS i FROM docs)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
streaks AS (SELECT doc_id, q, min(i) AS s, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, c + q AS len, min(q) AS q FROM streaks WHERE c + q >= greatest(6, 4 * q) GROUP BY doc_id, s, c + q),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, s, len, q FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.len * r.q > r.len * o.q OR o.len * r.q = r.len * o.q AND (o.s, o.q) < (r.s, r.q)))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(left_over.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": _OP1,
    "op4_decontamination": _OP4,
    "op5_substring_dedup": _OP5,
    "op6_quality_rules": _OP6,
    "op7_mixing": _OP7,
    "op9_near_join": _OP9,
    "op12_sharding": _OP12,
    "op13_periodic_runs": _OP13,
}
