"""The corpus operators as queries over the test tables, with production parameters and over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, decontam, jaccard, licenses, lines, lm, quality, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("text_hash"))
    out = sharding.byte_shards(rows, 16, order=("text_crc32", "text_hash", "doc_id"))  # equal texts follow each other
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(quality.measure(table(spark, sf_dir, "documents"), keep=("doc_id",)))
    rows = quality.apply_policy(quality.apply_policy(rows, "base/1", "base_kept"), "web/1", "kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy web/1 removes from documents, alone and with the others, from the counts of the ledger's bit patterns."""
    return quality.ablations(quality.ledger(quality.measure(table(spark, sf_dir, "documents"), keep=())), "web/1")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.scores(table(spark, sf_dir, "documents"))
    return out.withColumn("lm_score", F.round("lm_score", 6))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), lexicon, to="score")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, scorer = classifier.fit(docs)
    return classifier.classify(docs, model, scorer, keep=("doc_id",))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), known=licenses.full_texts(), runs=True)


def ranks() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts."""
    out = bpe.encode_decode(docs, ranks(), public_tokenizers.PATTERN, keep=["doc_id"])
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_quality_rules, quality_ablations, op3_line_dedup, op4_jaccard_join, op5_lm_scoring, op6_toxicity, op7_quality_classifier, op8_license_scan, op9_byte_bpe, op10_decontamination)}


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality_sql() -> str:
    bits = []
    for r in quality.RULES:
        value, base = (f"{r.measure} * 1000", r.base) if r.base else (r.measure, "1")
        tests = [f"{value} < {r.low} * {base}"] * (r.low is not None) + [f"{value} > {r.high} * {base}"] * (r.high is not None)
        bits.append(f"CASE WHEN {' OR '.join(tests)} THEN {1 << r.bit} ELSE 0 END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
lines AS (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY r, l),
dup AS (SELECT r, sum(n - 1) AS n, sum(n) AS total FROM lines GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(dup.total, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
  length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, coalesce(top.n, 0) AS n_top_word
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN dup USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, CAST({' + '.join(bits)} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (failed_bits & {quality.mask('web/1')}) = 0 AS kept, failed_bits FROM b"""


def _ablations_sql() -> str:
    count = "CAST(count(*) FILTER (WHERE {}) AS BIGINT)"
    rules = [
        f"SELECT '{r.name}' AS rule, {count.format(f'h & {1 << r.bit} <> 0')} AS n_failed, {count.format(f'h = {1 << r.bit}')} AS n_only, "
        f"{count.format('h = 0')} AS n_kept, {count.format(f'h IN (0, {1 << r.bit})')} AS n_kept_without FROM hits"
        for r in quality.RULES if r.name in quality.POLICIES["web/1"]
    ]
    return f"WITH hits AS MATERIALIZED (SELECT failed_bits & {quality.mask('web/1')} AS h FROM ({_quality_sql()})) " + " UNION ALL ".join(rules)


_LINES_SQL = f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, {_LOWER.format("trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
shared AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, shared.k IS NOT NULL AND doc_id <> keeper AS lost FROM l LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

_JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.to_id)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_id) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY reach.doc_id"""

_LM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
t AS (SELECT r, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
size AS (SELECT greatest(count(*), 1) AS n FROM t),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w), o1 AS (SELECT r, w, count(*) AS n FROM t GROUP BY r, w),
c2 AS (SELECT u, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY u, w), o2 AS (SELECT r, u, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY r, u, w),
f1 AS (SELECT r, w, c1.n - o1.n AS f FROM o1 JOIN c1 USING (w)), f2 AS (SELECT r, u, w, c2.n - o2.n AS f FROM o2 JOIN c2 USING (u, w)),
x AS (SELECT t.r, coalesce(f2.f, 0) = 0 AS backed, CASE WHEN coalesce(f2.f, 0) > 0 THEN log10(f2.f / before.f) ELSE log10(0.4 * CASE WHEN own.f > 0 THEN own.f ELSE 0.5 END / size.n) END AS s
  FROM t JOIN f1 own ON own.r = t.r AND own.w = t.w LEFT JOIN f1 before ON before.r = t.r AND before.w = t.u LEFT JOIN f2 ON f2.r = t.r AND f2.u = t.u AND f2.w = t.w CROSS JOIN size)
SELECT doc_id, count(s) AS n_words, count(*) FILTER (WHERE backed) AS n_backed_off, round(avg(s), 6) AS lm_score FROM d LEFT JOIN x USING (r) GROUP BY d.r, doc_id"""


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fold = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\r\\n?', chr(10), 'g'), {quote(licenses.COPYRIGHT_LINE)}, '', 'g'), {quote(licenses.NOT_WORD)}, ' ', 'g')"

    def spell(c: str) -> str:
        out = f"' ' || trim(regexp_replace({c}, '[ \\n]+', ' ', 'g')) || ' '"
        for a, b in licenses.SPELLINGS:
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"trim({out})"

    return f"""
WITH known AS (SELECT DISTINCT license, {spell("f")} AS c FROM (SELECT license, {fold("t")} AS f FROM (VALUES {', '.join(f'({quote(a)}, {quote(b)})' for a, b in licenses.KNOWN)}) AS v(license, t))),
d AS (SELECT doc_id, {fold("text")} AS f FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'whole' AS scope, f AS u FROM d UNION ALL SELECT doc_id, 'line', unnest(string_split(f, chr(10))) FROM d
  UNION ALL SELECT * FROM (SELECT doc_id, 'block', unnest(regexp_split_to_array(f, '\\n *\\n')) AS u FROM d) WHERE contains(trim(u), chr(10))),
h AS (SELECT doc_id, scope, license FROM (SELECT doc_id, scope, {spell("u")} AS c FROM u) JOIN known USING (c))
SELECT doc_id, license, count(*) FILTER (WHERE scope = 'whole') AS n_whole, count(*) FILTER (WHERE scope = 'block') AS n_blocks, count(*) FILTER (WHERE scope = 'line') AS n_lines FROM h GROUP BY doc_id, license"""


def _decontamination_sql() -> str:
    span = len(decontam.MASKS[0])
    token = r"[\p{L}\p{N}]+"
    table = lambda key, source: f"SELECT {key} AS id, i - 1 AS pos, w[i] AS w, len(w) AS n FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '{token}') AS w FROM {source}))"
    seeds = lambda t: "SELECT *, " + ", ".join(f"lead(w, {k}) OVER (PARTITION BY id ORDER BY pos) AS w{k}" for k in range(span)) + f" FROM {t}"
    hits = " UNION ALL ".join("SELECT a.id AS doc_id, b.id AS item_id, a.pos - b.pos AS shift FROM ds a JOIN bs b ON " + " AND ".join(f"a.w{k} = b.w{k}" for k in range(span) if m[k] == "1") + f" AND a.w{span - 1} IS NOT NULL AND b.w{span - 1} IS NOT NULL" for m in decontam.MASKS)
    return f"""
WITH dt AS ({table("doc_id", "documents")}), bt AS ({table("item_id", "benchmark")}), ds AS ({seeds("dt")}), bs AS ({seeds("bt")}),
places AS (SELECT DISTINCT * FROM ({hits})),
eq AS (SELECT doc_id, item_id, shift, bt.pos, bt.n, CASE WHEN dt.w = bt.w THEN 1 ELSE 0 END AS e FROM places JOIN bt ON bt.id = item_id LEFT JOIN dt ON dt.id = doc_id AND dt.pos = bt.pos + shift),
run AS (SELECT *, sum(e) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN {decontam.STRETCH - 1} PRECEDING AND CURRENT ROW) AS s FROM eq),
f AS (SELECT doc_id, item_id, shift, any_value(n) AS n, sum(e) AS equal, max(s) AS best FROM run GROUP BY doc_id, item_id, shift),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, shift) AS k FROM f WHERE best * 100 >= least(n, {decontam.STRETCH}) * {decontam.PERCENT})
SELECT doc_id, item_id, CAST(equal AS BIGINT) AS n_equal, CAST(n AS BIGINT) AS n_tokens, CAST(shift AS BIGINT) AS first_token FROM o WHERE k = 1"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express. The others are tested by brute force, round trips and held-out rows."""
    return {
        "op2_quality_rules": _quality_sql(),
        "quality_ablations": _ablations_sql(),
        "op3_line_dedup": _LINES_SQL,
        "op4_jaccard_join": _JACCARD_SQL,
        "op5_lm_scoring": _LM_SQL,
        "op8_license_scan": _license_sql(),
        "op10_decontamination": _decontamination_sql(),
    }
