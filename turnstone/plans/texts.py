"""Queries of text corpora, preference data and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udfs as U
from ..operators import corpus as C
from ..operators import evaluation as E
from .catalog import query, tidy
from .tables import load, replies

_STYLE = r"""
WITH r AS (SELECT conv_id, turn, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM conversations WHERE role = 'assistant'),
v AS (SELECT conv_id, turn, text, list_filter([
  CASE WHEN regexp_matches(text, '(?m)(\*\*|__|`|^#{1,6}\s|\[[^\]]+\]\([^)]+\))') THEN 'markdown' END,
  CASE WHEN regexp_matches(text, '(?m)^\s*([-*+•]|\d+[.)])\s+') THEN 'bullets' END,
  CASE WHEN regexp_matches(text, 'https?://\S+') THEN 'url' END,
  CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 60 THEN 'too_long' END,
  CASE WHEN len(regexp_extract_all(bare, '[.!?]+(\s|$)')) > 4 THEN 'too_many_sentences' END,
  CASE WHEN contains(bare, chr(10) || chr(10)) THEN 'paragraphs' END], lambda x: x IS NOT NULL) AS rules FROM r)
"""


@query(_STYLE + " SELECT conv_id, turn, array_to_string(rules, ',') AS rules FROM v")
def style_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("conv_id", "turn", F.array_join(X.spoken_style_violations(F.col("text")), ",").alias("rules"))


@query(_STYLE + " SELECT rule, count(*) AS n FROM (SELECT unnest(rules) AS rule FROM v) GROUP BY rule")
def violation_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.violation_counts(replies(spark, sf_dir))


@query(_STYLE + " SELECT round(avg(CASE WHEN len(rules) > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM v")
def violation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.violation_rate(replies(spark, sf_dir)))


_RAG = r"""array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 text, '(?m)^\s{0,3}#{1,6}\s*', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(\*{1,3}|`{1,3})', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '[ \t]+', ' ', 'g'), '\r\n|[\n\r]'),
 lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10))"""


@query(f"SELECT doc_id, md5({_RAG}) AS text_md5 FROM documents")
def strip_markdown_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_markdown_retrieval(F.col("text"))).alias("text_md5"))


#: The training clean-up; paired emphasis is spelled out marker by marker, since these patterns know no back references.
_SFT_STEPS = "{t}"
for _pattern, _by in (
    ("(?s)```.*?```", " "), ("`([^`]*)`", "\\1"), ("(?m)^\\s{0,3}#{1,6}\\s*", ""), ("(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+", ""), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"),
    ("\\*\\*(\\S(?:.*?\\S)??)\\*\\*|__(\\S(?:.*?\\S)??)__|\\*(\\S(?:.*?\\S)??)\\*|_(\\S(?:.*?\\S)??)_", "\\1\\2\\3\\4"),
):
    _SFT_STEPS = f"regexp_replace({_SFT_STEPS}, '{_pattern.replace('{', '{{').replace('}', '}}')}', '{_by}', 'g')"
_TRIMMED = r"regexp_replace(regexp_replace(l, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_SFT = "array_to_string(list_filter(list_transform(regexp_split_to_array(" + _SFT_STEPS + r", '\r\n|[\n\r]'), lambda l: " + _TRIMMED + "), lambda l: l <> ''), ' ')"
_SPOKEN = r"(len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')) <= 60 AND " + _SFT + r" = regexp_replace(regexp_replace(replace({t}, chr(10), ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


@query("SELECT doc_id, md5(" + _SFT.format(t="text") + ") AS text_md5, " + _SPOKEN.format(t="text") + " AS spoken FROM documents")
def strip_markdown_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_markdown_training(F.col("text"))).alias("text_md5"), X.is_spoken_training(F.col("text")).alias("spoken"))


@query(
    r"""
WITH t AS (SELECT doc_id, '[\pL\pN_.+-]+@[\pL\pN_-]+(?:\.[\pL\pN_-]+)+' AS p, text FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(text, p)) AS BIGINT) AS emails, md5(regexp_replace(text, p, '[EMAIL]', 'g')) AS text_md5 FROM t
"""
)
def pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    text, counts = X.scrub(F.col("text"), X.PII[:1])
    return d.select("doc_id", counts["email"].cast("bigint").alias("emails"), F.md5(text).alias("text_md5"))


@query()
def pii_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    text, counts = X.scrub(F.col("text"))
    return d.select("doc_id", *[n.cast("bigint").alias(k) for k, n in counts.items()], F.md5(text).alias("text_md5"))


@query()
def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pii_totals(C.scrub_fields(load(spark, sf_dir, "documents").select("text"), ["text"]))


_SPLIT = "CASE WHEN x < 0.8::DOUBLE THEN 'train' WHEN x < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"
_FRACTION = "('0x' || substr(sha256(':' || {key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616::DOUBLE"


@query(f"SELECT doc_id, round(x, 12) AS fraction, {_SPLIT} AS split FROM (SELECT doc_id, {_FRACTION.format(key='doc_id')} AS x FROM documents)")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(X.split_fraction(F.col("doc_id")), 12).alias("fraction"), X.assign_split(F.col("doc_id")).alias("split"))


@query(f"SELECT {_SPLIT} AS split, count(DISTINCT conv_id) AS conversations, count(*) AS turns FROM (SELECT conv_id, {_FRACTION.format(key='conv_id')} AS x FROM conversations) GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns follow their conversation, so none is in two splits."""
    c = load(spark, sf_dir, "conversations").withColumn("split", X.assign_split(F.col("conv_id")))
    return c.groupBy("split").agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("turns"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(
    """SELECT conv_id, sha256(string_agg(sha256('{"role":' || to_json(role) || ',"turn":' || turn || '}'), chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id"""
)
def records_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash a conversation over the canonical hashes of its rows, in turn order."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", U.canonical_sha256(F.to_json(F.struct("turn", "role"))).alias("h"))
    return C.records_sha256(rows, "h", "turn", "conv_id")


@query(
    "WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN " + _SFT.format(t="text") + " ELSE text END AS content FROM conversations), "
    "m AS (SELECT conv_id, string_agg(role || ':' || md5(content), ',' ORDER BY turn) AS said, arg_min(role, turn) AS first_role, count(*) AS n FROM t GROUP BY conv_id) "
    f"SELECT conv_id, CASE WHEN first_role = 'system' THEN said ELSE 'system:' || md5('{C.SPOKEN_PROMPT}') || ',' || said END AS said, CAST(CASE WHEN first_role = 'system' THEN n ELSE n + 1 END AS BIGINT) AS n FROM m"
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.chat_messages(load(spark, sf_dir, "conversations"))
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["content"]))), ",").alias("said"), F.size("messages").cast("bigint").alias("n"))


@query(
    """
SELECT conv_id, turn, coalesce(string_agg(p.role || ':' || md5(p.text), '|' ORDER BY p.turn), '') AS history FROM (
  SELECT a.conv_id, a.turn, b.role, b.text, b.turn AS pturn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 4 AND a.i - 1) p GROUP BY conv_id, turn
""".replace("p.turn", "pturn")
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.history_window(load(spark, sf_dir, "conversations"), 4)
    return h.select("conv_id", "turn", F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["text"]))), "|").alias("history"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_row(load(spark, sf_dir, "documents")).select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query(
    """
SELECT 'conv_id' AS field, count(conv_id) AS rows_with FROM conversations UNION ALL SELECT 'turn', count(turn) FROM conversations
UNION ALL SELECT 'role', count(role) FROM conversations UNION ALL SELECT 'text', count(text) FROM conversations WHERE role <> 'system' HAVING count(text) > 0
"""
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field presence of the conversations as JSON rows; the system's rows lack a text."""
    c = load(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") != "system", F.col("text")))
    return C.field_presence(c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line")))


@query("SELECT CAST(0 AS BIGINT) + count(*) AS rows, 'text' AS field, count(CASE WHEN role <> 'system' THEN 1 END) AS rows_with FROM conversations HAVING count(*) > count(CASE WHEN role <> 'system' THEN 1 END)")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") != "system", F.col("text")))
    return C.missing_required(c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line")), ["conv_id", "text"])


@query(
    """
SELECT count(*) AS n, sum(n_chars / 15.0) AS total_duration_s, count(n_chars) AS rows_with_duration, string_agg(DISTINCT source, ',' ORDER BY source) AS speakers,
       round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))), 6) AS mean_words FROM documents
""".replace("sum(n_chars / 15.0)", "round(sum(n_chars / 15.0::DOUBLE), 3)")
)
def audio_stats_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest statistics, with documents as recordings."""
    d = load(spark, sf_dir, "documents").select("text", F.col("source").alias("speaker"), (F.col("n_chars") / 15.0).alias("duration_s"))
    return C.audio_stats(d).select("n", F.round("total_duration_s", 3).alias("total_duration_s"), "rows_with_duration", F.array_join("speakers", ",").alias("speakers"), F.round("mean_words", 6).alias("mean_words"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("prompt_id"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("text"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("pos"))


_PAIR_COLUMNS = "prompt_id, chosen, rejected, round(chosen_score, 6) AS chosen_score, round(rejected_score, 6) AS rejected_score, round(chosen_score - rejected_score, 6) AS margin"
_CANDIDATES = "c AS (SELECT l_orderkey AS prompt_id, l_partkey || '-' || l_linenumber AS t, l_extendedprice AS s, l_linenumber AS p FROM lineitem)"


@query(
    f"""
WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY s DESC, p) AS b, row_number() OVER (PARTITION BY prompt_id ORDER BY s, p DESC) AS w FROM c),
j AS (SELECT a.prompt_id, a.t AS chosen, z.t AS rejected, a.s AS chosen_score, z.s AS rejected_score FROM r a JOIN r z ON a.prompt_id = z.prompt_id AND a.b = 1 AND z.w = 1 WHERE a.s > z.s)
SELECT {_PAIR_COLUMNS} FROM j
"""
)
def pairs_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(C.pairs_from_scores(_scored(spark, sf_dir)))


@query(f"WITH {_CANDIDATES}, j AS (SELECT a.prompt_id, a.t AS chosen, z.t AS rejected, a.s AS chosen_score, z.s AS rejected_score FROM c a JOIN c z ON a.prompt_id = z.prompt_id AND a.s > z.s) SELECT {_PAIR_COLUMNS} FROM j")
def pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(C.pairs_from_scores(_scored(spark, sf_dir), all_pairs=True))


_STYLED = _STYLE + ", p AS (SELECT g.conv_id AS prompt_id, g.text AS chosen, b.text AS rejected, array_to_string(b.rules, ',') AS rejected_reasons FROM v g JOIN v b ON g.conv_id = b.conv_id AND len(g.rules) = 0 AND len(b.rules) > 0)"


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs_from_style(replies(spark, sf_dir).withColumnRenamed("conv_id", "prompt_id"))


@query(_STYLED + " SELECT prompt_id, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, rejected_reasons FROM p")
def pairs_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _styled(spark, sf_dir).select("prompt_id", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), "rejected_reasons")


@query(
    f"WITH {_CANDIDATES}, s AS (SELECT 'scores' AS source, count(*) AS n FROM (SELECT prompt_id FROM c GROUP BY prompt_id HAVING max(s) > min(s))), "
    + _STYLED.replace("\nWITH ", "", 1)
    + " SELECT source, n FROM s UNION ALL SELECT 'spoken_style', count(*) FROM p HAVING count(*) > 0"
)
def pairs_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = replies(spark, sf_dir).withColumnRenamed("conv_id", "prompt_id")
    return C.build_pairs(_scored(spark, sf_dir), styled).groupBy("source").agg(F.count("*").alias("n"))


_WORDS_SQL = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> ''))"


@query(
    _STYLED
    + ", w AS (SELECT "
    + _WORDS_SQL.format(t="chosen") + " AS c, " + _WORDS_SQL.format(t="rejected") + " AS r, " + _SPOKEN.format(t="chosen") + " AS sc, " + _SPOKEN.format(t="rejected") + " AS sr FROM p) "
    + "SELECT count(*) AS n, round(avg(c), 6) AS mean_chosen_words, round(avg(r), 6) AS mean_rejected_words, round(avg((c < r)::INT), 6) AS chosen_shorter_fraction, "
    + "round(avg(sc::INT), 6) AS chosen_spoken_fraction, round(avg(sr::INT), 6) AS rejected_spoken_fraction FROM w"
)
def preference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(C.preference_stats(_styled(spark, sf_dir)))


_DPO = "0.5::DOUBLE * ((-l_tax - -l_discount) - (-l_quantity / 50 - -l_extendedprice / 100000))"


def _margin():
    return E.dpo_margin(-F.col("l_tax"), -F.col("l_quantity") / 50, -F.col("l_discount"), -F.col("l_extendedprice") / 100000, 0.5)


@query(
    f"SELECT count(*) AS n, round(avg(m), 6) AS mean_margin, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN m > -700 THEN ln(1 + exp(-m)) ELSE -m END), 6) AS mean_loss FROM (SELECT {_DPO} AS m FROM lineitem)"
)
def dpo_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.dpo_stats(load(spark, sf_dir, "lineitem"), _margin()))


@query(
    "SELECT count(CASE WHEN l_tax > l_discount THEN 1 END) AS wins, count(CASE WHEN l_tax = l_discount THEN 1 END) AS ties, count(CASE WHEN l_tax < l_discount THEN 1 END) AS losses, count(*) AS n, "
    "round((count(CASE WHEN l_tax > l_discount THEN 1 END) + 0.5 * count(CASE WHEN l_tax = l_discount THEN 1 END)) / count(*)::DOUBLE, 6) AS win_rate FROM lineitem"
)
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.win_rate(load(spark, sf_dir, "lineitem"), "l_tax", "l_discount"))


_GATES = (E.Gate("error.mean", max=60.0), E.Gate("view.mean", min=10.0), E.Gate("click.n", min=1.0, max=5.0), E.Gate("missing.n", min=1.0), E.Gate("optional.n", min=1.0, required=False))


def _month(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    e = load(spark, sf_dir, "events").where((F.dayofmonth("ts") <= 15) == F.lit(half == 1))
    by = e.groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"))
    return by.select("name", F.create_map(F.lit("mean"), F.col("mean"), F.lit("n"), F.col("n")).alias("metrics"), F.col("name").alias("ord"))


_METRICS = "m{h} AS (SELECT event_type || '.mean' AS metric, avg(value) AS value FROM events WHERE (day(ts) <= 15) = {b} GROUP BY event_type UNION ALL SELECT event_type || '.n', count(*)::DOUBLE FROM events WHERE (day(ts) <= 15) = {b} GROUP BY event_type)"


@query(
    "WITH "
    + _METRICS.format(h=1, b="true")
    + """, g(metric, min, max, required) AS (VALUES ('error.mean', NULL::DOUBLE, 60.0::DOUBLE, true), ('view.mean', 10, NULL, true), ('click.n', 1, 5, true), ('missing.n', 1, NULL, true), ('optional.n', 1, NULL, false)),
r AS (SELECT metric, round(value, 6) AS value, CASE WHEN value IS NULL AND required THEN 'missing' WHEN value IS NULL THEN 'skipped' WHEN value > max THEN 'above' WHEN value < min THEN 'below' ELSE 'ok' END AS reason FROM g LEFT JOIN m1 USING (metric))
SELECT metric, value, reason, reason IN ('ok', 'skipped') AS passed FROM r"""
)
def gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.flatten_metrics(_month(spark, sf_dir, 1))
    return tidy(E.evaluate_gates(E.gate_table(spark, _GATES), m), "metric", "value", "reason", "passed")


@query(
    "WITH "
    + _METRICS.format(h=1, b="true")
    + ", bare AS (SELECT string_split(metric, '.')[2] AS metric, arg_max(value, string_split(metric, '.')[1]) AS value FROM m1 GROUP BY 1) SELECT metric, round(value, 6) AS value FROM (SELECT * FROM m1 UNION ALL SELECT * FROM bare)"
)
def metrics_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixed metrics, and bare ones: of several results with a metric the last, by name."""
    return tidy(E.flatten_metrics(_month(spark, sf_dir, 1)))


@query(
    "WITH "
    + _METRICS.format(h=1, b="true")
    + ", "
    + _METRICS.format(h=2, b="false")
    + """ SELECT metric, round(m2.value, 6) AS candidate, round(m1.value, 6) AS baseline, round(m2.value - m1.value, 6) AS delta,
CASE WHEN CASE WHEN metric = 'error.mean' THEN m2.value - m1.value > 0.5 ELSE m2.value - m1.value < -0.5 END THEN 'FAIL' ELSE 'PASS' END AS status FROM m1 JOIN m2 USING (metric)"""
)
def no_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [E.flatten_metrics(_month(spark, sf_dir, h)).where(F.contains("metric", F.lit("."))) for h in (1, 2)]
    return tidy(E.no_regression(m[1], m[0], 0.5, lower_is_better=("error.mean",)), "metric", "candidate", "baseline", "delta", "status")


@query("SELECT event_type AS model, count(*) AS n, count(CASE WHEN value < 50 THEN 1 END) AS correct, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.model_table(load(spark, sf_dir, "events").withColumnRenamed("event_type", "model"), correct=F.col("value") < 50, ms="value"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns as reference and hypothesis."""
    c = load(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.col("role").alias("category"), F.col("text").alias("ref"), nxt.alias("hyp")).where("hyp is not null")


_NORM = r"list_filter(regexp_split_to_array(regexp_replace(replace(lower({t}), '-', ' '), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+'), lambda w: w <> '')"
_ASR = f"""
WITH a AS (SELECT conv_id, turn, role AS category, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations),
n AS (SELECT conv_id, turn, category, {_NORM.format(t="ref")} AS r, {_NORM.format(t="hyp")} AS h FROM a WHERE hyp IS NOT NULL)
"""


@query()
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rates (DuckDB's distance counts bytes, so there is no SQL)."""
    errors, n, m = X.cer_parts(F.col("ref"), F.col("hyp"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", errors.cast("bigint").alias("char_errors"), F.round(X.error_rate(errors, n, m), 6).alias("cer"))


@query(_ASR + " SELECT round(avg(CASE WHEN r = h THEN 1.0 ELSE 0.0 END), 6) AS exact_match, count(*) AS n FROM n")
def exact_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.exact_match_rate(_pairs(spark, sf_dir)))


@query()
def wer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.align(_pairs(spark, sf_dir)).drop("ref", "hyp"))


@query()
def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates overall and by role."""
    return tidy(E.corpus_wer(E.align(_pairs(spark, sf_dir)), "category"))


@query()
def wer_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation of every alignment, counted by kind."""
    ops = _pairs(spark, sf_dir).select(F.explode(U.alignment_ops(X.normalise(F.col("ref")), X.normalise(F.col("hyp")))).alias("o"))
    return ops.groupBy("o.op").agg(F.count("*").alias("n"))


@query()
def word_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training normaliser's word accuracy, pooled."""
    e = _pairs(spark, sf_dir).select(U.word_edits(X.normalise_training(F.col("ref")), X.normalise_training(F.col("hyp"))).alias("e"), X.n_words(X.normalise_training(F.col("ref"))).alias("n"))
    w = F.sum(F.col("e.substitutions") + F.col("e.deletions") + F.col("e.insertions")) / F.nullif(F.sum("n"), F.lit(0))
    return tidy(e.agg(F.coalesce(w, F.lit(0.0)).alias("wer"), F.greatest(1 - F.coalesce(w, F.lit(0.0)), F.lit(0.0)).alias("word_accuracy"), F.count("*").alias("n")))


_RUBRIC = r"""
SELECT conv_id, turn, round(((bare <> '')::INT + (CASE WHEN bare = '' THEN 0 ELSE greatest(len(regexp_extract_all(bare, '[.!?]+(\s|$)')), 1) END <= 3)::INT
 + (NOT regexp_matches(text, '(^|\n)\s*(#{1,6}\s|[-*+]\s|\d+\.\s|>\s|```)|\*\*|__|`'))::INT + (NOT regexp_matches(text, '(?i)https?://\S+|www\.\S+'))::INT) / 4.0::DOUBLE, 6) AS score
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM conversations WHERE role = 'assistant')
"""


@query(_RUBRIC)
def rubric_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(replies(spark, sf_dir).select("conv_id", "turn", X.rubric_score(F.col("text")).alias("score")))


@query("SELECT n_regionkey AS k, CAST(ceil(ceil(n / 16.0::DOUBLE) * 1.5::DOUBLE) AS BIGINT) AS steps FROM (SELECT n_regionkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def step_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimizer steps for a region's customers as rows."""
    j = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n")).select("k", C.estimate_steps(F.col("n"), 4, 4, 1, 1.5).alias("steps"))


@query()
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every turn."""
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(U.segments("text")).alias("n", "sentence")).withColumn("n", F.col("n").cast("bigint"))


@query(r"WITH s AS (SELECT conv_id, turn, regexp_extract_all(text, '(.+?[.!?]+)(?:\s+|$)', 1) AS found FROM conversations) SELECT conv_id, turn, CAST(len(found) AS BIGINT) AS n, array_to_string(found, '|') AS sentences FROM s")
def edge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "conversations").select("conv_id", "turn", X.edge_segments(F.col("text")).alias("found"))
    return found.select("conv_id", "turn", F.size("found").cast("bigint").alias("n"), F.array_join("found", "|").alias("sentences"))
