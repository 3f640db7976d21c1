"""Text corpora: sessions, splits, chat rows, preference pairs, dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .positions import free_name, number_rows

ROLES = ("system", "user", "assistant")
#: Fixed value: the instruction put before chats that have none.
SPOKEN_PROMPT = "You are a voice assistant. Reply in one to three short spoken sentences. Do not use markdown, lists, headings, code blocks or URLs."


def flatten_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions (id, turns array of structs turn, user, assistant_text) to one row an utterance.

    ``user`` has id, text and meta (map). Session, turn and assistant text are added to
    meta where it lacks them.
    """
    rows = sessions.select(F.col("id").alias("_session"), F.explode("turns").alias("t"))
    own = F.coalesce(F.col("t.user.meta"), F.create_map().cast("map<string,string>"))
    extra = F.map_filter(
        F.create_map(F.lit("session"), F.col("_session").cast("string"), F.lit("turn"), F.col("t.turn").cast("string"), F.lit("assistant_text"), F.col("t.assistant_text")),
        lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k),
    )
    return rows.select("t.user.id", "t.user.text", F.map_concat(own, extra).alias("meta"))


def scrub_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named text fields without personal data, and ``pii``: the replacements of each kind over these fields, those that occur."""
    total: dict[str, Column] = {}
    out = rows
    for f in fields:
        text, counts = X.scrub(F.col(f))
        for kind, n in counts.items():
            total[kind] = total[kind] + F.coalesce(n, F.lit(0)) if kind in total else F.coalesce(n, F.lit(0))
        out = out.withColumn(f"_clean_{f}", text)
    out = out.withColumn("pii", X.pii_map(total))
    for f in fields:
        out = out.withColumn(f, F.col(f"_clean_{f}")).drop(f"_clean_{f}")
    return out


def pii_totals(scrubbed: DataFrame) -> DataFrame:
    """(kind, n) over all rows of ``scrub_fields``."""
    return scrubbed.select(F.explode("pii").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))


def filter_category(utterances: DataFrame, category: str) -> DataFrame:
    return utterances.where(F.col("meta")["category"] == category)


def category_counts(utterances: DataFrame) -> DataFrame:
    """(category, n) of utterances; those without one are uncategorised."""
    return utterances.groupBy(F.coalesce(F.col("meta")["category"], F.lit("uncategorised")).alias("category")).agg(F.count("*").alias("n"))


def default_ids(rows: DataFrame, stem: str, order: str) -> DataFrame:
    """Missing ids become stem-000000 by 0-based record number in ``order``, which names each row (see ``number_rows``)."""
    at = free_name(rows.columns, "_at")
    return number_rows(rows, [order], column=at).withColumn("id", F.coalesce("id", F.format_string(f"{stem}-%06d", at))).drop(at)


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the first in order, with its columns; combines before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def ordered_distinct(rows: DataFrame, item: str, place: str) -> DataFrame:
    """(item, rank): each item once, in order of its first place, ids breaking ties. For seeds of a query, not for documents."""
    first = rows.groupBy(item).agg(F.min(place).alias("_at"))
    return first.select(item, F.row_number().over(W.orderBy("_at", item)).alias("rank"))


def pairs_from_scores(scored: DataFrame, *, key: str = "prompt_id", text: str = "text", score: str = "score", position: str = "pos", min_margin: float = 0.0, all_pairs: bool = False) -> DataFrame:
    """(key, chosen, rejected, chosen_score, rejected_score, margin) of each prompt's candidates.

    Best against worst (the earliest of the best, the last of the worst), or every pair of
    a higher and a lower score. Equal scores make no pair. Best and worst are picked by
    aggregates that combine before the shuffle; all pairs come from a join on the prompt.
    """
    rows = scored.where(F.col(key).isNotNull() & F.col(score).isNotNull()).select(key, F.col(text).alias("t"), F.col(score).cast("double").alias("s"), F.col(position).alias("p"))
    if all_pairs:
        a = rows.select(key, F.col("t").alias("chosen"), F.col("s").alias("chosen_score"))
        b = rows.select(F.col(key).alias("_k"), F.col("t").alias("rejected"), F.col("s").alias("rejected_score"))
        made = a.join(b, (F.col(key) == F.col("_k")) & (F.col("chosen_score") > F.col("rejected_score"))).drop("_k")
    else:
        best, worst = F.max(F.struct("s", (-F.col("p")).alias("q"), "t")), F.min(F.struct("s", (-F.col("p")).alias("q"), "t"))
        made = rows.groupBy(key).agg(best.alias("b"), worst.alias("w"), F.count("*").alias("n")).where("n > 1")
        made = made.select(key, F.col("b.t").alias("chosen"), F.col("w.t").alias("rejected"), F.col("b.s").alias("chosen_score"), F.col("w.s").alias("rejected_score"))
    made = made.withColumn("margin", F.col("chosen_score") - F.col("rejected_score"))
    return made.where((F.col("margin") > 0) & (F.col("margin") >= min_margin))


def pairs_from_style(replies: DataFrame, *, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """(key, chosen, rejected, rejected_reasons): each reply that passes the style rules with each of its prompt that fails."""
    judged = replies.where(F.col(key).isNotNull()).withColumn("rules", X.spoken_style_violations(F.col(text)))
    good = judged.where(F.size("rules") == 0).select(key, F.col(text).alias("chosen"))
    bad = judged.where(F.size("rules") > 0).select(key, F.col(text).alias("rejected"), F.array_join("rules", ",").alias("rejected_reasons"))
    return good.join(bad, key)


def build_pairs(scored: DataFrame | None, styled: DataFrame | None, source: str | None = None, **options: object) -> DataFrame:
    """Pairs of either kind with their source, one table."""
    parts = []
    if scored is not None:
        parts.append(pairs_from_scores(scored, **options).withColumn("source", F.lit(source or "scores")))
    if styled is not None:
        parts.append(pairs_from_style(styled, key=options.get("key", "prompt_id")).withColumn("source", F.lit(source or "spoken_style")))
    if not parts:
        raise ValueError("pairs need candidates or replies")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``problem``: why a pair cannot be trained on, null if it can."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    problem = F.when(empty("prompt"), "prompt").when(empty("chosen"), "chosen").when(empty("rejected"), "rejected").when(F.col("chosen") == F.col("rejected"), "chosen equals rejected")
    return pairs.withColumn("problem", problem)


def validate_audio(rows: DataFrame) -> DataFrame:
    """Adds ``problem``: the required fields that an audio row lacks, null if it has both."""
    lacks = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in ("audio_path", "text")]
    return rows.withColumn("problem", F.nullif(F.concat_ws(",", *lacks), F.lit("")))


def missing_audio(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose audio file is not in the listing (path)."""
    return rows.join(listing.select(F.col("path").alias("audio_path")).distinct(), "audio_path", "left_anti")


def preference_rows(pairs: DataFrame) -> DataFrame:
    """Pairs with their numbers of words, as training reads them."""
    return pairs.select("prompt", "chosen", "rejected", X.n_words(F.col("chosen")).alias("chosen_words"), X.n_words(F.col("rejected")).alias("rejected_words"))


def preference_stats(pairs: DataFrame) -> DataFrame:
    c, r = X.n_words(F.col("chosen")), X.n_words(F.col("rejected"))
    share = lambda x: F.avg(x.cast("double"))
    return pairs.agg(
        F.count("*").alias("n"),
        F.avg(c).alias("mean_chosen_words"),
        F.avg(r).alias("mean_rejected_words"),
        share(c < r).alias("chosen_shorter_fraction"),
        share(X.is_spoken_training(F.col("chosen"))).alias("chosen_spoken_fraction"),
        share(X.is_spoken_training(F.col("rejected"))).alias("rejected_spoken_fraction"),
    )


def chat_messages(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", system_prompt: str = SPOKEN_PROMPT) -> DataFrame:
    """(key, messages): the turns of each conversation in order, assistants without markdown.

    An unknown role raises; the system prompt goes before conversations that start otherwise.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("unknown chat role "), F.coalesce("role", F.lit("null")))).cast("string"))
    content = F.when(F.col("role") == "assistant", X.strip_markdown_training(F.col("text"))).otherwise(F.col("text"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), role.alias("role"), content.alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    chats = turns.groupBy(key).agg(sorted_.alias("messages"))
    if not system_prompt:
        return chats
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    return chats.withColumn("messages", F.when(F.col("messages")[0]["role"] == "system", F.col("messages")).otherwise(F.concat(first, F.col("messages"))))


def prompt_response_messages(prompt: Column, response: Column, system_prompt: str = SPOKEN_PROMPT) -> Column:
    """The chat of a prompt and its response, for rows of that shape."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    head = [message("system", F.lit(system_prompt))] if system_prompt else []
    return F.array(*head, message("user", prompt), message("assistant", X.strip_markdown_training(response)))


def history_window(turns: DataFrame, n: int, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds ``history``: the (role, text) of the n rows before each, in order."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))


def token_row(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", X.words(F.col("text"))).withColumn("n_tokens", F.size("tokens"))


def field_presence(rows: DataFrame, json: str = "line") -> DataFrame:
    """(field, rows_with) of the top-level keys of JSON rows."""
    return rows.select(F.explode(F.json_object_keys(json)).alias("field")).groupBy("field").agg(F.count("*").alias("rows_with"))


def missing_required(rows: DataFrame, required: Sequence[str], json: str = "line") -> DataFrame:
    """Required fields that some row lacks, with the number of rows that have them."""
    parsed = F.json_object_keys(json)
    one = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.array_contains(parsed, f)).alias(f) for f in required])
    return one.unpivot(["rows"], list(required), "field", "rows_with").where("rows_with < rows")


def audio_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n"),
        F.sum("duration_s").alias("total_duration_s"),
        F.count("duration_s").alias("rows_with_duration"),
        F.array_sort(F.collect_set(F.nullif("speaker", F.lit("")))).alias("speakers"),
        F.coalesce(F.avg(X.n_words(F.col("text"))), F.lit(0.0)).alias("mean_words"),
    )


def records_sha256(rows: DataFrame, hash_col: str, order: str, key: str | None = None) -> DataFrame:
    """One hash of each group's record hashes in order. The order makes it one value a group: use groups of bounded size."""
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, hash_col))), lambda r: r[hash_col]), "\n"), 256)
    return (rows.groupBy(key) if key else rows).agg(joined.alias("sha256"))


def estimate_steps(rows: Column, per_device: int, accumulation: int, workers: int, epochs: float, max_steps: int = 0) -> Column:
    """Optimizer steps: batches of an epoch, rounded up, times epochs, rounded up; max_steps overrides."""
    if max_steps > 0:
        return F.lit(max_steps).cast("long")
    return F.when(rows <= 0, F.lit(0)).otherwise(F.ceil(F.ceil(rows / F.lit(per_device * accumulation * workers)) * F.lit(float(epochs)))).cast("long")
