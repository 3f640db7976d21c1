"""Registry and bundles: incremental plans, manifest differences and checks, lifecycle states, policies, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import host_allowed, version_tuple
from ..session import scratch_path
from .positions import following_rows, free_name, number_rows

# Allowed moves between stages, and the kinds of a policy.
TRANSITIONS = {"candidate": ("staging", "retired"), "staging": ("production", "retired"), "production": ("retired",), "retired": ()}
FALLBACKS = ("degrade", "cloud", "refuse")
# What each export target can quantize to, and the packages that its conversion needs.
EXPORT_METHODS = {"onnx": ("int8", "none"), "gguf": ("q4_k_m", "int8", "none"), "mlx": ("int4", "int8", "none")}
EXPORT_NEEDS = {"onnx": ("optimum", "onnx"), "gguf": ("llama_cpp", "gguf"), "mlx": ("mlx_lm",)}


def diff(old: DataFrame, new: DataFrame, key: str, content: str, *keep: str) -> DataFrame:
    """(key, status, kept columns of the new side): added, changed, unchanged or removed, by one full join."""
    a = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_is"), *keep)
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"), *keep)


def diff_counts(differences: DataFrame) -> DataFrame:
    return differences.groupBy("status").agg(F.count("*").alias("n"))


def bundle_update(differences: DataFrame, size: str = "size") -> DataFrame:
    """What an update ships: counts, and the bytes of added and changed files."""
    ship = F.col("status").isin("added", "changed")
    return differences.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed", "unchanged")], F.coalesce(F.sum(F.when(ship, F.coalesce(size, F.lit(0)))), F.lit(0)).cast("long").alias("download_bytes"))


def verify_files(manifest: DataFrame, listing: DataFrame, required: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(path, problem) of manifest (path, sha256, size) against listing (path, sha256, size)."""
    m = manifest.select("path", F.col("sha256").alias("want"), F.col("size").alias("want_size"), F.lit(True).alias("listed"))
    a = listing.select("path", F.col("sha256").alias("have"), F.col("size").alias("have_size"), F.lit(True).alias("there"))
    j = m.join(a, "path", "full")
    if required is not None:
        j = j.join(required.select("path", F.lit(True).alias("needed")), "path", "full")
    else:
        j = j.withColumn("needed", F.lit(None).cast("boolean"))
    listed, there, needed = (F.coalesce(c, F.lit(False)) for c in ("listed", "there", "needed"))
    problems = F.array(
        F.when(needed & ~listed, "required file not in manifest"),
        F.when(needed & listed & ~there, "required file missing"),
        F.when(~needed & listed & ~there, "listed file missing"),
        F.when(listed & there & ~F.col("want").eqNullSafe(F.col("have")), "checksum mismatch"),
        F.when(listed & there & F.col("want_size").isNotNull() & (F.col("want_size") != F.col("have_size")), "size mismatch"),
        F.when(F.lit(strict) & there & ~listed, "unlisted file"),
    )
    return j.select("path", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def runtime_too_old(runtime: Column, least: Column) -> Column:
    return version_tuple(runtime) < version_tuple(least)


def transition_problem(current: Column, target: Column) -> Column:
    """Why a move is refused: unknown, terminal, same or not allowed; null where it is allowed."""
    ok = None
    for a, bs in TRANSITIONS.items():
        for b in bs:
            move = (current == a) & (target == b)
            ok = move if ok is None else ok | move
    return F.when(~target.isin(*TRANSITIONS), "unknown").when(current == "retired", "terminal").when(current == target, "same").when(~ok, "not allowed")


def lifecycles(requests: DataFrame, order: str = "seq") -> DataFrame:
    """One row a version that was registered: when it took each stage, and what retired it.

    (name, version, candidate_at, staging_at, production_at, retired_at, replaced_by.) A version
    reaches production once at most, and by its own requests alone; what other versions do
    to it is that the name's next production retires it, if it did not ask for that before.
    So requests are dealt by version once and folded there by minima, side by side, and only
    the productions of a name, in their order, look at the next one. Names, versions and
    ``order``, which names a request, are not null.
    """
    spark, key = requests.sparkSession, ["name", "version"]
    own = W.partitionBy(*key)
    when = lambda stage, more=F.lit(True): F.min(F.when((F.col("to") == stage) & more, F.col("seq")))
    asked = requests.select(*key, F.col(order).cast("long").alias("seq"), "to").where(F.col("to").isin(*TRANSITIONS))
    asked = asked.withColumn("candidate_at", when("candidate").over(own)).where("seq >= candidate_at")
    later = F.col("seq") > F.col("candidate_at")
    asked = asked.withColumn("asked_at", when("retired", later).over(own)).withColumn("staging_at", when("staging", later).over(own))
    asked = asked.withColumn("staging_at", F.when(F.col("asked_at").isNull() | (F.col("staging_at") < F.col("asked_at")), F.col("staging_at")))
    may = (F.col("seq") > F.col("staging_at")) & (F.col("asked_at").isNull() | (F.col("seq") < F.col("asked_at")))
    lives = asked.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("candidate_at", "staging_at", "asked_at")], when("production", may).alias("production_at"))
    # Ranges are found by a pass of their own, which is not to fold the requests again.
    path = scratch_path(spark, "lives")
    lives.write.parquet(path)
    lives = spark.read.schema(lives.schema).parquet(path)
    out = following_rows(lives, ["production_at"], ["name"], {"replaced_at": "production_at", "replaced_by": "version"})
    # Versions that were not produced come first, and nothing follows them.
    replaced = F.col("production_at").isNotNull() & F.col("replaced_at").isNotNull() & (F.col("asked_at").isNull() | (F.col("asked_at") > F.col("replaced_at")))
    return out.select(*key, "candidate_at", "staging_at", "production_at", F.when(replaced, F.col("replaced_at")).otherwise(F.col("asked_at")).alias("retired_at"), F.when(replaced, F.col("replaced_by")).alias("replaced_by"))


def _stage_before(seq: Column) -> Column:
    """The stage of a version (columns of ``lifecycles``) just before a request."""
    return (
        F.when(F.col("retired_at") < seq, "retired")
        .when(F.col("production_at") < seq, "production")
        .when(F.col("staging_at") < seq, "staging")
        .when(F.col("candidate_at") < seq, "candidate")
    )


def registry_log(requests: DataFrame, order: str = "seq") -> DataFrame:
    """The event log of promotions: (name, version, seq, from, to, reason), with the retirements that productions bring.

    Requests that aren't allowed are refused and leave no trace; ``audit`` tells which. A new
    production retires the one before it, at its own number and with a reason.
    """
    moves = F.array(
        *[
            F.struct(F.col(f"{to}_at").alias("seq"), _stage_before(F.col(f"{to}_at")).alias("from"), F.lit(to).alias("to"), (F.concat(F.lit("replaced by "), "replaced_by") if to == "retired" else F.lit(None).cast("string")).alias("reason"))
            for to in TRANSITIONS
        ]
    )
    return lifecycles(requests, order).select("name", "version", F.explode(F.filter(moves, lambda m: m["seq"].isNotNull())).alias("m")).select("name", "version", "m.seq", "m.from", "m.to", "m.reason")


def accepted_moves(requests: DataFrame, order: str = "seq") -> DataFrame:
    """(name, version, order, to) of the requests that were followed."""
    return registry_log(requests, order).where(F.col("reason").isNull()).select("name", "version", F.col("seq").alias(order), "to")


def current_stage(log: DataFrame) -> DataFrame:
    """The stage of each version: where its last event took it."""
    return log.groupBy("name", "version").agg(F.max_by("to", F.struct("seq", F.col("reason").isNotNull())).alias("stage"), F.max("seq").alias("seq"))


def audit(requests: DataFrame, order: str = "seq") -> DataFrame:
    """Adds the problem of each request against the version's stage at that time, null where it was followed; a version starts as a candidate."""
    lives = lifecycles(requests, order).drop("replaced_by")
    before = _stage_before(F.col(order))
    problem = F.when(before.isNull(), F.when(F.col("to") != "candidate", F.when(~F.col("to").isin(*TRANSITIONS), "unknown").otherwise("not allowed"))).otherwise(transition_problem(before, F.col("to")))
    return requests.join(lives, ["name", "version"], "left").select(*[F.col(f"`{c}`") for c in requests.columns], problem.alias("problem"))


def newest_first(artifacts: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0: artifacts by creation, newest first, then by name and version; any number of them."""
    back, at = free_name(artifacts.columns, "_back"), free_name(artifacts.columns, "rank")
    return number_rows(artifacts.withColumn(back, -F.col("created_at")), [back, "name", "version"], column=at).drop(back).withColumnRenamed(at, "rank")


def latest_by_stage(artifacts: DataFrame, stage: str) -> DataFrame:
    """The newest version of each name in a stage; versions break ties."""
    return artifacts.where(F.col("stage") == stage).groupBy("name").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"), F.max("created_at").alias("created_at"))


def policy_decision(kind: Column, target: Column, offline_only: Column, allowed: Column, fallback: Column, audio: Column) -> Column:
    """Why an edge action is refused; null where it is allowed."""
    network = F.when(offline_only, "offline only").when(~F.coalesce(host_allowed(target, allowed), F.lit(False)), "host not allowed")
    cloud = F.when(offline_only, "offline only").when(fallback != "cloud", "fallback is not cloud")
    store = F.when(audio == "none", "audio is not kept")
    return F.when(kind == "network", network).when(kind == "cloud_fallback", cloud).when(kind == "store_audio", store).otherwise(F.lit("unknown action"))


def policy_problems(offline_only: Column, allowed: Column, fallback: Column, max_ttfa_ms: Column) -> Column:
    """Contradictions inside a policy."""
    return F.filter(
        F.array(
            F.when(~fallback.isin(*FALLBACKS), "unknown fallback"),
            F.when(max_ttfa_ms <= 0, "max_ttfa_ms must be positive"),
            F.when(offline_only & (F.size(allowed) > 0), "offline with allowed hosts"),
            F.when(offline_only & (fallback == "cloud"), "offline with cloud fallback"),
            F.when(F.exists(allowed, lambda h: (h == "") | F.contains(h, F.lit("://"))), "allowed entry is no host"),
        ),
        lambda p: p.isNotNull(),
    )


def canary(device: Column, percent: float) -> Column:
    """Whether a device belongs to the first percent of a rollout."""
    return F.pmod(F.xxhash64(device), F.lit(10_000)) < F.lit(int(percent * 100))


def to_tags(metrics: Column, prefix: str, **lineage: Column) -> Column:
    """Lineage and metrics as one flat map of texts."""
    pairs = [x for k, v in lineage.items() for x in (F.lit(f"{prefix}.{k}"), F.coalesce(v.cast("string"), F.lit("")))]
    named = F.transform_keys(F.transform_values(metrics, lambda k, v: v.cast("string")), lambda k, v: F.concat(F.lit("metric."), k))
    return F.map_concat(F.create_map(*pairs), named) if pairs else named


def metrics_from_tags(tags: Column) -> Column:
    own = F.map_filter(tags, lambda k, v: k.startswith("metric."))
    return F.transform_values(F.transform_keys(own, lambda k, v: F.substring(k, F.lit(8), F.length(k))), lambda k, v: v.cast("double"))


def export_steps(plans: DataFrame) -> DataFrame:
    """Adds problems, steps (name, requires) and files to export plans; nothing is exported.

    A plan has base_model, target, out_dir, adapter_path, merge_adapter and method; a null
    method is none, a null merge_adapter true. A plan with problems has no steps or files.
    """
    target, method = F.col("target"), F.coalesce("method", F.lit("none"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    every = sorted({m for ms in EXPORT_METHODS.values() for m in ms})
    known = F.coalesce(target.isin(*EXPORT_METHODS), F.lit(False))
    fits = F.lit(False)
    for t, methods in EXPORT_METHODS.items():
        fits = fits | (target.eqNullSafe(t) & method.isin(*methods))
    problems = F.array(
        F.when(empty("base_model"), "no base model"), F.when(~known, "unknown target"), F.when(~method.isin(*every), "unknown quantization"),
        F.when(known & method.isin(*every) & ~fits, "quantization not for this target"), F.when(empty("out_dir"), "no output folder"),
    )
    step = lambda name, needs=(): F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), F.array(*[F.lit(n) for n in needs]).cast("array<string>").alias("requires"))
    merge = ~empty("adapter_path") & F.coalesce("merge_adapter", F.lit(True))
    is_ = lambda t: target == t
    quantized = method != "none"
    steps = F.array(
        step("validate"),
        F.when(merge, step("merge_adapter", ("peft", "transformers"))),
        *[F.when(is_(t), step(f"convert_{t}", needs)) for t, needs in EXPORT_NEEDS.items()],
        F.when(is_("onnx") & quantized, step("quantize_int8", ("onnxruntime",))),
        F.when(is_("gguf") & quantized, step(F.concat(F.lit("quantize_"), method), ("llama_cpp",))),
        step("write_manifest"),
    )
    own = {
        "onnx": [F.lit("model.onnx"), F.lit("config.json"), F.lit("tokenizer.json"), F.when(quantized, "model-int8.onnx")],
        "gguf": [F.lit("model-f16.gguf"), F.when(quantized, F.concat(F.lit("model-"), method, F.lit(".gguf")))],
        "mlx": [F.lit("weights.safetensors"), F.lit("config.json"), F.lit("tokenizer.json")],
    }
    files = F.lit(None).cast("array<string>")
    for t, names in own.items():
        files = F.when(is_(t), F.array(*names)).otherwise(files)
    there = lambda a: F.filter(a, lambda x: x.isNotNull())
    ok = F.size("problems") == 0
    out = plans.withColumn("problems", there(problems))
    return out.withColumn("steps", F.when(ok, there(steps)).otherwise(F.slice(there(steps), 1, 0))).withColumn("files", F.when(ok, there(files)).otherwise(F.array().cast("array<string>")))
