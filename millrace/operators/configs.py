"""Synthesis configs: defaults, dispatch, validation, preflight, prompts from rules.

One table holds both modes; a standard config leaves ``prompts`` and ``source`` NULL,
a grounded one leaves ``user_prompt`` NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import jsonrow
from millrace.functions.text import is_blank, split_names as names_of, strip

CONFIG_SCHEMA = (
    "name string, description string, mode string, user_prompt string, prompts array<string>, source string, "
    "glob string, max_source_chars int, model string, task string, count int, temperature double, "
    "batch_size int, ignore array<string>"
)

# Modes, limits, provider prefixes and the provider of all other models.
STANDARD, GROUNDED = "standard", "gfs"
MAX_SOURCE_CHARS, LEAST_SOURCE_CHARS = 8000, 100
PROVIDER_PREFIXES = {"agentrouter/": "agentrouter"}
DEFAULT_PROVIDER = "openrouter"


def with_defaults(configs: DataFrame) -> DataFrame:
    return configs.withColumns({
        "mode": F.coalesce("mode", F.lit(STANDARD)),
        "glob": F.coalesce("glob", F.lit("")),
        "max_source_chars": F.coalesce("max_source_chars", F.lit(MAX_SOURCE_CHARS)),
        "ignore": F.coalesce("ignore", F.array().cast("array<string>")),
    })


def dispatch(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(grounded, standard)`` configs; any mode but ``gfs`` is standard."""
    grounded = F.coalesce(F.col("mode"), F.lit(STANDARD)) == GROUNDED
    return configs.filter(grounded), configs.filter(~grounded)


def _empty(text: str) -> Column:
    return F.coalesce(is_blank(F.col(text)), F.lit(True))


def broken_rule() -> Column:
    """The first rule that a config breaks, in a fixed order; NULL for a config that breaks none."""
    grounded = F.coalesce("mode", F.lit(STANDARD)) == GROUNDED
    below_one = {name: F.coalesce(F.col(name) < 1, F.lit(True)) for name in ("count", "batch_size")}
    blank_prompt = F.exists("prompts", lambda p: F.coalesce(strip(p) == "", F.lit(True)))
    return (
        F.when(~F.coalesce(F.col("task").isin(*jsonrow.TASKS), F.lit(False)), "task")
        .when(grounded & F.coalesce(F.size("prompts") < 1, F.lit(True)), "prompts")
        .when(grounded & blank_prompt, "prompt_blank")
        .when(below_one["count"], "count")
        .when(below_one["batch_size"], "batch_size")
        .when(_empty("model"), "model")
        .when(~grounded & _empty("user_prompt"), "user_prompt")
        .when(grounded & _empty("source"), "source")
        .when(grounded & (F.coalesce("max_source_chars", F.lit(MAX_SOURCE_CHARS)) < LEAST_SOURCE_CHARS), "max_source_chars")
    )


def validate_configs(configs: DataFrame) -> DataFrame:
    """``(name, ok, code)``: the first rule that a config breaks."""
    return configs.select("name", broken_rule().alias("code")).select("name", F.col("code").isNull().alias("ok"), "code")


def split_names(df: DataFrame, names: str = "names") -> DataFrame:
    """One row per config name out of comma-separated lists."""
    rest = [c for c in df.columns if c != names]
    return df.select(*rest, F.explode(names_of(F.col(names))).alias("name"))


def provider_route(configs: DataFrame, prefixes: dict[str, str] | None = None, default: str = DEFAULT_PROVIDER) -> DataFrame:
    """Add the ``provider`` that a model's prefix picks and the ``slug`` without that prefix.

    Of several prefixes that fit, the longest one counts.
    """
    prefixes = PROVIDER_PREFIXES if prefixes is None else prefixes
    prefixes = {prefix: prefixes[prefix] for prefix in sorted(prefixes, key=len)}
    model = F.col("model")
    provider = reduce(lambda rest, p: F.when(model.startswith(p), prefixes[p]).otherwise(rest), prefixes, F.lit(default))
    slug = reduce(
        lambda rest, p: F.when(model.startswith(p), F.substring(model, len(p) + 1, 2**31 - 1)).otherwise(rest),
        prefixes, model,
    )
    return configs.withColumns({"provider": provider, "slug": slug})


def _with_key(providers: DataFrame, prefixes: dict[str, str] | None, default: str) -> DataFrame:
    """The providers with a key that a model can route to: no more than there are routes."""
    routes = {*(PROVIDER_PREFIXES if prefixes is None else prefixes).values(), default}
    return F.broadcast(providers.filter(F.col("provider").isin(*routes)).select("provider").distinct())


def missing_keys(
    configs: DataFrame, providers: DataFrame, prefixes: dict[str, str] | None = None, default: str = DEFAULT_PROVIDER
) -> DataFrame:
    """Configs whose provider has no key. ``providers`` holds the ``provider`` names that have one."""
    routed = provider_route(configs, prefixes, default)
    return routed.join(_with_key(providers, prefixes, default), "provider", "left_anti").select("name", "provider")


def preflight(
    requested: DataFrame, configs: DataFrame, providers: DataFrame,
    prefixes: dict[str, str] | None = None, default: str = DEFAULT_PROVIDER,
) -> DataFrame:
    """What stops a run before any work: ``(name, problem)`` for each requested config that fails."""
    names = requested.select("name")
    unknown = names.join(configs.select("name"), "name", "left_anti").select("name", F.lit("not_found").alias("problem"))
    wanted = configs.join(names, "name", "left_semi")
    checked = provider_route(wanted, prefixes, default).withColumn("_code", broken_rule())
    keyed = checked.join(_with_key(providers, prefixes, default).withColumn("_keyed", F.lit(True)), "provider", "left")
    problem = F.when(F.col("_code").isNotNull(), F.concat(F.lit("invalid_"), F.col("_code"))).when(F.col("_keyed").isNull(), F.lit("no_key"))
    return unknown.unionByName(keyed.select("name", problem.alias("problem")).filter(F.col("problem").isNotNull()))


def run_problems(configs: DataFrame, mode: str) -> DataFrame:
    """``(name, problem)`` of the configs that a run of ``mode`` must not ask a model for."""
    of_mode = F.coalesce("mode", F.lit(STANDARD)) == GROUNDED
    other = of_mode if mode == STANDARD else ~of_mode
    problem = F.coalesce(F.concat(F.lit("invalid_"), broken_rule()), F.when(other, F.lit("other_mode")))
    return configs.select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())


def stop_on_problems(problems: DataFrame) -> None:
    """Fail before any work when a requested config has a problem."""
    first = problems.orderBy("name").first()
    if first:
        raise ValueError(f"config {first['name']}: {first['problem']}")


def _ignored() -> Column:
    return F.transform(F.coalesce("ignore", F.array().cast("array<string>")), lambda key: strip(F.lower(key)))


def _active(rules: dict[str, str], ignored: Column) -> Column:
    table = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.lit(t).alias("text")) for i, (k, t) in enumerate(rules.items())])
    return F.filter(table, lambda rule: ~F.array_contains(ignored, rule["key"]))


def active_rules(configs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(name, pos, key)``: each config's rules that it does not ignore.

    The user's rule list goes in as a literal, so that no join is needed.
    """
    return configs.select("name", F.explode(_active(rules, _ignored())).alias("rule")).select("name", "rule.pos", "rule.key")


def system_text(base: str, intro: str, rules: dict[str, str], outro: str, ending: str, grounded_ending: str = "") -> Column:
    """A config's system text: base, the block of active rules if there is any, ending.

    All texts are the user's. Grounded configs get one more ending.
    """
    texts = F.transform(_active(rules, _ignored()), lambda rule: rule["text"])
    block = F.concat(F.lit(f"\n\n{intro}\n\n"), F.array_join(texts, "\n\n"), F.lit(f"\n\n{outro}"))
    grounded = F.coalesce("mode", F.lit(STANDARD)) == GROUNDED
    return F.concat(
        F.lit(base), F.when(F.size(texts) > 0, block).otherwise(""), F.lit(f"\n\n{ending}"),
        F.when(grounded, F.lit(grounded_ending)).otherwise(""),
    )


def rule_prompt(configs: DataFrame, base: str, intro: str, rules: dict[str, str], outro: str, ending: str, grounded_ending: str = "") -> DataFrame:
    """``(name, system)`` of each config."""
    return configs.select("name", system_text(base, intro, rules, outro, ending, grounded_ending).alias("system"))


def union_configs(*configs: DataFrame) -> DataFrame:
    """Several config tables as one job's input."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), configs)


def config_listing(configs: DataFrame) -> DataFrame:
    """Configs in path order, ``?`` for what a file does not say."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("task", "model", "count")}
    return configs.withColumn("mode", F.coalesce("mode", F.lit(STANDARD))).withColumns(shown).select(
        "name", "mode", "task", "model", "count"
    ).orderBy("name")


def config_status(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Per parallel run: how many configs failed, and whether the whole run did.

    ``results`` holds one row per config with an ``error`` that is NULL on success.
    """
    return results.groupBy(run).agg(
        F.count(F.lit(1)).alias("configs"), F.count("error").alias("failed"),
        F.bool_or(F.col("error").isNotNull()).alias("run_failed"),
    )


def sequential_status(results: DataFrame, run: str = "run_id", position: str = "position") -> DataFrame:
    """The same for a run of one config after another: nothing runs after the first failure."""
    first = results.groupBy(run).agg(F.min(F.when(F.col("error").isNotNull(), F.col(position))).alias("_stop"), F.count(F.lit(1)).alias("configs"))
    return first.select(run, "configs", F.col("_stop").alias("stopped_at"), F.col("_stop").isNotNull().alias("run_failed"))
