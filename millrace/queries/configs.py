"""Registered queries: configs and training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.links import parse_repo_refs
from millrace.functions.text import mask_secret, safe_name
from millrace.operators import configs as cf
from millrace.operators import training as tr
from millrace.queries import fixtures as fx
from millrace.queries.fixtures import Query, table
from millrace.sources.configs import listing_of, parse_configs

CODE_SQL = """CASE WHEN task NOT IN ('sft', 'chat', 'dpo', 'rl') THEN 'task'
  WHEN mode = 'gfs' AND len(prompts) = 0 THEN 'prompts'
  WHEN mode = 'gfs' AND len(list_filter(prompts, lambda p: trim(p) = '')) > 0 THEN 'prompt_blank'
  WHEN count < 1 THEN 'count' WHEN batch_size < 1 THEN 'batch_size' WHEN trim(model) = '' THEN 'model'
  WHEN coalesce(mode, 'standard') <> 'gfs' AND trim(coalesce(user_prompt, '')) = '' THEN 'user_prompt'
  WHEN mode = 'gfs' AND trim(source) = '' THEN 'source'
  WHEN mode = 'gfs' AND coalesce(max_source_chars, 8000) < 100 THEN 'max_source_chars' END"""
PROVIDER_SQL = "CASE WHEN starts_with(model, 'agentrouter/') THEN 'agentrouter' ELSE 'openrouter' END"
RULE_SQL = "[" + ", ".join(f"{{'pos': {i}, 'key': '{k}', 'text': '{t}'}}" for i, (k, t) in enumerate(fx.RULES.items())) + "]"
ACTIVE_SQL = f"list_filter({RULE_SQL}, lambda r: NOT list_contains(list_transform(coalesce(ignore, []), lambda k: trim(lower(k))), r.key))"


def with_key(spark):
    """The providers that have a key: one of the two."""
    return spark.sql("SELECT 'openrouter' AS provider")


def config_texts(spark, folder):
    """Configs as JSON texts; every tenth is broken."""
    columns = [c for c in fx.configs(spark, folder).columns if c != "name"]
    rows = fx.configs(spark, folder)
    text = F.to_json(F.struct(*columns))
    number = F.substring("name", 2, 20).cast("long")
    return rows.select("name", F.when(number % 10 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("text"))


def read_back(spark, folder):
    return listing_of(parse_configs(config_texts(spark, folder)))


def dispatched(spark, folder):
    grounded, standard = cf.dispatch(fx.configs(spark, folder))
    return grounded.select("name", F.lit("grounded").alias("runs_as")).unionByName(
        standard.select("name", F.lit("standard").alias("runs_as"))
    )


def united(spark, folder):
    grounded, standard = cf.dispatch(cf.with_defaults(fx.configs(spark, folder)))
    return cf.union_configs(
        grounded.select("name", "mode", "prompts"), standard.select("name", "mode", "user_prompt")
    ).select("name", "mode", "user_prompt", F.size("prompts").alias("n_prompts"))


def requested(spark, folder):
    """Names asked for on one command line each: a document's config and its neighbours, some unknown."""
    return table(spark, folder, "documents").selectExpr(
        "concat(' c', cast(doc_id as string), ' ,,c', cast(doc_id + 5 as string), ',') AS names", "doc_id AS request"
    )


def checked(spark, folder):
    names = cf.split_names(requested(spark, folder)).select("name").distinct()
    return cf.preflight(names, fx.configs(spark, folder), with_key(spark))


def training_runs(spark, folder):
    return table(spark, folder, "orders").selectExpr(*fx.RUN_COLUMNS)


RUNS = f"runs AS (SELECT {', '.join(fx.RUN_COLUMNS)} FROM orders), effective AS (SELECT * REPLACE (CASE WHEN coalesce(task_override, '') <> '' THEN task_override ELSE task END AS task) FROM runs)"
COMPAT_SQL = """CASE WHEN method = 'dpo' AND task <> 'dpo' THEN 'dpo_needs_dpo' WHEN task = 'dpo' AND method <> 'dpo' THEN 'dpo_rows_need_dpo'
  WHEN method IN ('grpo', 'ppo') AND task <> 'rl' THEN 'method_needs_rl' WHEN task = 'rl' AND method NOT IN ('grpo', 'ppo') THEN 'rl_rows_need_rl'
  WHEN method = 'ppo' AND reward_model IS NULL AND reward_fn IS NULL THEN 'ppo_needs_reward' WHEN method = 'other' THEN 'unsupported' END"""
FITS_SQL = "((method IN ('lora', 'qlora', 'full') AND task IN ('sft', 'chat')) OR (method = 'dpo' AND task = 'dpo') OR (method IN ('grpo', 'ppo') AND task = 'rl'))"


def steps(spark, folder):
    count = tr.training_steps(F.col("count"), F.col("batch"), F.col("accum"), F.col("epochs"))
    return training_runs(spark, folder).select("run", count.alias("total_steps"))


def links(spark, folder):
    return table(spark, folder, "pages").selectExpr(*[c.format("STRING") for c in fx.LINK_COLUMNS])


LINKS = f"links AS (SELECT {', '.join(c.format('VARCHAR') for c in fx.LINK_COLUMNS)} FROM pages)"
REPO_SQL = f"""WITH {LINKS}, cleaned AS (SELECT page_id, rtrim(trim(link), '/') AS c FROM links),
cut AS (SELECT page_id, c, starts_with(c, 'http') AS is_url, list_filter(string_split(CASE WHEN starts_with(c, 'http')
  THEN regexp_extract(c, '^https?://[^/?#]*([^?#]*)', 1) ELSE c END, '/'), lambda p: p <> '') AS parts FROM cleaned),
marked AS (SELECT *, len(parts) AS n, list_min(list_filter([list_position(parts, 'resolve'), list_position(parts, 'blob'), list_position(parts, 'raw')], lambda p: p > 0)) AS pos FROM cut),
parsed AS (SELECT page_id, CASE WHEN is_url AND n >= 2 AND pos IS NOT NULL THEN array_to_string(parts[1:pos - 1], '/') WHEN is_url THEN array_to_string(parts[1:2], '/')
  WHEN n >= 3 AND ends_with(parts[-1], '.gguf') THEN array_to_string(parts[1:n - 1], '/') WHEN n IN (1, 2) THEN array_to_string(parts, '/') ELSE '' END AS repo,
  CASE WHEN is_url AND n >= 2 AND pos IS NOT NULL AND n > pos THEN parts[pos + 1] ELSE 'main' END AS rev,
  CASE WHEN is_url AND n >= 2 AND pos IS NOT NULL AND n > pos + 1 THEN array_to_string(parts[pos + 2:n], '/') WHEN NOT is_url AND n >= 3 AND ends_with(parts[-1], '.gguf') THEN parts[-1] END AS f FROM marked)
SELECT page_id, CASE WHEN repo <> '' THEN repo END AS repo_id, CASE WHEN repo <> '' THEN rev END AS revision, CASE WHEN repo <> '' THEN f END AS file,
  repo <> '' AS ok, CASE WHEN repo <> '' THEN coalesce(ends_with(f, '.gguf'), false) END AS is_gguf FROM parsed"""

TEXTS = dict(base="You write rows.", intro="Rules:", rules=fx.RULES, outro="Follow them.", ending="JSON lines only.", grounded_ending=" Use the source.")


def results(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_custkey AS run_id", "o_orderkey AS position", "CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS error"
    )


RESULTS = "results AS (SELECT o_custkey AS run_id, o_orderkey AS position, CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS error FROM orders)"


def prompts(spark, folder):
    return table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS prompt",
        "CASE WHEN turn % 3 <> 2 THEN CAST(turn % 3 AS DOUBLE) END AS temperature",
    )


QUERIES = {
    "config_scan": Query(
        read_back,
        f"WITH {fx.CONFIGS}, numbered AS (SELECT *, CAST(substring(name, 2) AS BIGINT) % 10 <> 0 AS ok FROM configs) SELECT name, "
        "CASE WHEN ok THEN coalesce(mode, 'standard') ELSE '?' END AS mode, CASE WHEN ok THEN task ELSE '?' END AS task, "
        "CASE WHEN ok THEN model ELSE '?' END AS model, CASE WHEN ok THEN CAST(count AS VARCHAR) ELSE '?' END AS count FROM numbered",
    ),
    "config_listing": Query(
        lambda spark, folder: cf.config_listing(fx.configs(spark, folder)),
        f"WITH {fx.CONFIGS} SELECT name, coalesce(mode, 'standard') AS mode, task, model, CAST(count AS VARCHAR) AS count FROM configs ORDER BY name",
    ),
    "config_dispatch": Query(
        dispatched, f"WITH {fx.CONFIGS} SELECT name, CASE WHEN mode = 'gfs' THEN 'grounded' ELSE 'standard' END AS runs_as FROM configs"
    ),
    "config_defaults": Query(
        lambda spark, folder: cf.with_defaults(fx.configs(spark, folder)).select(
            "name", "mode", "glob", "max_source_chars", F.size("ignore").alias("n_ignored")),
        f"WITH {fx.CONFIGS} SELECT name, coalesce(mode, 'standard') AS mode, coalesce(\"glob\", '') AS \"glob\", "
        "coalesce(max_source_chars, 8000) AS max_source_chars, CAST(coalesce(len(ignore), 0) AS INTEGER) AS n_ignored FROM configs",
    ),
    "config_validate": Query(
        lambda spark, folder: cf.validate_configs(fx.configs(spark, folder)),
        f"WITH {fx.CONFIGS}, coded AS (SELECT name, {CODE_SQL} AS code FROM configs) SELECT name, code IS NULL AS ok, code FROM coded",
    ),
    "preflight": Query(
        checked,
        f"WITH {fx.CONFIGS}, wanted AS (SELECT 'c' || CAST(doc_id AS VARCHAR) AS name FROM documents UNION SELECT 'c' || CAST(doc_id + 5 AS VARCHAR) FROM documents), "
        f"coded AS (SELECT name, {CODE_SQL} AS code, {PROVIDER_SQL} AS provider FROM configs), "
        "judged AS (SELECT w.name, CASE WHEN c.name IS NULL THEN 'not_found' WHEN code IS NOT NULL THEN 'invalid_' || code "
        "WHEN provider = 'agentrouter' THEN 'no_key' END AS problem FROM wanted w LEFT JOIN coded c ON w.name = c.name) "
        "SELECT name, problem FROM judged WHERE problem IS NOT NULL",
    ),
    "split_names": Query(
        lambda spark, folder: cf.split_names(requested(spark, folder)),
        "SELECT doc_id AS request, 'c' || CAST(doc_id AS VARCHAR) AS name FROM documents UNION ALL "
        "SELECT doc_id, 'c' || CAST(doc_id + 5 AS VARCHAR) FROM documents",
    ),
    "provider_route": Query(
        lambda spark, folder: cf.provider_route(fx.configs(spark, folder)).select("name", "provider", "slug"),
        f"WITH {fx.CONFIGS} SELECT name, {PROVIDER_SQL} AS provider, CASE WHEN starts_with(model, 'agentrouter/') "
        "THEN substring(model, 13) ELSE model END AS slug FROM configs",
    ),
    "provider_key_check": Query(
        lambda spark, folder: cf.missing_keys(fx.configs(spark, folder), with_key(spark)),
        f"WITH {fx.CONFIGS} SELECT name, {PROVIDER_SQL} AS provider FROM configs WHERE {PROVIDER_SQL} <> 'openrouter'",
    ),
    "active_rules": Query(
        lambda spark, folder: cf.active_rules(fx.configs(spark, folder), fx.RULES),
        f"WITH {fx.CONFIGS}, kept AS (SELECT name, unnest({ACTIVE_SQL}) AS r FROM configs) SELECT name, r.pos AS pos, r.key AS key FROM kept",
    ),
    "rule_prompt": Query(
        lambda spark, folder: cf.rule_prompt(fx.configs(spark, folder), **TEXTS),
        f"WITH {fx.CONFIGS}, kept AS (SELECT name, mode, list_transform({ACTIVE_SQL}, lambda r: r.text) AS texts FROM configs) SELECT name, "
        "'You write rows.' || CASE WHEN len(texts) > 0 THEN chr(10) || chr(10) || 'Rules:' || chr(10) || chr(10) || array_to_string(texts, chr(10) || chr(10)) "
        "|| chr(10) || chr(10) || 'Follow them.' ELSE '' END || chr(10) || chr(10) || 'JSON lines only.' || CASE WHEN mode = 'gfs' THEN ' Use the source.' ELSE '' END AS system FROM kept",
    ),
    "union_configs": Query(
        united,
        f"WITH {fx.CONFIGS} SELECT name, coalesce(mode, 'standard') AS mode, CASE WHEN coalesce(mode, '') <> 'gfs' THEN user_prompt END AS user_prompt, "
        "CASE WHEN mode = 'gfs' THEN CAST(len(prompts) AS INTEGER) END AS n_prompts FROM configs",
    ),
    "config_status": Query(
        lambda spark, folder: cf.config_status(results(spark, folder)),
        f"WITH {RESULTS} SELECT run_id, count(*) AS configs, count(error) AS failed, count(error) > 0 AS run_failed FROM results GROUP BY run_id",
    ),
    "config_status_sequential": Query(
        lambda spark, folder: cf.sequential_status(results(spark, folder)),
        f"WITH {RESULTS} SELECT run_id, count(*) AS configs, min(position) FILTER (error IS NOT NULL) AS stopped_at, count(error) > 0 AS run_failed "
        "FROM results GROUP BY run_id",
    ),
    "method_task_compat": Query(
        lambda spark, folder: tr.check_compat(training_runs(spark, folder)),
        f"WITH {RUNS} SELECT run, method, task, {COMPAT_SQL} AS code FROM effective",
    ),
    "compat_join": Query(
        lambda spark, folder: tr.incompatible(training_runs(spark, folder)),
        f"WITH {RUNS} SELECT run, method, task FROM effective WHERE NOT {FITS_SQL}",
    ),
    "training_steps": Query(
        steps, f"WITH {RUNS} SELECT run, greatest(1, count // (batch * accum)) * epochs AS total_steps FROM runs"
    ),
    "repo_ref_parse": Query(
        lambda spark, folder: parse_repo_refs(links(spark, folder)).drop("link"), REPO_SQL
    ),
    "safe_name": Query(
        lambda spark, folder: links(spark, folder).select("page_id", safe_name(F.col("link")).alias("name")),
        f"WITH {LINKS} SELECT page_id, replace(link, '/', '--') AS name FROM links",
    ),
    "mask_secret": Query(
        lambda spark, folder: links(spark, folder).select("page_id", mask_secret(F.col("link")).alias("shown")),
        f"WITH {LINKS} SELECT page_id, CASE WHEN length(link) > 12 THEN left(link, 8) || '...' || right(link, 4) ELSE '****' END AS shown FROM links",
    ),
    "prompt_defaults": Query(
        lambda spark, folder: tr.gen_params(prompts(spark, folder)).select("conv_id", "turn", "prompt", "max_tokens", "temperature", "do_sample"),
        "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS prompt, 256 AS max_tokens, "
        "CASE WHEN turn % 3 <> 2 THEN CAST(turn % 3 AS DOUBLE) ELSE 0.7 END AS temperature, turn % 3 <> 0 AS do_sample FROM conversations",
    ),
}
