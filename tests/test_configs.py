from pyspark.sql import functions as F
import pytest

from millrace.functions.links import parse_repo_refs
from millrace.functions.udfs import reward_score, tokenizer_udf, word_reward
from millrace.operators import configs as cf
from millrace.operators import training as tr

GOOD = dict(name="n", description="", mode=None, user_prompt="p", prompts=None, source=None, glob=None, max_source_chars=None,
            model="m", task="sft", count=1, temperature=9.9, batch_size=1, ignore=None)
GROUNDED = {**GOOD, "mode": "gfs", "user_prompt": None, "prompts": ["a", "b"], "source": "s"}
CASES = [
    (GOOD, None), (GROUNDED, None), ({**GOOD, "task": "x", "count": 0}, "task"), ({**GOOD, "count": 0, "batch_size": 0}, "count"),
    ({**GOOD, "batch_size": 0}, "batch_size"), ({**GOOD, "model": "  "}, "model"), ({**GOOD, "user_prompt": "\t"}, "user_prompt"),
    ({**GROUNDED, "prompts": []}, "prompts"), ({**GROUNDED, "prompts": ["a", " "]}, "prompt_blank"), ({**GROUNDED, "source": " "}, "source"),
    ({**GROUNDED, "max_source_chars": 99}, "max_source_chars"), ({**GROUNDED, "max_source_chars": 100}, None),
    ({**GROUNDED, "prompts": [], "count": 0}, "prompts"), ({**GOOD, "mode": "other", "max_source_chars": 1}, None),
]


def frame(spark, rows):
    return spark.createDataFrame([{**row, "name": f"c{i}"} for i, row in enumerate(rows)], cf.CONFIG_SCHEMA)


def test_first_broken_rule_wins(spark):
    got = {r.name: (r.ok, r.code) for r in cf.validate_configs(frame(spark, [row for row, _ in CASES])).collect()}
    assert got == {f"c{i}": (code is None, code) for i, (_, code) in enumerate(CASES)}


def test_preflight_stops_before_work(spark):
    configs = frame(spark, [GOOD, {**GOOD, "model": "agentrouter/x"}, {**GOOD, "count": 0}])
    keys = spark.createDataFrame([("openrouter",), ("unknown",), ("openrouter",)], "provider string")
    asked = spark.createDataFrame([("c0",), ("c1",), ("c2",), ("c9",)], "name string")
    problems = cf.preflight(asked, configs, keys)
    assert dict(problems.collect()) == {"c1": "no_key", "c2": "invalid_count", "c9": "not_found"}
    with pytest.raises(ValueError, match="config c1: no_key"):
        cf.stop_on_problems(problems)
    cf.stop_on_problems(cf.preflight(asked.filter("name = 'c0'"), configs, keys))
    assert [tuple(r) for r in cf.missing_keys(configs, keys).collect()] == [("c1", "agentrouter")]


def test_routes(spark):
    configs = frame(spark, [{**GOOD, "model": m} for m in ("agentrouter/a/b", "a/agentrouter/b", "x/y")])
    rows = cf.provider_route(configs, {"agentrouter/": "agentrouter", "x/": "other"}).orderBy("name").collect()
    assert [(r.provider, r.slug) for r in rows] == [("agentrouter", "a/b"), ("openrouter", "a/agentrouter/b"), ("other", "y")]


def test_rule_prompt(spark):
    rules = {"a": "A.", "b": "B."}
    configs = frame(spark, [GOOD, {**GOOD, "ignore": [" A "]}, {**GROUNDED, "ignore": ["B", "a", "zz"]}])
    rows = cf.rule_prompt(configs, "base", "in", rules, "out", "end", "!").orderBy("name").collect()
    assert [r.system for r in rows] == ["base\n\nin\n\nA.\n\nB.\n\nout\n\nend", "base\n\nin\n\nB.\n\nout\n\nend", "base\n\nend!"]
    assert sorted((r.name, r.key) for r in cf.active_rules(configs, rules).collect()) == [("c0", "a"), ("c0", "b"), ("c1", "b")]


def test_compatibility(spark):
    def code(method, task, override=None, fn=None, model=None):
        return (method, task, override, fn, model)

    cases = [
        (code("lora", "sft"), None), (code("full", "chat"), None), (code("dpo", "dpo"), None), (code("grpo", "rl"), None),
        (code("ppo", "rl", fn="f"), None), (code("ppo", "rl", model="m"), None), (code("ppo", "rl"), "ppo_needs_reward"),
        (code("dpo", "sft"), "dpo_needs_dpo"), (code("ppo", "dpo"), "dpo_rows_need_dpo"), (code("ppo", "sft"), "method_needs_rl"),
        (code("qlora", "rl"), "rl_rows_need_rl"), (code("lora", "rl", override="chat"), None), (code("other", "sft"), "unsupported"),
    ]
    rows = [(i, *case) for i, (case, _) in enumerate(cases)]
    runs = spark.createDataFrame(rows, "run int, method string, task string, task_override string, reward_fn string, reward_model string")
    assert {r.run: r.code for r in tr.check_compat(runs).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_training_steps(spark):
    df = spark.createDataFrame([(100, 4, 2, 3), (3, 4, 2, 2), (0, 1, 1, 1), (16, 4, 2, 1)], "c long, b int, a int, e int")
    steps = tr.training_steps(F.col("c"), F.col("b"), F.col("a"), F.col("e"))
    assert [r[0] for r in df.select(steps).collect()] == [36, 2, 1, 2]


LINKS = {
    "https://h/o/r/resolve/main/d/f.gguf": ("o/r", "main", "d/f.gguf", True), "https://h/o/r": ("o/r", "main", None, False),
    "https://h/o/r/blob/v2/f.txt/": ("o/r", "v2", "f.txt", False), "http://h/m?x=1#y": ("m", "main", None, False),
    "https://h/o/r/tree/main": ("o/r", "main", None, False), "https://h/o/r/raw": ("o/r", "main", None, False),
    "o/r": ("o/r", "main", None, False), " m/ ": ("m", "main", None, False), "o/r/f.gguf": ("o/r", "main", "f.gguf", True),
    "a/b/c/f.gguf": ("a/b/c", "main", "f.gguf", True), "o/r/x/y": None, "": None, "https://h": None, "https://h/resolve/x/y": None,
    "o//r": ("o/r", "main", None, False), "f.gguf": ("f.gguf", "main", None, False),
    "https://h/o/r/blob/raw/resolve": ("o/r", "raw", "resolve", False),
}


def test_links(spark):
    rows = parse_repo_refs(spark.createDataFrame([(link,) for link in LINKS], "link string")).collect()
    got = {r.link: (r.repo_id, r.revision, r.file, r.is_gguf) if r.ok else None for r in rows}
    assert got == LINKS


def test_user_functions(spark):
    df = spark.createDataFrame([("a", "x " * 30), ("b", "x " * 300), ("", "")], "prompt string, response string")
    score = reward_score(lambda prompts, responses: (responses.str.count("x") / 100).clip(upper=1.0))
    rows = df.select(score("prompt", "response").alias("s"), word_reward(F.col("response")).alias("n")).collect()
    assert [(r.s, r.n) for r in rows] == [(0.3, 0.3), (1.0, 1.0), (0.0, 0.0)]

    def factory():
        def encode(text):
            if "b" in text:
                raise RuntimeError
            return list(text)
        return encode

    texts = spark.createDataFrame([("acd",), ("b c",), (None,)], "t string")
    assert [r[0] for r in texts.select(tokenizer_udf(factory)("t")).collect()] == [3, 2, None]


def test_generation_defaults(spark):
    df = spark.createDataFrame([("", 0.0), (None, None), ("x", 0.5)], "prompt string, temperature double")
    rows = tr.gen_params(df).collect()
    assert [(r.prompt, r.max_tokens, r.temperature, r.do_sample) for r in rows] == [
        (" ", 256, 0.0, False), (" ", 256, 0.7, True), ("x", 256, 0.5, True),
    ]
