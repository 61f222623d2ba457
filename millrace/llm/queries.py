"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import audit, chat, decontam, forest, html, jaccard, licences, packing, pii, quality, search, suffix, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lost_lines"
    )


def chat_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return chat.collapse_snapshots(table(spark, folder, "conversations"))


def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(table(spark, folder, "pages"))


def pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_digest(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, folder, "documents"))


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"), urls.rule_table(spark))


def licence_dice(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def kk_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.forest_duplicates(table(spark, folder, "documents"))


def mask_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_sql() -> str:
    word, spaces = sql_text(quality.WORD + "+"), "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

    def count_of(text: str, characters: str) -> str:
        return f"(length({text}) - length(translate({text}, {sql_text(characters)}, '')))"

    fails = f"""((NOT regexp_matches(l, {sql_text(quality.PROSE_END)})
            AND (length(trim(l, {spaces})) < {quality.PROSE_CHARS} OR NOT regexp_matches(l, {sql_text(quality.SENTENCE_MARK)})))
        OR ({count_of('l', quality.SEPARATORS)} >= 2 AND {count_of('l', quality.SEPARATORS)} * 4 >= len(regexp_extract_all(l, {word})))
        OR {count_of('l', quality.SYMBOLS)} * 10 > length(l)
        OR (length(l) >= 20 AND {count_of('l', quality.UPPER)} * 10 > length(l) * 6)
        OR regexp_matches(translate(l, '{quality.UPPER}', '{quality.LOWER}'), {sql_text('|'.join(quality.BOILERPLATE))}))"""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, {word}) AS ws,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {sql_text(quality.WORD)})) AS ls FROM d),
    g AS (SELECT r, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 3),
    s AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
    c AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM s WHERE n > 1) GROUP BY r),
    l AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE {fails}) AS lost, sum(length(l)) AS chars,
                 coalesce(sum(length(l)) FILTER (WHERE {fails}), 0) AS lost_chars FROM (SELECT r, unnest(ls) AS l FROM w) GROUP BY r),
    j AS (SELECT w.*, coalesce(n_repeat, 0) AS n_repeat, coalesce(n, 0) AS n, coalesce(lost, 0) AS lost,
                 coalesce(chars, 0) AS chars, coalesce(lost_chars, 0) AS lost_chars, len(ws) < 50 OR 100 * coalesce(n_repeat, 0) > 50 * len(ws) AS failed
          FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r))
    SELECT doc_id, len(ws) AS n_words, length(translate(t, {spaces}, '')) AS word_chars, {count_of('t', quality.SYMBOLS)} AS n_symbols,
           len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat AS n_repeat_words, failed AS base_failed,
           NOT failed AND lost_chars * 100 <= chars * {quality.MAX_LOST_PERCENT} AS kept, n AS n_lines, lost AS n_lost_lines FROM j"""


CHAT_SQL = """
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT *, list(md5(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS prefix FROM t),
    w AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE position = n_turns GROUP BY prefix),
    k AS (SELECT * FROM w ANTI JOIN (SELECT DISTINCT prefix FROM p WHERE position < n_turns) USING (prefix))
    SELECT conv_id, position, n_turns, n_copies, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment FROM t JOIN k USING (conv_id)"""


def url_sql() -> str:
    rules = ", ".join(f"({sql_text(h)}, {sql_text(p)}, {sql_text(v)})" for h, p, v in urls.RULES)
    return f"""
    WITH r(rule_host, rule_path, verdict) AS (VALUES {rules}),
    u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    f AS (SELECT n, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
          FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN (FROM f WHERE k = 1) USING (n)"""


def passages_sql() -> str:
    fold = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"
    words = f"regexp_extract_all({fold}, {sql_text('[^' + chr(92) + 'x00-' + chr(92) + 'x2F' + chr(92) + 'x3A-' + chr(92) + 'x60' + chr(92) + 'x7B-' + chr(92) + 'x7F]+')})"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} AS w FROM benchmark),
    x AS (SELECT DISTINCT item, w[i:i + 9] AS g, least(len(w), 10) AS n FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
    s AS (SELECT DISTINCT n FROM x),
    o AS (SELECT r, i, n, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, s WHERE len(w) >= n)),
    m AS (SELECT r, i, x.n, item FROM o JOIN x USING (g)),
    h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def forest_sql() -> str:
    words = sql_text("[^" + "".join(f"{chr(92)}x{c:02X}" for c in (0x20, *range(9, 14))) + "]+")
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), {words}) AS w FROM documents),
    g AS (SELECT DISTINCT r, w[i:i + {forest.SHINGLE - 1}] AS s FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - {forest.SHINGLE - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
    p AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM g x JOIN g y USING (s) WHERE x.r <> y.r GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * k >= {forest.PERCENT} * (x.n + y.n - k)),
    c(r, root) AS (SELECT r, r FROM d UNION SELECT c.r, e.b FROM c JOIN e ON c.root = e.a),
    m AS (SELECT c.r, min(t.doc_id) AS component_id FROM c JOIN d t ON c.root = t.r GROUP BY c.r)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""


def search_sql() -> str:
    def terms(ranges: str) -> str:
        return f"regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), {sql_text(ranges)})"

    term = "[^" + "".join(f"{chr(92)}x{a:02X}-{chr(92)}x{b:02X}" for a, b in ((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))) + "]+"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms(term)} AS w FROM documents),
    b AS (SELECT row_number() OVER () AS q, item_id, {terms(term)} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_tokens FROM d),
    t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
    f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, s GROUP BY t, n_docs),
    i AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY ALL),
    m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_tokens AS m FROM d, s),
    x AS (SELECT q, r, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN f USING (t) JOIN t USING (t) JOIN m USING (r) GROUP BY ALL),
    k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= {search.TOP}"""


def audit_sql() -> str:
    words = sql_text("[^" + "".join(f"{chr(92)}x{c:02X}" for c in (0x20, *range(9, 14))) + "]+")
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(audit.LETTERS))
    names = "abcde"
    different = " AND ".join(f"{x}.c <> {y}.c" for i, x in enumerate(names) for y in names[:i])
    bits = ", ".join(f"{x}.b" for x in names)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, {words}) AS ws FROM d),
    g AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
    m AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(ws) < {audit.MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {audit.MIN_DISTINCT_PERCENT} * len(ws))::INT
                 + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > {audit.MAX_UPPER_PERCENT} * length(t))::INT
                 + 8 * regexp_matches(t, '{audit.MARKS}')::INT + 16 * coalesce(first_id < doc_id, false)::INT AS bits
          FROM w JOIN g USING (t) LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
    k AS (SELECT part, bits, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY part, bits),
    f(c, b) AS (VALUES {letters}),
    o AS (SELECT {' || '.join(f'{x}.c' for x in names)} AS filter_order, [{bits}] AS bs FROM {', '.join(f'f {x}' for x in names)} WHERE {different}),
    s AS (SELECT filter_order, i AS step, bs[i] AS bit, coalesce(list_sum(bs[1:i - 1]), 0)::INT AS before FROM (SELECT *, unnest(generate_series(1, 5)) AS i FROM o)),
    x AS (SELECT part, filter_order, step, bit,
                 coalesce(sum(n) FILTER (WHERE bits & (bit | before) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (WHERE bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (WHERE bits & bit <> 0 AND bits & before <> 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (WHERE bits = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(n_good) FILTER (WHERE bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(n_toxic) FILTER (WHERE bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS toxic_lost
          FROM k, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM x"""


QUERIES = {
    "op1_quality_rules": quality_rules, "op2_chat_collapse": chat_collapse, "op3_ngram_jaccard": ngram_jaccard, "op4_html_text": html_text, "op5_pii_crf": pii_crf,
    "op6_wu_manber": wu_manber, "op7_suffix_repeats": suffix_repeats, "op8_url_rules": url_rules, "op9_licence_dice": licence_dice, "op10_kk_packing": kk_packing,
    "op11_lsh_forest": lsh_forest, "op12_mask_search": mask_search, "op13_filter_audit": filter_audit,
}
SQL = {"op1_quality_rules": quality_sql(), "op2_chat_collapse": CHAT_SQL, "op6_wu_manber": passages_sql(), "op8_url_rules": url_sql(), "op11_lsh_forest": forest_sql(), "op12_mask_search": search_sql(), "op13_filter_audit": audit_sql()}
