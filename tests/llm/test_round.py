"""Forest, search and filter audit beside brute force, on hand-made tables with every odd case."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from millrace.llm import audit, forest, graphs, packing, search
from millrace.session import settle
from tests.llm.test_corpus import PROSE, clashing, documents, odd_texts, rows_by_id


def near_copies(seed: int, families: int, copies: int, words: int = 120, changes: int = 4) -> list[str]:
    r = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{r.randrange(4000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(changes)):
                text[r.randrange(words)] = f"x{r.randrange(10**6)}"
            out.append(" ".join(text))
    r.shuffle(out)
    return out


def shingle_sets(texts):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return sets


def brute_components(texts, percent=85):
    sets = shingle_sets(texts)
    root = list(range(len(texts)))
    changed = True
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            low = min(root[i], root[j])
            if (root[i], root[j]) != (low, low):
                root[i] = root[j] = low
                changed = True
    return [(i, len(s), root[i], root[i] == i) for i, s in enumerate(sets)]


FOREST = ("n_shingles", "component_id", "kept")


def test_forest_equals_brute_force(spark):
    texts = near_copies(1, 12, 15) + odd_texts() + ["a b c d", "A  b C d", "a b c d e", "a b c d e f"] + [PROSE * 4 + "more"] * 3
    want = brute_components(texts)
    assert rows_by_id(forest.forest_duplicates(clashing(documents(spark, texts))), *FOREST) == want
    assert len({root for _, _, root, _ in want}) < len(texts)


def test_forest_cuts_dense_regions_and_loses_no_link(spark):
    """Pieces of four: every region is dense, large groups go through pieces and leftovers."""
    texts = near_copies(2, 1, 60, changes=8) + near_copies(3, 3, 10) + ["same text of six words here"] * 20
    got = rows_by_id(forest.forest_duplicates(documents(spark, texts), block=4), *FOREST)
    assert got == brute_components(texts)


def test_forest_edges_are_short_paths(spark, monkeypatch):
    """What tasks find is handed on as stars, so the three calls of ``components`` need few rounds over pieces of large groups."""
    assert forest.stars([b"c", b"a", b"d", b"b"], iter([(0, 2), (2, 3)])) == [(b"c", b"b"), (b"d", b"b")]
    texts, written = near_copies(2, 1, 60, changes=8), []
    monkeypatch.setattr(graphs, "settle", lambda df, name: written.append(name) or settle(df, name))
    got = rows_by_id(forest.forest_duplicates(documents(spark, texts), block=16), *FOREST)
    assert got == brute_components(texts)
    assert written.count("large") <= 2


def test_forest_odd_tables(spark):
    df = documents(spark, near_copies(4, 2, 3))
    assert forest.forest_duplicates(df.limit(0)).count() == 0
    twice = df.unionAll(df)
    assert rows_by_id(forest.forest_duplicates(twice), *FOREST) == sorted(rows_by_id(forest.forest_duplicates(df), *FOREST) * 2)
    nameless = spark.createDataFrame([(None, PROSE), (7, PROSE), (None, "alone here"), (None, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles > 1, r.component_id, r.kept) for r in forest.forest_duplicates(nameless).collect()}
    assert got == {(None, True, 7, False), (7, True, 7, True), (None, False, None, True)}


def test_links_of_pieces():
    sets = [np.array(sorted(s), np.uint64) for s in ({1, 2, 3}, {1, 2, 3}, {7, 8}, {7, 8, 9}, {7, 8})]
    assert list(forest.linked(sets, np.arange(5), 85)) == [(0, 1), (2, 4)]
    assert list(forest.linked(sets, np.array([0, 0, 1, 2, 1]), 85)) == []
    assert list(forest.linked(sets, np.arange(5), 60)) == [(0, 1), (2, 3), (2, 4)]


def test_forest_finds_pairs_at_the_threshold():
    """Share of pairs at 0.85 under a common prefix of some tree, at both depths."""
    r, factors = np.random.default_rng(5), forest.seeds(forest.HASHES)
    missed = {forest.MIN_DEPTH: 0, forest.MAX_DEPTH: 0}
    for _ in range(300):
        common, own = (r.integers(0, 2**63, n).astype(np.uint64) for n in (170, 30))
        a, b = (np.frombuffer(forest.signature(np.unique(np.concatenate([common, x])), factors), ">u2") for x in (own[:15], own[15:]))
        same = (a == b).reshape(forest.TREES, forest.OWN)
        longer = same.all(axis=1) & np.roll(same, -forest.NEXT_TREE, axis=0)[:, :forest.MAX_DEPTH - forest.OWN].all(axis=1)
        missed[forest.MIN_DEPTH] += not same.all(axis=1).any()
        missed[forest.MAX_DEPTH] += not longer.any()
    assert missed == {forest.MIN_DEPTH: 0, forest.MAX_DEPTH: 0}
    assert forest.miss_probability(0.85) < 1e-10


def brute_search(texts, items, top=10):
    words = [[w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for t in texts]
    n, total = sum(1 for w in words if w), sum(map(len, words))
    out = []
    for item, text in items:
        wanted = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        weights = {t: search.term_weight(n, sum(t in w for w in words)) for t in wanted}
        scores = []
        for i, w in enumerate(words):
            m = 25 + 75 * len(w) * n // max(total, 1)
            score = sum(weights[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in wanted if t in w)
            scores += [(-score, i)] if score > 0 else []
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def search_rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_brute_force(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"t{i}" for i in range(150)] + ["É", "中文", "x9"]
    texts = [" ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=r.randrange(1, 80))) for _ in range(200)]
    texts += odd_texts() + texts[:40]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((1, 3, 30, 200))))) for i in range(30)]
    items += [(90, "T1,t1;t2 É-é"), (91, None), (92, ""), (93, "nowhere"), (94, PROSE), (95, "!!")]
    df, wanted = documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_search(texts, items)
    assert search_rows(search.search(clashing(df), wanted.selectExpr("*", "1 AS rank", "2 AS score", "3 AS name"))) == want
    assert search_rows(search.search(df, wanted, block_terms=50)) == want
    assert search_rows(search.search(df, wanted.unionAll(wanted), top=3)) == brute_search(texts, items, 3)


def test_search_in_small_chunks(monkeypatch):
    r = random.Random(7)
    texts = [" ".join(r.choices("abcdefgh", k=r.randrange(1, 9))) for _ in range(300)]
    index = [{"id": i, "n": len(t.split()), "terms": np.array(sorted({ord(c) - 97 for c in t.split()}), np.int32).tobytes(),
              "tfs": np.array([t.split().count(c) for c in sorted(set(t.split()))], np.int32).tobytes()} for i, t in enumerate(texts)]
    total = sum(len(t.split()) for t in texts)
    weights = [search.term_weight(len(texts), sum(c in t for t in texts)) for c in "abcdefgh"]
    best = search.Best(10)
    scored = []
    monkeypatch.setattr(search.Chunk, "scores", staticmethod(lambda d, p, w, f=search.Chunk.scores: scored.append(len(d)) or f(d, p, w)))
    for at in range(0, len(index), 64):
        search.Chunk(index[at:at + 64], 8, len(texts), total).search([(t, weights[t]) for t in (0, 2, 5)], best)
    assert [(0, k, i, s) for k, (i, s) in enumerate(zip(best.ids.tolist(), best.scores.tolist(), strict=True), 1)] == brute_search(texts, [(0, "a c f")])
    assert sum(scored) < sum(any(c in t for c in "acf") for t in texts), "masks that cannot reach the tenth score are left out"


def test_search_odd_tables(spark):
    df, items = documents(spark, ["a b", "a", None]), spark.createDataFrame([(1, "a"), (None, "b")], "item_id bigint, text string")
    assert search_rows(search.search(df.limit(0), items)) == search_rows(search.search(df, items.limit(0))) == []
    assert search_rows(search.search(documents(spark, [None, "", "!"]), items)) == []
    twice = spark.createDataFrame([(5, "b x"), (5, "b x"), (None, "b x"), (4, "b x"), (8, "y"), (9, "y z"), (10, "z"), (11, "q")], "doc_id bigint, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in search.search(twice, items).collect()]
    assert sorted(got) == sorted([(None, 1, 4), (None, 2, 5), (None, 3, 5), (None, 4, None)], key=lambda x: x[1])


def brute_audit(rows, labels):
    """(part, order, step) -> counts, row by row."""
    fails = []
    for key, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
               "D": bool(re.search(r"[#$%&*|]", text)),
               "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)}
        fails.append((part or "", {c for c in bad if bad[c]}, (key, 1, None) in labels or (key, 1, 0) in labels or (key, 1, 1) in labels,
                      any(k == key and key is not None and x == 1 for k, _, x in labels)))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                before = set(order[:step - 1])
                removed = [f for f in own if c in f[1] and not f[1] & before]
                out[part, "".join(order), step] = [
                    sum(not f[1] & (before | {c}) for f in own), len(removed), sum(c in f[1] and bool(f[1] & before) for f in own),
                    sum(f[1] == {c} for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed),
                ]
    for (part, order, step), row in out.items():
        row.append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


@pytest.fixture(scope="module")
def audited():
    r = random.Random(8)
    long = " ".join(f"word{i}" for i in range(220))
    base = [long, long + " CAPITALS " * 3, "dull " * 300, long + " #", PROSE * 30, None, "", "A | B", long.upper(), "é " * 250]
    rows = [(i if r.random() > 0.05 else None, r.choice(base), r.choice(["a", "b", None, ""])) for i in range(90)]
    rows += [(3, long, "a"), (3, long, "a"), (2, base[2], "b"), (500, "x" * 20000, "c")]
    labels = [(i, r.choice((0, 1)), r.choice((0, 1))) for i in range(0, 90, 2)] + [(500, 1, None)]
    return rows, labels


def test_audit_equals_brute_force(spark, audited):
    rows, labels = audited
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit_rows(audit.audit_filters(df.selectExpr("*", "1 AS part", "2 AS h", "3 AS bits", "4 AS n", "5 AS id"), marks.selectExpr("*", "1 AS good", "'x' AS text")))
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_odd_tables(spark):
    schema, labels = "doc_id bigint, text string, source string", spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit_filters(spark.createDataFrame([], schema), labels).count() == 0
    rows = [(None, None, None), (None, "", None)]
    assert audit_rows(audit.audit_filters(spark.createDataFrame(rows, schema), labels)) == brute_audit(rows, [])


def test_audit_runs_without_python(spark, audited):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    plan = audit.failing_bits(df)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_token_ids_of_words_with_equal_hashes():
    """Texts whose polynomial hashes modulo 2**64 coincide, in one group and in later ones."""
    tokens = packing.Tokens(packing.tokenizer_path())
    for n in (1024, 2048, 4096):
        pair = [thue_morse(n, "ab"), thue_morse(n, "ba")]
        texts = [f"so {pair[0]} and {pair[1]}", pair[1], "plain words", pair[0] + " x"]
        for _ in range(2):
            assert [list(i) for i in tokens.ids(texts)] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_ids_of_all_characters():
    tokens = packing.Tokens(packing.tokenizer_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(9)
    texts = ["".join(f"a{chr(c)}'s {chr(c)}1{chr(c)}" for c in points[at:at + 64]) for at in range(0, len(points), 64)]
    texts = r.sample(texts, 1500) + ["".join(chr(c) + "'s" for c in (0x140E2, 0x16D5A, 0x13E35))]
    texts += ["".join(r.choice(["'re", " ", "\n", "9", "x", "é", chr(r.choice(points))]) for _ in range(30)) for _ in range(1500)]
    got = [list(i) for i in tokens.ids(texts)]
    assert got == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_do_not_depend_on_how_rows_are_dealt(spark):
    df = documents(spark, [PROSE * (i % 7) + f"word{i}" for i in range(80)])
    cut = [sorted(tuple(r)[:5] for r in packing.pack_documents(df.repartition(n)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) for n in (1, 7)]
    assert cut[0] == cut[1]
