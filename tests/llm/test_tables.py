"""Deduplication, joins, embeddings, archives and the pipeline against brute force."""

import base64
import hashlib
import itertools
import math
import os
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from designloom.llm import common, embedding_lsh, exact_dedup, ngram_join, packing, queries, warc

SMALL = "/root/testdata/sf0.001"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("held", [7, common.FOREST_EDGES])
def test_connected_components(spark, held, monkeypatch):
    monkeypatch.setattr(common, "FOREST_EDGES", held)
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)] + [(2000, i) for i in range(2001, 2100)]
    edges += [(int(a), int(b)) for a, b in itertools.pairwise(rng.permutation(np.arange(5000, 5600)))] + [(5, 6), (6, 5)]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Exact deduplication.


def test_exact_groups_equal_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    cursor = db.execute(queries.ORACLE_SQL["op6_exact_dedup"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).select(*names).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("hash_fn", [F.md5, lambda text: F.substring(F.md5(text), 1, 1)])
def test_exact_groups_with_collisions_and_odd_rows(spark, hash_fn):
    data = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t"), (7, "x"), (None, "x long"), (8, "xlong"), (9, "c"), (9, "c"), *((100 + i, f"t{i}") for i in range(60))]
    docs = spark.createDataFrame([(i, t, i, "h") for i, t in data], "doc_id long, text string, id long, h string")
    got = sorted(map(tuple, exact_dedup.exact_groups(docs, hash_fn=hash_fn).collect()), key=str)
    groups = {}
    for i, t in data:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i))
    wanted = []
    for i, t in data:
        body = "".join((t or "").split())
        keep = min(groups[body])[2]
        wanted.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    assert got == sorted(wanted, key=str)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


# N-gram join.


def slow_join(rows, k, num, den):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


@pytest.fixture(scope="module")
def near(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size in (3, 8, 40, 41, 120, 300):
        base = [f"w{v}" for v in rng.integers(0, 3000, size)]
        for edits in (0, 0, 1, 1, 2, 4, 9, 20):
            words = list(base)
            for _ in range(edits):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
            rows.append((n, " ".join(words) if n % 2 else "  ".join(words).upper()))
            n += 1
    passage = " ".join(f"p{i}" for i in range(80))
    rows += [(n + i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(10 + 7 * i))) for i in range(70)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "a b c d"), (507, "a b c d"), (508, "a\x0bb c\x85 d")]
    return rows


@pytest.mark.parametrize(("k", "num", "limit"), [(3, 90, ngram_join.BLOCK_TOKENS), (5, 80, ngram_join.BLOCK_TOKENS), (3, 60, 900)])
def test_join_equals_brute_force(spark, near, k, num, limit):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in near], "doc_id long, text string, n long, sig string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, k=k, num=num, den=100, block_tokens=limit).collect()}
    assert got == slow_join(near, k, num, 100)


def test_join_of_a_large_family(spark):
    """More sets at one token than are compared in pairs, so the tree decides."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(int(rng.integers(0, 7))):
            words[int(rng.integers(100))] = f"e{rng.integers(30)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, k=3, num=90, den=100).collect()}
    assert got == slow_join(rows, 3, 90, 100)


def test_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.near_components(docs, k=3).collect())
    assert got == Counter({(None, 1, None, None): 1, (1, 1, 1, 1): 2, (2, 1, 1, 1): 1})
    assert ngram_join.near_components(docs.limit(0)).count() == 0


# Embeddings.


def family(rng, size, spread, d=64):
    center = rng.normal(size=d)
    return [center + spread * rng.normal(size=d) for _ in range(size)]


def slow_links(rows, bar=0.98):
    units = {}
    for i, v, label in rows:
        ok = v is not None and len(v) and not any(x is None or not math.isfinite(x) for x in v) and any(v) and label is not None
        units[i] = (label, np.array(v, float) / math.sqrt(sum(x * x for x in v))) if ok else None
    ids = [i for i in units if units[i] is not None]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and float(units[a][1] @ units[b][1]) >= bar]
    count = Counter(x for link in links for x in link)
    found = components(list(units), links)
    return {i: (count[i], found[i], found[i] == i) for i in units}, len(links)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        for spread in (0.0, 0.05, 0.08, 0.11, 0.14):
            rows += [[float(np.float32(x)) for x in v] + [label] for v in family(rng, 25, spread)]
        rows += [[float(np.float32(x)) for x in v] + [label] for v in rng.normal(size=(150, 64))]
    table = [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    table += [(900, None, 0), (901, [0.0] * 64, 0), (902, [1.0] * 64, None), (903, [1.0] * 64, None), (904, [float("nan")] * 64, 0), (905, [None] + [1.0] * 63, 0), (906, [], 0), (907, [0.0] * 64, 0)]
    table += [(910, table[0][1], 0), (911, [2 * x for x in table[0][1]], 0), (912, [1.0, 2.0], 0), (913, [1.0, 2.001], 0)]
    data = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in table], "vec_id long, embedding array<float>, label int, rep string, many long")
    table = [(r.vec_id, r.embedding, r.label) for r in data.collect()]
    wanted, links = slow_links(table)
    for block in (embedding_lsh.BLOCK, 10):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_lsh.near_vectors(data, block=block).collect()}
        assert set(got) == set(wanted)
        found = sum(g[0] for g in got.values()) / 2
        assert 0.995 * links <= found <= links
        assert np.mean([got[i][1:] == wanted[i][1:] for i in wanted]) > 0.99
        assert all(got[i][0] <= wanted[i][0] for i in wanted)
    assert embedding_lsh.near_vectors(data.limit(0)).count() == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(7).normal(size=(5, 64))
    np.testing.assert_allclose(np.linalg.norm(embedding_lsh.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    np.testing.assert_allclose(embedding_lsh.hadamard(embedding_lsh.hadamard(x)), x)


def test_recall_at_the_bar():
    """Pairs at cosine 0.98 meet in a bucket of some table almost surely."""
    rng = np.random.default_rng(8)
    a = embedding_lsh.unit(rng.normal(size=(2000, 64)))
    side = rng.normal(size=(2000, 64))
    side = embedding_lsh.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side
    for many in (1000, 10**6, 10**9):
        plan = embedding_lsh.chosen(64, many, 0.98)
        x, y = embedding_lsh.buckets(a, *plan), embedding_lsh.buckets(b, *plan)
        assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.998
        # Unrelated vectors seldom meet.
        assert (x[:-1, :, :, None] == x[1:, :, None, :]).any(axis=(2, 3)).mean() < 0.01


def test_vectors_of_any_scale_and_repeated_ids(spark):
    big = [[1e200, 2e200, 0.0], [1.0, 2.0, 0.0], [1.0, 2.0, 1e-9], [1e-300, 2e-300, 0.0], [0.0, 0.0, 5e-324], [0.0, -0.0, 1.0]]
    data = [(i, v, 0) for i, v in enumerate(big)] + [(0, [0.0, 1.0, 0.0], 0), (None, [1.0, 2.0, 0.0], 0), (0, [0.0, 1.0, 0.0], 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in embedding_lsh.near_vectors(table).collect())
    assert got == [(-1, 0, None), (0, 1, 0), (0, 1, 0), (0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0), (4, 1, 4), (5, 1, 4)]


def test_forests_leave_what_flat_bitmaps_leave():
    rng = np.random.default_rng(10)
    groups = np.repeat(np.arange(60), rng.integers(1, 20, 60))
    base = rng.integers(0, 1 << 60, (60, 400))
    sets = [rng.choice(base[g], rng.integers(5, 60), replace=False).astype(np.uint64) << np.uint64(4) for g in groups.tolist()]
    sizes, bits = np.array([len(x) for x in sets]), np.stack([ngram_join.bitmap(x, 256) for x in sets])
    count = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    i, j = np.nonzero((groups[:, None] == groups[None, :]) & (np.arange(len(groups))[:, None] < np.arange(len(groups))[None, :]))
    for num, den in ((90, 100), (60, 100), (10, 100)):
        level = bits, sizes, sizes, count
        flat = {(int(a), int(b)) for a, b, ok in zip(i, j, ngram_join.possible_pairs(level, i, j, num, den)) if ok}
        a, b = ngram_join.forest_pairs(groups, sizes, bits, num, den)
        assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == flat and len(a) == len(flat)


# Archives.


def pages_of(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é</p>" * (i % 40 + 1)) for i in range(300)]
    rows += [(None, f"n{i % 9}", f"<p>null {i % 30}</p>" * 30) for i in range(60)] + [(3000, "long", "<p>long é</p>" * 200_000)]
    rows += [(1000 + i, None, "<p>copy</p>") for i in range(20)] + [(2000, "u r\nl", None), (2001, "e", ""), (2002, "e", "tiny"), (2003, "e", "tiny"), (None, "n", "null key"), (5, "again", "other"), (5, "again", "other")]
    return rows, spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, shard string")


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    rows, pages = pages_of(spark)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, min_bytes=least, shard_bytes=20_000, roll_bytes=1500).collect())
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(-1 if i is None else i, last.get(h or "", -1))
    wanted = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        response = len(data) < least or last[h or ""] in (i, -1)
        wanted[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else last[h or ""]] += 1
    assert got == wanted


def test_archives_do_not_depend_on_partitions(spark, tmp_path):
    _, pages = pages_of(spark)
    manifests = []
    for k, parts in enumerate((1, 7)):
        path = f"file://{tmp_path}/{k}"
        manifests.append(warc.write(pages.repartition(parts), path, shard_bytes=20_000, roll_bytes=1500))
        assert sorted(os.listdir(tmp_path / str(k))) == sorted([*(m["name"] for m in manifests[k]), "manifest.json"])
    assert manifests[0] == manifests[1] and len(manifests[0]) > 4
    for m in manifests[0]:
        assert (tmp_path / "0" / m["name"]).read_bytes() == (tmp_path / "1" / m["name"]).read_bytes()
    bodies = [r.payload for r in warc.read(spark, f"file://{tmp_path}/0").where("page_id = 7").collect()]
    assert bodies == [("<p>page 7 é</p>" * 8).encode()]
    name = tmp_path / "0" / manifests[0][0]["name"]
    name.write_bytes(name.read_bytes()[:-40])
    with pytest.raises(Exception, match="truncated|incomplete|Error"):
        warc.read(spark, f"file://{tmp_path}/0").count()
    # A file rolls once it holds so many compressed bytes; most shards make several.
    assert sum("-0000." in m["name"] for m in manifests[0]) < len(manifests[0]) - 2
    assert warc.write(pages.limit(0), f"file://{tmp_path}/none") == [] and warc.read(spark, f"file://{tmp_path}/none").count() == 0


# The pipeline.


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from designloom.llm import secrets_crf, toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("rejected").collect()}
    left = {i: t for i, t in rows.items() if i not in bad}
    best = {}
    for i, t in left.items():
        body = "".join((t or "").split(" "))
        body = body.translate({ord(c): None for c in "\t\n\x0b\x0c\r"})
        best[body] = min(best.get(body, (1, 0)), (-len(t or ""), i))
    left = {i: left[i] for _, i in best.values()}
    left = {i: left[i] for i, (_, c) in slow_join(list(left.items()), 5, 80, 100).items() if i == c}
    stage = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    model = secrets_crf.train(stage)
    left = {i: secrets_crf.redact(t, secrets_crf.spans_of(t, model)) for i, t in left.items()}
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    wanted = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == wanted
    assert sum(r.length for r in got) == sum(wanted.values())
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf)
        assert current.columns == docs.columns and current.schema == docs.schema, name


def test_stages_need_one_python_worker_a_task(spark, monkeypatch):
    """Workers stay in an executor with what they remember: chained Python stages, or those of RDDs, would double them."""
    plans = []

    def seen(edges, **options):
        plans.append(edges._jdf.queryExecution().toString())
        return common.connected_components(edges, **options)

    monkeypatch.setattr(ngram_join, "connected_components", seen)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other words only")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert len(plans) == 2 and not any("InArrow" in p for p in plans)
    pieces = packing.pack(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert "ExistingRDD" not in pieces._jdf.queryExecution().toString()
    assert {r.doc_id for r in pieces.collect()} == {1, 2, 3}


def test_words_that_are_parts_are_kept_once():
    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("some words, Some (words) and words", "(and) And and", "and"):
        assert encode(text) == encode.whole(text)
    assert not set(encode.words) & {"some", "and"} and {"some", "and", "words"} <= set(encode)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 3000, None, "s", 5), (3, "token = abcdef123456\n", "en", None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 1, 2, 3}


def test_pipeline_on_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    extra = ["class_id", "h", "group_size", "text_sha256", "place", "keep_id", "component_id", "spans", "grade", "id", "kept", "sig", "toxic", "part"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, "a b c", *"xy", 5), (2, "a  b c", *"xy", 6), (3, " ".join(words), *"xy", 0), (4, " ".join(words[:-1]), *"xy", 0), (5, "long " * 60_000, *"xy", 0)]
    rows = [(*r, *(f"{c}{r[0]}" for c in extra)) for r in rows]
    for name, data, kept in (("some", rows, {2, 3, 5}), ("none", [], set())):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            docs = fn(spark, docs, str(tmp_path / name))
            assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString(), stage
        # Other columns pass as they are.
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in extra)
        assert {r.doc_id for r in docs.collect()} == kept
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()} == kept


def test_join_of_long_texts_and_other_columns(spark):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 150_000)]
    other = list(words)
    for i in rng.integers(0, 150_000, 2000):
        other[int(i)] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100_000])), (4, "z" * 500_000), (5, "z" * 500_000 + " end")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, block string, side int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, k=3, num=90, den=100, block_tokens=100_000).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} and got[4][0] == got[5][0] == 1


def test_repeated_ids_keep_their_own_texts(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "alpha beta"), (1, "gamma delta"), (2, "alpha  beta"), (3, "gamma delta"), (4, "unique"), (4, "another"), (4, "an other "), (None, "alpha beta"), (5, "unique")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()))
    assert got == [(0, "alpha beta"), (1, "gamma delta"), (2, "alpha  beta"), (4, "an other "), (4, "unique")]
