"""Embedding links, URL rules, components, and the pipeline against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from symtrail.llm import nn_descent, url_filters
from symtrail.llm.components import components
from tests.llm.conftest import SF
from tests.llm.test_documents import TOKENIZER, folded, library_ids


def brute_links(vectors):
    """{position: (links, component)} of (id, vector, label) rows with different ids."""
    good = [k for k, (_, v, label) in enumerate(vectors) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: [] for k in range(len(vectors))}
    for a in good:
        for b in good:
            x, y = np.array(vectors[a][1], float), np.array(vectors[b][1], float)
            if a != b and vectors[a][2] == vectors[b][2] and len(x) == len(y) and x @ y >= 0.98 * np.sqrt(x @ x) * np.sqrt(y @ y):
                near[a].append(b)
    least = {k: vectors[k][0] for k in near}
    while True:
        lower = {k: min([least[k], *(least[j] for j in near[k])]) for k in near}
        if lower == least:
            return {vectors[k][0]: (len(near[k]), least[k]) for k in near}
        least = lower


def test_links_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "COUNT_BLOCK", 20)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    vectors = []
    for k in range(400):
        noise = 0.02 if k % 3 else 0.0
        vectors.append((k, (base[k % 60 if k < 300 else 7] + noise * rng.normal(size=16)).astype(np.float32).tolist(), k % 60 % 2 if k < 300 else 1))
    vectors += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None, *[1.0] * 15], 1), (504, base[7].tolist(), None), (505, [], 0),
                (506, [1.0, 0.0], 1), (507, [2.0, 0.0], 1), (508, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<float>, label int, node string, copies int")
    wanted = brute_links([(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in vectors])
    found = nn_descent.near_duplicates(df).collect()
    assert len(found) == len(vectors)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == wanted
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["audited_recall"] >= 0.97 for r in found)
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_tight_clusters_that_link_across(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "SEARCH_BLOCK", 20)
    rng = np.random.default_rng(2)
    vectors = []
    for pair in range(6):
        x, y = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for middle in (x, 0.985 * x + math.sqrt(1 - 0.985 ** 2) * y):
            vectors += [(len(vectors) + k, (middle + 0.0005 * rng.normal(size=32)).tolist(), pair % 2) for k in range(9)]
    vectors += [(len(vectors) + k, rng.normal(size=32).tolist(), k % 2) for k in range(40)]
    wanted = brute_links(vectors)
    assert all(wanted[k] == (17, k - k % 18) for k in range(108))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()} == wanted


def test_lost_pairs_beside_a_large_group_are_found(spark, monkeypatch):
    rng = np.random.default_rng(3)
    many = rng.normal(size=32)
    vectors = [(k, (many + 0.01 * rng.normal(size=32)).tolist(), 0) for k in range(150)]
    for k in range(150, 250, 2):
        x = rng.normal(size=32)
        vectors += [(k, x.tolist(), 1), (k + 1, (x + 0.01 * rng.normal(size=32)).tolist(), 1)]
    wanted = brute_links(vectors)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    graph = nn_descent.neighbour_graph

    def without_pairs(nodes, *rest):
        few = nodes.filter("label = 1").select(F.col("node").alias("u"))
        return graph(nodes, *rest).join(few, "u", "left_anti")

    monkeypatch.setattr(nn_descent, "neighbour_graph", without_pairs)
    found = nn_descent.near_duplicates(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == wanted
    assert all(r["audited_recall"] == 1.0 for r in found)


def test_projections_grow_with_the_planes():
    together = lambda bits: (1 - math.acos(0.98) / math.pi) ** bits
    for bits in range(1, 31):
        assert (1 - together(bits)) ** nn_descent._projections(bits) <= 0.001


def test_links_of_the_smallest_table(sf):
    df = sf("embeddings")
    wanted = brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()} == wanted


def test_repeated_and_null_vector_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, [-1.0, 2.0], 0), (None, [5.0, -1.0], 0)], "vec_id long, embedding array<double>, label int")
    found = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.near_duplicates(df).collect())
    assert found == Counter({(1, 2, 1, True): 2, (None, 2, 1, False): 1, (2, 0, 2, True): 1, (None, 0, None, True): 1})


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


STATED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_judgement(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = folded(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host):])[0]
    fits = [(h + p, v) for h, p, v in STATED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


def test_urls_are_judged_as_by_all_rules(spark, sf):
    odd = [None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "x://a.Example.ORG/en/12?x#y", "http://example.org/en/1", "http://notexample.org/es/a",
           "http://www.example.com/fr/", "http://com/de/", "http://a.com?/de/", "http://a.com#/de/", "http://a.com/DE/", "http://user@b.org:80/es/", "a://b://c.org/x",
           "http://casino-win.example.net/", "http://m.spam.net", "http://casinos.net/", "http://example.net/casino", "http://exämple.org/es/\n", "http://example.org"]
    urls = [(k, u) for k, u in enumerate(odd + odd[:3])] + [(None, "http://org/")]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in urls], "page_id long, url string, host string, verdict string")
    found = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect())
    wanted = Counter()
    for k, u in urls:
        host, path, rule, verdict = brute_judgement(u)
        spam = any(w in re.findall("[a-z0-9]+", host) for w in url_filters.SPAM_WORDS)
        wanted[k, host, path, rule, verdict or ("block" if spam else "allow")] += 1
    assert found == wanted
    assert url_filters.judge(pages.limit(0)).count() == 0
    tried = [r["n_tried"] for r in url_filters.judge(sf("pages")).collect()]
    assert max(tried) < len(url_filters.PAGE_RULES) + len(url_filters.METHOD_RULES)


def test_a_rule_without_tokens_is_tried_everywhere(spark):
    rule = url_filters.Rule("any", r"\d{3}", "block", ())
    pages = spark.createDataFrame([(1, "http://a.net/123"), (2, "http://a.net/12")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in url_filters.judge(pages, (rule,), ()).collect()} == {1: "any", 2: None}


def test_pipeline_keeps_clean_documents_and_drops_copies(spark):
    import corpus_pipeline

    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        after[name] = docs.collect()
    read = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = {r["doc_id"] for r in after["quality classifier"]}
    assert np.mean([r["doc_id"] in good for r in read if labels.get(r["doc_id"]) == 1]) > 0.95
    assert np.mean([r["doc_id"] in good for r in read if labels.get(r["doc_id"]) == 0]) < 0.1
    exact = after["exact dedup"]
    assert Counter(folded(r["text"]) for r in exact) == Counter({folded(r["text"]): 1 for r in after["quality classifier"]})
    near = {r["doc_id"] for r in after["n-gram Jaccard join"]}
    assert near <= {r["doc_id"] for r in exact} and len(near) < len(exact)
    final = after["BPE encoding and decoding"]
    texts = {r["doc_id"]: r["text"] for r in after["mixing sources"]}
    assert len(final) == len(after["mixing sources"])
    some = final[:50]
    ids, _ = library_ids([texts[r["doc_id"]] for r in some])
    for r, own in zip(some, ids):
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert Counter(map(str, corpus_pipeline.run(spark, folder).collect())) == Counter(map(str, final))
    assert TOKENIZER
