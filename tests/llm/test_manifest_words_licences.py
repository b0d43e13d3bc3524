"""Merkle manifest, spelling variants and licence scans against brute force."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from symtrail.llm import licences, merkle, spelling
from symtrail.llm.labelled import remainder
from tests.llm.conftest import ODD


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def lowered(text):
    return text.encode().lower().decode()


# -- Merkle ----------------------------------------------------------------------------------------------

def brute_leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def brute_tree(leaves, fan=8):
    """(top, siblings of each leaf from its level up: lists of (digest, is_right))."""
    paths, at, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for k, i in enumerate(at):
            run = i // fan * fan
            paths[k].append([(row[j], j > i) for j in range(run, min(run + fan, len(row))) if j != i])
            at[k] = i // fan
        row = [H(*row[j:j + fan]) for j in range(0, len(row), fan)]
    return row[0], paths


def brute_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    tops, inner = [], {}
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        top, paths = brute_tree([brute_leaf(*r) for r in trees[n]])
        tops.append(top)
        inner[n] = paths
    root, upper = brute_tree(tops)
    out = []
    for k, n in enumerate(names):
        for row, path in zip(trees[n], inner[n]):
            steps = path + upper[k]
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            node = brute_leaf(*row[:4], lowered(row[4])) if bad else brute_leaf(*row)
            for step in steps:
                node = H(*[d for d, right in step if not right], node, *[d for d, right in step if right])
            out.append((row[0], brute_leaf(*row), tops[k], root, H(*[d for s in steps for d, _ in s]), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_is_that_of_brute_force(spark, documents, levels):
    many = [(100 + k, f"Text {k}", f"s{k % 3}", ("de", "en", "é", None)[k % 7 % 4]) for k in range(300)]
    langs = [(5000 + k, f"T{k}", None, f"l{k:03d}") for k in range(70)]
    docs = documents(*ODD, *many, *langs)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    found = merkle.verified(docs, remainder(F.col("doc_id"), 3) == 0, levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_one_document_and_of_none(spark, documents):
    one = merkle.manifest(documents((1, "A")))
    (row,) = one.collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["steps"] == []
    assert merkle.verified(documents(), F.lit(None).cast("boolean")).count() == 0


def test_places_are_those_of_completion():
    """Distinct leaves: the log holds every node where the closed form says."""
    for n in [*range(1, 20), 63, 64, 65, 511, 512, 513, 700]:
        for height in {merkle.height_of(n, 4, True), 4}:
            row = [H(str(k)) for k in range(n)]
            log = merkle.completed(row, height)
            for level in range(height + 1):
                at = merkle.place(level, np.arange(len(row)), n, height)
                assert [log[p] for p in at] == row
                row = [H(*row[j:j + 8]) for j in range(0, len(row), 8)]
            assert len(log) == sum(-(-n // 8 ** k) for k in range(height + 1))


# -- spelling variants -----------------------------------------------------------------------------------

def brute_words(rows, least=7):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k + 1:] == b[k:] or a[k:] == b[k + 1:]


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def test_one_edit_of_brute_force():
    assert one_edit("aab", "ab") and one_edit("ab", "aab") and one_edit("abc", "abd") and one_edit("abc", "abcd") and one_edit("abc", "bc")
    assert not one_edit("abc", "abc") and not one_edit("abc", "acb") and not one_edit("abc", "a")


def test_variants_are_those_of_brute_force(spark, documents):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aé"), int(rng.integers(7, 10)))) for _ in range(500)]
    runs = ["aaaaaaa" + "a" * k for k in range(40)] + ["abababab" * k + x for k in (5, 9) for x in ("", "a", "c", "cd")]
    long = "Lorem" * 400                                       # names beyond the length that is named by text
    texts = [" ".join(rng.choice(words, 400)) for _ in range(12)] + [" ".join(runs), " ".join(runs).upper()] * 3
    texts += [f"{long} {long} {long[:1500]}{long[1501:]} {long[:1500]}x{long[1500:]} Straßen, STRASSEN straßen×÷ ÀÉÎÕÜàéîõü"] * 3
    texts += ["colours " * 30 + "colors coloours", "colors coloours colourss colourss colorss colorss"]
    docs = documents(*ODD, *[(200 + k, t) for k, t in enumerate(texts)])
    wanted = brute_variants(brute_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    found = spelling.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert any(f is not None for _, f, *_ in wanted) and max(near for *_, near, _ in wanted) > 5


def test_roots_follow_forms_to_the_end(spark):
    forms = [(str(k), str(k + 1)) for k in range(13)] + [("x", "5")]
    found = dict(spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert found == {w: "13" for w, _ in forms}


def test_variants_of_nothing(spark, documents):
    assert spelling.variants(documents()).count() == 0
    assert spelling.variants(documents((1, "one two three"), (2, None))).count() == 0


def test_runs_and_their_hashes():
    texts = ["", "abc", "defÀé x", "日本éa", "ÿ", "Zz9À", "a" * 600, "Ā×÷", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    start, end = spelling._runs(data, offsets)
    runs = [data[s:e].tobytes() for s, e in zip(start, end)]
    assert runs == [r.encode() for t in texts for r in re.findall("[A-Za-zÀ-ÿ]+", t)]
    begun = np.arange(len(start), dtype=np.uint32) * 7919
    assert spelling._crc32(data, start, end, begun).tolist() == [zlib.crc32(r, int(b)) for r, b in zip(runs, begun)]


@pytest.mark.parametrize("cuts", [(), (5,), (1, 2, 3, 9), tuple(range(1, 14))])
def test_tries_of_parts_are_that_of_the_whole(cuts):
    """Wherever the sorted paths are cut, every task sees the same nodes; those only one part needs are real branches."""
    paths = sorted({"fabcd", "fabce", "fabcex", "fabd", "fabdaaa", "fabdaab", "fabdaabz", "fb", "fbcccc", "fbccccd", "fbd", "fxyzxyz", "fxyzxyzxyz", "fz"})

    def edges(parts):
        out, names = {}, set()
        for k, part in enumerate(parts):
            left = spelling._shared(parts[k - 1][-1], part[0]) if k else 0
            right = spelling._shared(part[-1], parts[k + 1][0]) if k + 1 < len(parts) else 0
            for node, end in spelling.branching(part, left, right, 2):
                name = part[node.first][:node.depth]
                names.add(name)
                below = {p for p in part[node.first:end]}
                assert below == {p for p in part if p.startswith(name)}
                for code, i, child, label, mask in spelling._marked(node, part):
                    to = name + label
                    assert out.setdefault((name, code), to) == to
        return out, names

    bounds = [0, *cuts, len(paths)]
    found, names = edges([paths[a:b] for a, b in zip(bounds, bounds[1:])])
    whole, real = edges([paths])
    assert real <= names and {k for k in whole} <= {k for k in found}
    for name, code in found:                                   # every edge ends at a node or at a word
        to = found[name, code]
        assert to in names or (to.endswith("$") and to[:-1] in paths)


# -- licences --------------------------------------------------------------------------------------------

GPL = "This work is licensed under the GNU General Public License, version 3."
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))


def brute_base(text):
    words = licence_words(text)
    places = [(k, label) for p, label in BASE.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


LICENCES = (
    (300, GPL), (301, GPL + "\n" + GPL), (302, "GNU\nGENERAL//Public-license"), (303, "gnu general public licence"), (304, "xgnu general public license"),
    (305, "CC BY-NC 4.0 cc by cc/by é cc by"), (306, "gnu general public"), (307, "license"), (308, "mit"), (309, "MIT License, Apache License Version 2.0"),
    (310, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (311, "permission is hereby granted"),
    (312, "all rights reserved " * 3000), (313, "ALL RIGHTS"), (314, "reserved"), (315, "gnu general public license \u00e9 gnu general public license\u00e9"),
    (316, "licensed under the gnu general public license, and also its version 3"), (317, "version 3 " + "x " * 40 + "gnu general public license"),
)


def test_base_places_are_those_of_brute_force(spark, documents):
    docs = documents(*ODD, *LICENCES, *[(400 + k, "mit " * k + "license") for k in range(20)])
    wanted = sorted([(r["doc_id"], *brute_base(r["text"])) for r in docs.collect()], key=str)
    found = licences.scan(docs).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found], key=str) == wanted
    for r in found:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert r["n_base"] == 0 or r["score"] == 1
        assert list(filter(None, r["labels"].split(","))) == sorted(set(filter(None, r["labels"].split(","))))


def test_the_methods_labels_and_their_places(spark, documents):
    found = {r["doc_id"]: r for r in licences.hits(documents(*LICENCES, (500, "é — " + GPL))).collect()}
    own = {k: {h["label"] for h in r["hits"] if not h["base"]} for k, r in found.items()}
    assert own[300] == {"gpl-3.0"} and own[305] == {"cc-by-nc-4.0"} and own[309] == {"apache-2.0"} and own[310] == {"mit"} and own[312] == {"all-rights-reserved"}
    assert own[316] == {"gpl-3.0"}                              # two words more: within the slack
    assert own[303] == own[306] == own[311] == own[313] == own[317] == set()
    assert sum(h["label"] == "all-rights-reserved" for h in found[312]["hits"]) == 3000
    text = ("é — " + GPL).encode()
    assert {text[h["begin"]:h["end"]].decode() for h in found[500]["hits"]} == {"GNU General Public License"}


def test_scan_equals_its_sql(spark, documents):
    import duckdb

    docs = documents(*ODD, *LICENCES)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    wanted = con.execute(licences.SQL).fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in licences.scan(docs).collect())
    assert licences.scan(documents()).count() == 0
