"""Operators over documents against brute force, on small fixtures and on the smallest tables."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from symtrail.llm import bpe, exact_dedup, jaccard_join, labelled, language_id, mixing, quality, suffix_array, toxicity
from symtrail.llm.components import components
from symtrail.session import cut
from tests.llm.conftest import LONG, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- 1

def brute_removed(pairs):
    """(id, bytes, removed, spans, digest) of (id, text) pairs with different ids."""
    seen, out = set(), []
    for doc, text in sorted(pairs):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            window = data[i:i + 100]
            if window in seen:
                gone[i:i + 100] = True
            seen.add(window)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(data) else 0
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


REMOVED = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def shared_passages():
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line, passage = noise(140), noise(700)
    out = [(k, noise(rng.integers(0, 400)) + line + noise(rng.integers(0, 90)) + line + noise(60)) for k in range(40)]
    out += [(100 + k, noise(50) + passage + noise(50)) for k in range(5)]
    out += [(200, "ab" * 400), (201, "q" * 1000), (202, passage[:99]), (203, passage[:100]), (204, "é" * 120), (205, None), (206, "")]
    out += [(300 + k, passage) for k in range(30)]
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_removed_bytes_are_those_of_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(suffix_array, "HOT", hot)
    pairs = shared_passages()
    assert sorted(rows(suffix_array.removed_bytes(documents(*pairs)), *REMOVED)) == brute_removed(pairs)


def test_removed_bytes_of_the_smallest_table(sf):
    docs = sf("documents")
    assert sorted(rows(suffix_array.removed_bytes(docs), *REMOVED)) == brute_removed(rows(docs, "doc_id", "text"))


def test_removed_bytes_of_a_text_longer_than_a_segment(documents, monkeypatch):
    monkeypatch.setattr(suffix_array, "SEGMENT", 4_000)
    pairs = [(1, LONG[:30_000]), (2, LONG[10_000:25_000] + LONG[100:3_000])]
    assert sorted(rows(suffix_array.removed_bytes(documents(*pairs)), *REMOVED)) == brute_removed(pairs)


def test_removed_bytes_of_odd_rows(documents):
    found = rows(suffix_array.removed_bytes(documents(*ODD)), *REMOVED)
    assert len(found) == len(ODD)
    by_id = defaultdict(list)
    for r in found:
        by_id[r[0]].append(r[1:])
    assert by_id[1] == by_id[2] == by_id[11] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert by_id[6][0] == by_id[6][1] and by_id[6][0][1] == 0          # a repeated row is the same document
    assert by_id[8][0][1] == 0 and by_id[9][0][1] == len(LONG)
    assert by_id[10][0][1] == 2999                                     # strings that overlap themselves
    assert suffix_array.removed_bytes(documents()).count() == 0


def test_refinement_names_equal_strings_alike():
    data = np.frombuffer((b"abc" * 100 + b"x" * 150 + b"abc" * 100), np.uint8)
    at = np.array([0, 3, 1, 300, 301, 450, 453])
    names = suffix_array.refine(data, at, np.zeros(len(at), np.int64)).tolist()
    expected = [bytes(data[i:i + 100]) for i in at]
    assert [[a == b for b in names] for a in names] == [[a == b for b in expected] for a in expected]


# --- 3

def library_ids(texts):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)], library


def test_encoder_equals_the_library():
    texts = ["", " ", "  a", "a  b \n c", "don't they'll 's", "aaaaaaaaaaaaaaaaa" * 9, "x<|endoftext|> <|endoftext|>y", "ÀÉ\u00a0é\u3000日本 12٣४ ½", "\x1c a\x1f\x85b",
             "\u0000 a \u0000", LONG[:20_000], "😀" * 5, "tab\tand\r\nline \n", "".join(map(chr, range(1, 0x3000)))]
    ids, library = library_ids(texts)
    vocabulary = bpe.Vocabulary.from_file(TOKENIZER)
    encoder = bpe.Encoder(vocabulary, cache=60)
    flat, at = encoder.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == ids
    assert [vocabulary.decoded(np.array(i, np.int64)) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]
    broken = [ids[7][1:2], ids[11][:1], [50256, 0]]
    assert [vocabulary.decoded(np.array(i, np.int64)) for i in broken] == [library.decode(i, skip_special_tokens=False) for i in broken]


def test_round_trip_of_odd_rows(documents):
    docs = documents(*ODD)
    texts = [r[1] or "" for r in ODD]
    ids, _ = library_ids(texts)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = Counter((r[0], len(i), digest(",".join(map(str, i))), digest(t)) for r, i, t in zip(ODD, ids, texts))
    assert Counter(rows(bpe.round_trip(docs, TOKENIZER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == wanted
    encoded = bpe.encode(docs, TOKENIZER)
    assert Counter((d, tuple(i)) for d, i in rows(encoded, "doc_id", "ids")) == Counter((r[0], tuple(i)) for r, i in zip(ODD, ids))
    assert Counter(rows(bpe.decode(encoded, TOKENIZER), "doc_id", "text")) == Counter((r[0], t) for r, t in zip(ODD, texts))
    assert bpe.round_trip(documents(), TOKENIZER).count() == 0


# --- 4

def test_targets_stop_at_twice_their_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 30), ("c", 500)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights a 3, b 1, c 2, null 3: a and null are full, then c, and b gets the rest
    assert found == {"a": 20, "b": 1540 * 1.5 - 20 - 60 - 1000, "c": 1000, None: 60}
    even = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 90), ("b", 90), ("c", 90)], "source string, source_size long")).collect()}
    assert all(math.isclose(even[k], v) for k, v in {"a": 180, "b": 75, "c": 150}.items())


def test_mix_takes_what_the_budget_allows(documents):
    pairs = [(k, "w " * (k % 50 + 1), "abc"[k % 3]) for k in range(600)] + [(r[0] and 1000 + r[0], r[1], None) for r in ODD]
    found = mixing.mix(documents(*pairs)).collect()
    assert len(found) == len(pairs)
    by_source, source_of = defaultdict(list), {p[0]: p[2] for p in pairs}
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_source[source_of[r["doc_id"]]].append(r)
    for own in by_source.values():
        target, = {r["target"] for r in own}
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)} and target <= 2 * own[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert len(by_source) == 4 and any(0 < r["target"] < 2 * r["source_size"] for r in found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(documents(*pairs[::-1])).collect()))
    assert mixing.mix(documents()).count() == 0 and mixing.repeated(documents()).count() == 0


def test_repeated_rows_are_those_taken(documents):
    docs = documents(*[(k, "w " * (k % 50 + 1), "abc"[k % 3]) for k in range(300)], (900, None, "a"))
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in mixing.mix(docs).collect()}
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns
    assert Counter(r["doc_id"] for r in copies.collect()) == Counter({k: v for k, v in taken.items() if v})


# --- 5

@pytest.mark.parametrize("lengths", [None, np.array([6, 2, 4, 1])])
def test_gradients_through_time(lengths):
    net = language_id.fresh(["a", "b"], state=3)
    windows, answers = np.random.default_rng(0).integers(0, 256, (4, 6)), np.array([0, 1, 1, 0])
    _, slopes = language_id.gradients(net, windows, answers, lengths)
    for table, slope in zip((net.embed, net.turn, net.out, net.bias), slopes):
        for at in [tuple(np.unravel_index(k, table.shape)) for k in np.argsort(-np.abs(slope).ravel())[:4]]:
            kept, values = table[at], []
            for step in (1e-5, -1e-5):
                table[at] = kept + step
                values.append(language_id.gradients(net, windows, answers, lengths)[0])
            table[at] = kept
            assert math.isclose((values[0] - values[1]) / 2e-5, slope[at], rel_tol=1e-3, abs_tol=1e-7)


def test_positions_are_labelled_as_in_training():
    net = language_id.fresh(["a", "b", "c"])
    data = np.frombuffer("Ein Satz über alles, and some more of it.".encode(), np.uint8)
    sums = language_id.position_sums(net, *language_id.windows_of(data, np.array([0, len(data)]), 16)[1:])
    h = language_id.STATE
    total = np.zeros(3)
    for a in range(0, len(data), 16):
        part = data[a:a + 16]
        states = []
        for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            state, own = np.zeros(h), {}
            for t in order:
                x = net.embed[d][:, part[t]] + net.turn[d] @ state
                g = x / (1 + abs(x))
                z = 0.5 + 0.5 * g[:h]
                state = z * state + (1 - z) * g[h:]
                own[t] = state
            states.append(own)
        for t in range(len(part)):
            x = np.exp(net.out @ np.concatenate([states[0][t], states[1][t]]) + net.bias)
            total += x / x.sum()
    assert np.allclose(sums.sum(0), total, atol=1e-3)


def test_padding_changes_nothing():
    net = language_id.fresh(["a", "b"], state=3)
    windows = np.random.default_rng(1).integers(0, 256, (1, 5))
    alone, slopes = language_id.gradients(net, windows, np.array([1]))
    wide, padded = language_id.gradients(net, np.pad(windows, ((0, 0), (0, 4))), np.array([1]), np.array([5]))
    assert math.isclose(alone, wide) and all(np.allclose(a, b) for a, b in zip(slopes, padded))


def test_languages_whose_texts_are_all_short_are_learned(documents):
    words = {"xx": "aba bab abba", "yy": "cdc dcd cddc"}
    rows = [(k, words[lang].split()[k % 3] + " " + words[lang].split()[k % 2], "s", lang) for k, lang in ((k, ("xx", "yy")[k % 2]) for k in range(80))]
    docs = documents(*rows)
    net = language_id.fit(docs)
    assert net.languages == ["xx", "yy"]
    found = language_id.predict(docs, net).collect()
    assert all(r["lang_pred"] == ("xx", "yy")[r["doc_id"] % 2] for r in found)


def test_samples_are_bounded_and_of_one_text_each(documents):
    docs = documents(*[(k, f"text {k}", "s", "en" if k % 4 else "de") for k in range(400)], (5, "another text of five", "s", "en"), (6, None, "s", "en"))
    chosen = labelled.sample(docs, "lang", 3, 1, 20, per_class=True)
    assert Counter(r["label"] for r in chosen.collect()) == {"en": 20, "de": 20}
    assert {r["doc_id"] for r in chosen.collect()} == {r["doc_id"] for r in labelled.sample(docs.repartition(5), "lang", 3, 1, 20, per_class=True).collect()}
    assert labelled.sample(docs, "lang", 3, 1, 30).count() == 30 and labelled.sample(docs.limit(0), "lang", 3, 1, 30).count() == 0
    every = labelled.with_label(docs, labelled.sample(docs, "lang", 3, 1, 1000), "text")
    assert every.count() == every.select("doc_id").distinct().count()


def test_languages_of_held_out_documents(sf, documents):
    docs = sf("documents")
    net = language_id.fit(docs)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = language_id.predict(docs, net).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.9
    odd = language_id.predict(documents(*ODD, (20, "123 !?"), (21, "..")), net).collect()
    assert len(odd) == len(ODD) + 2
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {1, 2, 3, 11, 20, 21, None}
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert language_id.predict(documents(), net).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs.limit(5), language_id.fit(docs.limit(0))).collect()} == {"und"}


# --- 6

def test_pairwise_part_in_linear_time():
    rng = np.random.default_rng(2)
    data = b"good words and more good words here"
    f = quality.features_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.array([len(data)]))
    size = quality.WORD_BUCKETS + quality.N_STATS
    m = quality.Machine(0.3, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, quality.FACTORS)), np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    x = np.zeros(size)
    x[f.bucket] = f.value
    x[quality.WORD_BUCKETS:] = np.clip(f.stats[0], -4, 4)
    on = np.flatnonzero(x)
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1:])
    assert math.isclose(m.score(f)[0], 1 / (1 + math.exp(-(0.3 + m.linear @ x + pairs))), rel_tol=1e-9)


def auc(labels, scores):
    good, bad = [s for y, s in zip(labels, scores) if y], [s for y, s in zip(labels, scores) if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def held_out_auc(found, labels, label):
    known = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    own = [r for r in found if r["held_out"] and r["doc_id"] in known]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in own)
    return auc([known[r["doc_id"]] for r in own], [r["score"] for r in own])


def test_quality_of_held_out_documents(spark, documents):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert held_out_auc(quality.score(docs, model).collect(), labels, "quality") >= 0.95
    odd = quality.score(documents(*ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in odd)
    kept = quality.keep_good(docs, model)
    good = {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good
    assert quality.score(documents(), model).count() == 0 and quality.keep_good(documents(), model).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs.limit(5), nothing).collect()} == {0.5}


# --- 7

def brute_groups(pairs):
    groups = defaultdict(list)
    for doc, text in pairs:
        groups[folded(text)].append(doc)
    keep = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return Counter((d, keep[folded(t)], len(groups[folded(t)]), d == keep[folded(t)], hashlib.sha256(folded(t).encode()).hexdigest()) for d, t in pairs)


GROUPS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("block, bits", [(exact_dedup.BLOCK_BYTES, exact_dedup.BUCKET_BITS), (7, 3), (64, 2)])
def test_exact_groups_whatever_the_names_share(documents, block, bits):
    pairs = [(r[0], r[1] if r[1] is None or len(r[1]) < 4000 else r[1][:4000]) for r in ODD]
    pairs += [(50 + k, "Block " * (k % 9) + "É" + "abcdefg" * (k % 4)) for k in range(60)]
    assert Counter(rows(exact_dedup.exact_groups(documents(*pairs), block, bits), *GROUPS)) == brute_groups(pairs)


def test_exact_groups_of_the_smallest_table(sf, documents):
    docs = sf("documents")
    assert Counter(rows(exact_dedup.exact_groups(docs), *GROUPS)) == brute_groups(rows(docs, "doc_id", "text"))
    assert exact_dedup.exact_groups(documents()).count() == 0


def test_one_of_equal_texts_stays(documents):
    docs = documents(*ODD)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(folded(r["text"]) for r in kept.collect()) == Counter({folded(r[1]): 1 for r in ODD})
    assert exact_dedup.keep_one(documents()).count() == 0


# --- 8

def brute_components(pairs):
    sets = {}
    for doc, text in pairs:
        words = WORD.findall(folded(text))
        sets[doc] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    group = {d: d for d in sets}
    def root(d):
        while group[d] != d:
            d = group[d]
        return d
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


NEAR = ("doc_id", "n_shingles", "component_id")


def near_texts():
    rng = np.random.default_rng(9)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 4)))
    base = [word() for _ in range(120)]
    out = []
    for k in range(90):                                   # near copies, some of which link only through others
        own = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 5)):
            own[j] = word()
        out.append((k, " ".join(own)))
    line = " ".join(base[:30])
    out += [(200 + k, line + " " + " ".join(word() for _ in range(rng.integers(3, 30)))) for k in range(60)]
    out += [(300 + k, " ".join(word() for _ in range(40))) for k in range(40)]
    return out + [(400, None), (401, ""), (402, "one"), (403, "ONE"), (404, "one two"), (405, "a b c d e"), (406, "a b c d e f"), (407, "\t")]


@pytest.mark.parametrize("wide, row_block", [(64, 2_000_000), (3, 2_000)])
def test_near_copies_are_those_of_brute_force(documents, monkeypatch, wide, row_block):
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", row_block)
    pairs = near_texts()
    assert sorted(rows(jaccard_join.near_copies(documents(*pairs), 3), *NEAR)) == brute_components(pairs)


def test_near_copies_of_the_smallest_table(sf):
    docs = sf("documents")
    assert sorted(rows(jaccard_join.near_copies(docs), *NEAR)) == brute_components(rows(docs, "doc_id", "text"))


def test_near_copies_of_odd_rows(documents):
    docs = documents(*ODD)
    found = defaultdict(set)
    for d, n, c in rows(jaccard_join.near_copies(docs), *NEAR):
        found[d].add((n, c))
    assert found[1] == {(0, 1)} and found[3] == {(0, 3)} and found[4] == {(1, 4)} and found[5] == {(1, 4)}
    assert found[6] == {(1, 6)} and found[None] == {(1, 6), (0, None)} and {c for _, c in found[9]} == {8}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in ODD} - {5, 9}
    assert jaccard_join.near_copies(documents()).count() == 0


def peak_bytes(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_blobs_of_a_key_are_not_copied():
    kinds, keys = pa.array([1] * 1000, pa.int32()), pa.array([k // 500 for k in range(1000)], pa.int32())
    batch = pa.RecordBatch.from_arrays([kinds, keys, pa.array([b"x" * 10_000] * 1000, pa.binary())], ["kind", "key", "blob"])
    found = []
    peak = peak_bytes(lambda: found.extend((key, len(blobs), bytes(blobs[3][:2])) for key, blobs in jaccard_join._keyed(iter([batch.slice(0, 700), batch.slice(700)]), (1,))))
    assert found == [(0, 500, b"xx"), (1, 500, b"xx")]
    assert peak < 1_000_000


def test_a_block_of_the_product_takes_few_bytes_a_shingle():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 60, 1000).astype(np.uint64)
    sets = [np.concatenate((common[:900], rng.integers(0, 1 << 60, 100).astype(np.uint64))) for _ in range(400)]
    found = []
    peak = peak_bytes(lambda: found.extend(jaccard_join.linked(np.arange(400), np.full(400, 1000), sets)))
    assert len(found) == 399
    assert peak < 30 * 400 * 1000


def test_components_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40, 2)] + [(1, 2), (7, 7)], "a long, b long").mapInArrow(counted, "a long, b long")
    found = dict(rows(components(edges), "node", "component"))
    assert found == {0: 0, 1: 0, 2: 0, 3: 0} | {k: k // 2 * 2 for k in range(4, 40)}
    assert made.value == 22


def test_one_of_each_group_of_near_copies_stays(documents):
    text = lambda name, end="": " ".join(f"{name}{k}" for k in range(60)) + end
    docs = documents((1, text("a")), (2, text("a", " more")), (2, text("b")), (None, text("c")), (None, text("c", " more")), (None, text("c")),
                     (None, text("a", " last")), (3, text("d")), (3, text("d")), (None, ""), (None, ""))
    kept = Counter((r["doc_id"], r["text"].split(" ")[0]) for r in jaccard_join.keep_one(docs, 3).collect())
    assert kept == Counter({(1, "a0"): 1, (2, "b0"): 1, (None, "c0"): 1, (3, "d0"): 1, (None, ""): 2})


# --- 9

def test_marginals_of_the_chain():
    rng = np.random.default_rng(4)
    chain = toxicity.Chain(rng.normal(0, 1, (len(toxicity.PREFIXES) + 1, toxicity.BUCKETS)), -0.5, rng.normal(0, 1, (2, 2)), np.array([0.0, 1.0, 0.0]))
    features = rng.integers(0, toxicity.BUCKETS, (len(toxicity.PREFIXES) + 1, 9)).astype(np.int32)
    e, m = chain.emissions(features), chain.moves
    weights = np.zeros(9)
    total = 0
    for code in range(1 << 9):
        y = [(code >> t) & 1 for t in range(9)]
        w = math.exp(sum(e[t] * y[t] for t in range(9)) + m[0, y[0]] + sum(m[a, b] for a, b in zip(y, y[1:])))
        total += w
        weights += w * np.array(y)
    assert np.allclose(toxicity.marginals(chain, features, np.array([0, 9])), weights / total)


def test_toxicity_of_held_out_documents(spark, documents):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    found = toxicity.score(docs, chain).collect()
    assert held_out_auc(found, labels, "toxic") >= 0.97
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [texts[r["doc_id"]].encode()[s["start"]:s["end"]].decode() for r in found for s in r["spans"]]
    assert Counter(spans).most_common(1)[0][1] > 20 and not any(re.search(r"\s\s", s) for s in spans)
    odd = toxicity.score(documents(*ODD), chain).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd)
    assert all(r["spans"] == [] and r["predicted"] == 0 for r in odd if r["doc_id"] in (1, 2, 3, 11))
    assert toxicity.score(documents(), chain).count() == 0
    assert not any(r["predicted"] for r in toxicity.score(docs.limit(5), toxicity.fit(docs, labels.limit(0))).collect())


def test_near_copies_gather_no_classes_in_the_driver(spark, documents, monkeypatch):
    plans = []

    def note(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def watched(df):
        out = cut(df)
        note(df)
        return out

    monkeypatch.setattr("symtrail.llm.components.cut", watched)
    texts = [(k, " ".join(f"w{k // 3}x{i}" for i in range(40)) + f" y{k}") for k in range(60)]
    near = jaccard_join.near_copies(documents(*texts), 3)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.collect()) == [(k, 37, k // 3 * 3) for k, _ in texts]
    note(near)
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
