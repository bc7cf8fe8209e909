"""Line dedup, substring dedup, SimHash, language ID, mixing, BPE: small tables against brute force."""

import glob
import hashlib
import random
import re
import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import DATA, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rangeweave.llm import bpe, common, lines, mixing, ppm, queries, shingles, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, ids=None, extra=True):
    """A documents table with clashing extra columns."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, None if t is None else "en", f"s{k % 2}", None if t is None else len(t), "x", 1, 2.0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, tag int, h double")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return out


# --- shared ----------------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 30)] + [(3, None), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rolling_hashes_tell_words_apart():
    data = np.frombuffer("ab ba abé a\nab".encode(), dtype=np.uint8)
    starts, ends = common.word_spans(data)
    words = [bytes(data[i:j]) for i, j in zip(starts, ends, strict=True)]
    assert words == [b"ab", b"ba", "abé".encode(), b"a", b"ab"]
    h = common.Roller(1).words(data, starts, ends)
    assert h[0] == h[4]
    assert len(set(h.tolist())) == 4


# --- substrings ------------------------------------------------------------------------------


def brute_repeats(texts, window=20):
    seen, out = set(), {}
    for i in sorted(texts):
        words = WORD.findall(texts[i] or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = [(len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())]
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(1)
    passage, other = sentence(rng, 45), sentence(rng, 20)
    texts = [sentence(rng, 60), passage, f"{sentence(rng, 9)} {passage}\n\t{sentence(rng, 30)}", f"{other} x {other} {passage[:150]}", "", None, "a " * 90, "a " * 50, "é b c", passage, sentence(rng, 19), f"{passage} {passage}"]
    texts += [f"{sentence(rng, rng.randrange(5, 40))} {passage} {sentence(rng, 25)}" for _ in range(30)]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(10)]
    got = substrings.remove_repeats(documents(spark, texts))
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == brute_repeats(dict(enumerate(texts)))
    for r in got.where("kept is not null").collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_repeats_of_repeated_and_null_ids_and_of_nothing(spark):
    rng = random.Random(2)
    p, q = sentence(rng, 30), sentence(rng, 30)
    got = by_id(substrings.remove_repeats(documents(spark, [p, p, q, p, q], [5, 5, 5, None, 9])), "n_removed")
    assert got == {5: [(0,), (0,), (0,)], None: [(30,)], 9: [(30,)]}
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


# --- simhash ---------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_definition_and_spark():
    for text in ("", None, "one", "Two Words", "A b C É d e", "x " * 40):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [sentence(rng, 80).split() for _ in range(25)]
    texts = ["", None, "  \n", "one", "One", "two words"]
    for words in base:
        for _ in range(rng.randrange(1, 7)):
            copy = list(words)
            for _ in range(rng.randrange(0, 2)):
                copy[rng.randrange(80)] = "zz"
            texts.append(" ".join(copy))
    fps = [brute_fingerprint(t) for t in texts]
    least = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    least[a] = least[b] = min(least[a], least[b])
    got = by_id(simhash.near_duplicates(documents(spark, texts)), "fingerprint", "component_id")
    assert got == {i: [(f"{f:016x}", c)] for i, (f, c) in enumerate(zip(fps, least, strict=True))}


@pytest.mark.parametrize("block", [3, 1000])
def test_all_pairs_within_three_bits_are_connected(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.blocks, "__defaults__", ("key", block))
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(30)} | {(1 << 63) - 1, 0}
    for f in list(fps):
        for _ in range(8):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["component"] for r in common.components(links).collect()}
    root = {f: f for f in signed}
    for _ in range(12):
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {f: got.get(f, f) for f in signed} == root


def test_allocation_covers_every_split_of_the_bits():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for n in (500, 10**6, 10**10):
        plan = simhash.allocate(n, bits.T @ bits * (n / 500))
        assert sum(t + 1 for _, t in plan) >= simhash.TAU + 1
        masks = [m & (2**64 - 1) for _, m in simhash.probe_masks(plan)]
        for _ in range(300):
            gone = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(m & gone == 0 for m in masks)


def test_representatives_keep_one_of_each_group_and_rows_without_an_id(spark):
    rng = random.Random(6)
    a, b = sentence(rng, 40), sentence(rng, 40)
    docs = documents(spark, [a, a, b, b, a, None], [4, 2, 3, 3, None, 9])
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 2, 3, 9]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# --- shingles --------------------------------------------------------------------------------


def brute_shingles(text, k=5):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_pipeline_near_dedup_equals_brute_force_jaccard(spark):
    rng = random.Random(13)
    texts = ["", None, " \n", "one", "One", "two words"]
    for _ in range(40):
        words = sentence(rng, 120).split()
        texts.append(" ".join(words))
        for n in (1, 2, 3, 4, 8):  # similarity of about 0.92, 0.84, 0.77, 0.71, 0.5
            copy = list(words)
            for at in rng.sample(range(120), n):
                copy[at] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    sets = [brute_shingles(t) for t in texts]
    least = list(range(len(texts)))
    for _ in range(6):
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    docs = documents(spark, texts)
    got = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == set(least)
    assert len(set(least)) < len({simhash.fingerprint((t or "").encode()) for t in texts})
    assert shingles.representatives(documents(spark, [])).count() == 0


# --- lines -----------------------------------------------------------------------------------


def test_distance_equals_the_table():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        d = table(a, b)
        assert lines.distance(a, b, 20) == d
        assert lines.distance(a, b, 3) == min(d, 4) or lines.distance(a, b, 3) == 4


def test_pairs_in_step_equal_one_by_one():
    rng = random.Random(11)
    for letters in ("ab", "abcdef é", [chr(300 + k) for k in range(400)], "a漢😀"):
        for top in (3, 64, 300):
            a = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, top + 1))) for _ in range(40)]
            b = []
            for x in a:
                y = list(x)
                for _ in range(rng.randrange(rng.choice([2, 8, 60]))):
                    at = rng.randrange(len(y) + 1)
                    y[at : at + rng.randrange(2)] = rng.choice(["", *letters[:2]])
                b.append("".join(y) or "a")
            limits = [abs(len(x) - len(y)) + rng.randrange(12) for x, y in zip(a, b, strict=True)]
            assert lines.within(a, b, limits).tolist() == [lines.distance(x, y, k) <= k for x, y, k in zip(a, b, limits, strict=True)]
            at = [rng.randrange(40) for _ in range(80)], [rng.randrange(40) for _ in range(80)]
            both = a + b
            i, j = [*at[0], *range(40)], [*(40 + k for k in at[1]), *range(40, 80)]
            assert lines.alike_pairs(both, i, j).tolist() == [lines.alike(both[p], both[q]) for p, q in zip(i, j, strict=True)]


def test_keys_that_come_twice_stay_and_others_mostly_go(spark):
    rng = random.Random(12)
    keys = [[rng.getrandbits(64) - 2**63 for _ in range(8)] for _ in range(500)]
    for k in range(0, 60, 2):
        keys[k][0] = keys[k + 1][3]
    for own in keys[60:80]:
        own[1] = 2**63 - 1
    known = spark.createDataFrame([(k, i, 10, i) for i, k in enumerate(keys)], "keys array<long>, a long, size int, fp long").repartition(5)
    want = Counter(k for own in keys for k in own)
    got = Counter(r["g"] for r in lines._met(known).collect())
    assert all(got[k] == n for k, n in want.items() if n > 1)
    assert sum(got.values()) < 0.1 * 4000
    assert lines._met(known.where("a < 0")).count() == 0


def test_texts_of_no_candidate_are_kept_out_before_the_shuffle(spark):
    known = spark.range(1000).selectExpr("xxhash64(id) a", "cast(cast(id as string) as binary) item", "10 size", "id fp", "cast(id as string) norm")
    some = common.stage(known.where("fp < 20").selectExpr("fp % 5 g", "a", "size", "fp"))
    texts = lines._texts(common.stage(known), some)
    assert sorted(len(r["also"]) for r in texts.collect()) == [1] * 20
    plan = [x for x in texts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(plan) == 2 and "__slot" in plan[1] and len(plan[1]) - len(plan[1].lstrip(" :+-")) > len(plan[0]) - len(plan[0].lstrip(" :+-"))


def test_long_lines_are_compared_by_characters_too():
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(1000)]
    other = [f"{w[:4]}z{w[5:]}" if k % 3 == 0 else w for k, w in enumerate(words)]
    assert lines.alike(" ".join(words[:100]), " ".join(other[:100]))
    assert lines.alike(" ".join(words), " ".join(other))


def test_lines_near_copies_go_and_first_ones_stay(spark):
    rng = random.Random(7)
    long = [f"Sentence{k} {sentence(rng, 36, 5000)}" for k in range(12)]
    near = [x.replace(x.split()[9], "changed") for x in long]
    texts = ["\n".join(long[:6]), "\n".join([near[0], "short one", long[6], near[1].upper() + "!!"]), f"{long[6]}\n\n{long[7]}", "", None, f"short one\n{long[8]}\nshort one\n{long[8]}"]
    got = by_id(lines.report(documents(spark, texts)), "n_lines", "n_removed", "kept_sha256")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {0: [(6, 0, digest(texts[0]))], 1: [(4, 2, digest(f"short one\n{long[6]}"))], 2: [(3, 1, digest(f"\n{long[7]}"))], 3: [(0, 0, digest(""))], 4: [(0, 0, digest(""))], 5: [(4, 1, digest(f"short one\n{long[8]}\nshort one"))]}


def test_lines_unlike_ones_stay_and_groups_connect(spark):
    rng = random.Random(9)
    words = sentence(rng, 40, 5000).split()
    chain = []
    for k in range(6):  # each is near the one before, the last is far from the first
        words = [*words]
        words[3 * k] = f"new{k}"
        chain.append(" ".join(words))
    other = [sentence(rng, 40, 5000) for _ in range(20)]
    docs = documents(spark, chain + other)
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {0, *range(6, 26)}


def test_real_lines_near_copies_are_found_as_by_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    norms = sorted({n for t in texts for x in t.split("\n") if len(n := re.sub(r"[\W_]+", " ", x.lower()).strip()) >= 20 and n.count(" ") >= 4})
    rng = random.Random(14)
    base = rng.sample([n for n in norms if n.count(" ") >= 9], 150)
    for x in base:  # a tenth and a sixth of the words replaced by ones of the same length
        for part in (10, 6):
            words = x.split()
            for at in rng.sample(range(len(words)), max(1, len(words) // part)):
                words[at] = "".join(rng.choice("bcdfgh") for _ in words[at])
            norms.append(" ".join(words))
    norms = sorted(set(norms))
    grams = [{x[i : i + 3] for i in range(len(x) - 2)} for x in norms]
    near = [(a, b) for a in range(len(norms)) for b in range(a) if 0.8 * max(len(norms[a]), len(norms[b])) <= min(len(norms[a]), len(norms[b])) and len(grams[a] & grams[b]) >= 0.2 * len(grams[a]) and lines.alike(norms[a], norms[b])]
    root = list(range(len(norms)))
    for _ in range(6):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert len(near) > 250
    got = {r["doc_id"] for r in lines.report(documents(spark, norms)).where("n_removed = 1").collect()}
    want = {i for i, x in enumerate(root) if x != i}
    assert got <= want
    assert len(got) >= 0.98 * len(want)


def test_query_and_pipeline_take_short_lines(spark, tmp_path):
    texts = ["All rights reserved\n\nalpha\n----", "all rights reserved.\nalpha\n\n----\n====", "all rightz reserved\n東京都千代田区丸の内一丁目九番地", "東京都千代田区丸の内一丁目八番地\nbeta"]
    docs = documents(spark, texts, extra=False)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op2_fuzzy_line_dedup(spark, str(tmp_path)), "n_lines", "n_removed")
    assert got == {0: [(4, 0)], 1: [(5, 3)], 2: [(2, 1)], 3: [(2, 1)]}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, DATA).collect()}
    assert kept == {0: texts[0], 1: "\n====", 2: "東京都千代田区丸の内一丁目九番地", 3: "beta"}


def test_lines_repeated_ids_and_nothing(spark):
    rng = random.Random(10)
    a = sentence(rng, 12)
    got = by_id(lines.report(documents(spark, [a, a, a, a], [1, 1, None, 2])), "n_removed")
    assert got == {1: [(0,), (0,)], None: [(1,)], 2: [(1,)]}
    assert lines.report(documents(spark, [])).count() == 0
    kept = lines.without_repeats(documents(spark, [f"{a}\nx", a, "", None]))
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()} == {(0, f"{a}\nx", len(a) + 2), (2, "", 0), (3, None, None)}


# --- languages -------------------------------------------------------------------------------


def brute_bits(model_texts, text, order):
    """Code length by walking contexts down, from counts made here."""
    counts = {}
    for t in model_texts:
        data = b"\n" * order + t.lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                ctx = counts.setdefault(data[i - k : i], {})
                ctx[data[i]] = ctx.get(data[i], 0) + 1
    data, total = b"\n" * order + text.lower().encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            ctx = counts.get(data[i - k : i])
            if ctx is None:
                continue
            n, d = sum(ctx.values()), len(ctx)
            if data[i] in ctx:
                total -= np.log2(ctx[data[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [1, 3])
def test_code_lengths_equal_brute_force(order, monkeypatch):
    monkeypatch.setattr(ppm, "_SLICE", 50)
    texts = {"xx": ["the theme of the other", "then they"], "yy": ["der den die das", "und der"]}
    model = ppm.Model(texts, order)
    probes = ["the den", "Zebra éé", "", "q" * 120 + " the " * 30]
    got = model.lengths([ppm.prepare(p) for p in probes])
    want = [[brute_bits(texts[x], p, order) for x in model.langs] for p in probes]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op8_ppm_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert held
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "123 !!", "the " * 5000, "漢字"]
    docs = documents(spark, texts, [0, 3, 5, 6, 7, 8, None]).withColumn("lang", F.when(F.col("text").startswith("le"), "fr").when(F.col("text").startswith("the"), "en")).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(1))
    got = by_id(ppm.predictions(docs), "lang_pred", "score")
    assert [got[k][0][0] for k in (0, 3, 5, 6, 7, 8)] == ["en", "fr", "und", "und", "und", "en"]
    assert got[5][0][1] == 0
    kept = ppm.accepted(docs)
    assert kept.columns == docs.columns
    assert {0, 3, 8} <= {r["doc_id"] for r in kept.collect()}
    assert not {5, 6, 7} & {r["doc_id"] for r in kept.collect()}
    none = ppm.predictions(documents(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert ppm.predictions(documents(spark, [])).count() == 0


# --- mixing ----------------------------------------------------------------------------------


def test_mixing_equals_sql(spark, duck):
    got, want = queries.op4_systematic_mixing(spark, DATA).toPandas(), duck.execute(mixing.ORACLE).df()
    assert rows_of(got) == rows_of(want)


def test_targets_equal_repeated_capping(spark):
    rng = random.Random(11)
    for trial in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 5, 50, 400, 9000]) for k in range(rng.randrange(1, 9))}
        sizes[None] = 7
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        order = sorted((k for k in sizes if k is not None)) + [None]
        weight = {k: 1 + i % 3 for i, k in enumerate(order)}
        fixed, total = {}, sum(sizes.values())
        while True:
            open_ = [k for k in order if k not in fixed]
            share = (total - sum(fixed.values())) / max(1, sum(weight[k] for k in open_))
            over = [k for k in open_ if share * weight[k] > 3 * sizes[k] + 1e-9]
            if not over:
                break
            fixed |= {k: 3.0 * sizes[k] for k in over}
        want = {k: fixed.get(k, share * weight[k]) for k in order}
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        assert got.keys() == want.keys(), trial
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), trial


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_mix_comes_near_targets_and_repeats(spark, chunk):
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randrange(0, 60)), None if i % 9 == 0 else ("big" if i % 3 else "small")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.report(docs, chunk=chunk).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    assert got == mixing.report(docs, chunk=chunk).collect() or sorted(got) == sorted(mixing.report(docs, chunk=chunk).collect())
    for target in {r["target"] for r in got}:
        taken = sum(r["taken"] for r in got if r["target"] == target)
        assert abs(taken - target) <= 3 * 60
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    mixed = mixing.mix(docs, chunk=chunk)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert all(times.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in got)


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", "s"), (2, None, "s"), (3, "", None), (4, "  \x1c", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.report(docs).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 1, 2, 2, 2]
    assert mixing.mix(docs).count() >= 1
    assert mixing.report(docs.where("false")).count() == 0
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.report(docs.where("doc_id in (2, 3)")).collect())


# --- byte pairs ------------------------------------------------------------------------------

ODD = ["", "a", "A'S B'll it's", "x" * 5000, "abab" * 2000, "ΣΑΣ İI Å", "éßﬁ", "漢字\U0001f642", "a<|endoftext|>b<|startoftext|>", "\x1c\x85 ​ \t\r\n", "1234 ½²", "!?.,;'''", "\x00\x01�"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_text_equal_the_library(name):
    path = public_tokenizers.path(name)
    codec, library = bpe.Codec(bpe.read_vocabulary(path)), Tokenizer.from_file(path)
    rng = random.Random(13)
    letters = "aabcdeehinorstt  \n'éßİΣς漢\U0001f642\x1c\x85 1²!."
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want, ascii(text)
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False), ascii(text)


def test_stream_equals_whole_and_holds_little():
    codec = bpe.Codec(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(14)
    raw = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)).encode()
    waits, read = [], 0

    def pieces():
        nonlocal read
        for at in range(0, len(raw), 100):
            read = at
            yield raw[at : at + 100]

    out, done = [], 0
    for s in codec.merges.stream(pieces()):
        done += len(codec.merges.text[s])
        waits.append(read - done)
        out.append(s)
    assert out == codec.merges.encode(raw)
    assert max(waits) < 4 * (codec.merges.lookahead() + codec.merges.longest)


def test_improper_merges_are_refused():
    with pytest.raises(ValueError, match="rule 0"):
        bpe.Merges({"a": 0, "bc": 1, "abc": 2}, [("a", "bc")])


def test_tokens_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD[:11], None]
    got = by_id(bpe.tokens(documents(spark, texts, [*range(10), None, 3]), path, with_ids=True), "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    want = {}
    for i, t in zip([*range(10), None, 3], texts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.setdefault(i, []).append((len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)), ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.tokens(documents(spark, []), path).count() == 0


# --- odd tables ------------------------------------------------------------------------------


def test_mix_keeps_columns_whose_names_clash(spark):
    names = ["rank", "rows", "copies", "each", "copy", "doc", "size", "tag", "id"]
    docs = documents(spark, ["a b c", None, "", "d e " * 9], [1, None, 2, 2], extra=False)
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert rows and all(r[name] == f"own {name}" for r in rows for name in names)
    assert mixing.mix(docs.where("false")).count() == 0


def test_pipeline_stages_pass_clashing_columns_through(spark):
    docs = documents(spark, ["the cat and the dog\nall the same", "le chat et le chien\nou pas", None, ""], extra=False)
    for name in ("gone", "kept", "doc", "g", "d", "text_", "lang_pred", "score"):
        docs = docs.withColumn(name, F.lit(7))
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, DATA)
        assert got.columns == docs.columns
        assert all(r["gone"] == 7 and r["score"] == 7 for r in got.collect())
        assert step(spark, docs.where("false"), DATA).count() == 0


def test_documents_left_with_line_ends_only_go(spark):
    rng = random.Random(3)
    a, b = sentence(rng, 14), sentence(rng, 14)
    kept = lines.without_repeats(documents(spark, [f"{a}\n{b}", f"{a}\n\n{b}\n", f"{b}\n\t\nnew words of this one only"]))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {0: f"{a}\n{b}", 2: "\t\nnew words of this one only"}


@pytest.mark.parametrize("text", ["½", "²", "①", "Ⅷ", "_", "٣"])
def test_texts_without_letters_have_no_language(text):
    assert not ppm._LETTER.search(text)


def test_candidates_of_a_very_common_key(spark, monkeypatch):
    """Keys of more lines than a block go another way and miss nothing."""
    rng = random.Random(15)
    base = [sentence(rng, 30, 5000) for _ in range(4)]
    texts = []
    for x in base:
        for k in range(40):
            words = x.split()
            words[rng.randrange(30)] = f"x{k}"
            texts.append(" ".join(words))
    whole = by_id(lines.report(documents(spark, texts)), "n_removed")
    assert sum(n for ((n,),) in whole.values()) == len(texts) - 4
    rows = common.stage(lines._hashed(documents(spark, texts), "doc_id", "text", 1))
    keyed = rows.select(F.explode("keys").alias("g"), "a", "size", "fp")
    want = {r["a"] for r in lines._candidates(keyed, 0.8, 0.34).collect()}
    monkeypatch.setattr(simhash.blocks, "__defaults__", ("key", 8))
    monkeypatch.setattr(lines, "BLOCK", 8)
    assert {r["a"] for r in lines._candidates(keyed, 0.8, 0.34).collect()} == want


@pytest.mark.parametrize("words", [6, 10, 20, 36])
def test_recall_of_lines_with_words_replaced(spark, words):
    """Pairs of edit similarity 0.8 or more, by length of the line: nine of ten are found at least."""
    rng = random.Random(words)
    texts, pairs = [], 0
    for _ in range(300):
        own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(words)]
        copy = list(own)
        for at in rng.sample(range(words), max(1, words // 9)):
            copy[at] = "".join(rng.choice("qrstuvwxyz") for _ in copy[at])
        if lines.alike(" ".join(own), " ".join(copy)):
            texts += [" ".join(own), " ".join(copy)]
            pairs += 1
    got = sum(n for ((n,),) in by_id(lines.report(documents(spark, texts), min_words=1), "n_removed").values())
    assert pairs > 60
    assert 0.9 * pairs <= got <= pairs


# --- byte pairs, further ---------------------------------------------------------------------


def naive_pairs(raw, ranks):
    """Lowest rank first, leftmost first, one merge at a time."""
    parts = [bytes([b]) for b in raw]
    while True:
        found = [(ranks[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (a, b) in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_stream_equals_naive_merging_on_random_merge_lists():
    rng = random.Random(16)
    for _ in range(30):
        symbols, merges = ["a", "b", "c"], []
        while len(merges) < 14:
            pair = rng.choice(symbols), rng.choice(symbols)
            if "".join(pair) not in symbols and len("".join(pair)) <= 9:
                merges.append(pair)
                symbols.append("".join(pair))
        own = bpe.Merges({x: i for i, x in enumerate(symbols)}, merges)
        ranks = {(a.encode(), b.encode()): i for i, (a, b) in enumerate(merges)}
        for n in (1, 2, 7, 30, 400):
            raw = "".join(rng.choice("abc") for _ in range(n)).encode()
            want = naive_pairs(raw, ranks)
            for step in (1, 5, n):
                got = [own.text[s] for s in own.stream(raw[i : i + step] for i in range(0, n, step))]
                assert got == want, (merges, raw, step)


def test_every_code_point_reads_as_in_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    codec, library = bpe.Codec(bpe.read_vocabulary(path)), Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 256):
        text = " ".join(f"a{x}b {x} 1{x}́" for x in points[low : low + 256])
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(points[low]))


def test_slices_of_a_text_change_nothing(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    codec, library = bpe.Codec(bpe.read_vocabulary(path)), Tokenizer.from_file(path)
    text = "É á ́b  ΑΣ Σ <|endoftext|>x\n\n½ don't 漢字" * 40
    want = library.encode(text, add_special_tokens=False).ids
    for size in (1, 3, 64):
        monkeypatch.setattr(bpe, "SLICE", size)
        assert codec.encode(text) == want
        state = codec.decoder()
        assert "".join(state.feed(x) for x in codec.parts(text)) + state.end() == library.decode(want, skip_special_tokens=False)


def test_tables_of_characters_are_made_in_little_memory():
    """Lists of all characters took a worker beyond 350 MB, and two of them an executor beyond its own."""
    tracemalloc.start()
    try:
        own = bpe.Tables()
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    assert own.rare == bpe.tables().rare and own.has_rare("՘") and not own.has_rare("aä一")


def test_strangers_that_share_a_common_run_are_no_candidates(spark):
    """With 64 bits 587 of these lines had a partner that passed."""
    rng = random.Random(31)
    texts = [f"{sentence(rng, 40, 5000)} notebook whatever absolute {sentence(rng, 40, 5000)}" for _ in range(600)]
    rows = common.stage(lines._hashed(documents(spark, texts + [texts[0] + " x"]), "doc_id", "text", 1))
    keyed = lines._met(rows.where("keys is not null"))
    assert keyed.groupBy("g").count().agg(F.max("count")).first()[0] >= 600
    assert lines._candidates(keyed, lines.SIMILARITY, lines.SPREAD).select("a").distinct().count() < 200
    assert lines.links(rows).count() == 1


def test_pairs_that_cost_more_than_their_limit_are_given_up(monkeypatch):
    """Strangers were compared to their ends, 2,000 columns."""
    rng = random.Random(41)
    strangers = ["".join(rng.choice("abcdefghijklmnop") for _ in range(2000)) for _ in range(16)]
    near = ["".join(rng.choice("xyz") if rng.random() < 0.1 else c for c in t) for t in strangers]
    columns, real = [], np.packbits

    def packbits(x, **options):
        columns.append(x.shape[0] if x.ndim == 3 else 0)
        return real(x, **options)

    monkeypatch.setattr(lines.np, "packbits", packbits)
    assert not lines.within(strangers[:8], strangers[8:], [400] * 8).any()
    assert 0 < sum(columns) < 1500
    got = lines.within(strangers + strangers[:8], near + strangers[8:], [400] * 24)
    monkeypatch.undo()
    assert got.tolist() == [True] * 16 + [False] * 8
    for n in (0, 1, 7, 48, 49, 300):
        a = ["".join(rng.choice("ab ") for _ in range(n)) for _ in range(9)]
        b = [t[: n // 2] + "".join(rng.choice("abc") for _ in range(rng.randrange(9))) + t[n // 2 :] for t in a[::-1]]
        limits = [abs(len(x) - len(y)) + rng.randrange(n // 3 + 2) for x, y in zip(a, b, strict=True)]
        want = [edits(x, y) <= k for x, y, k in zip(a, b, limits, strict=True)]
        assert lines.within(a, b, limits).tolist() == want == [lines.distance(x, y, k) <= k for x, y, k in zip(a, b, limits, strict=True)]


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_votes_are_those_of_a_plain_count():
    rng = random.Random(42)
    texts = [b"", b"a", b"word " * 9000 + b"x"] + [" ".join(rng.choice(("a", "bcd", "longer" * 5)) + str(rng.randrange(50)) for _ in range(n)).encode() for n in (1, 16, 17, 18, 34, 35, 5000)]
    words = lines.Words(texts)
    for low, high in ((0, 128), (128, 256)):
        hashes = common.mix64(words.hash[:, None] ^ lines._SALTS[low // 64 : high // 64]).view(np.uint8)
        votes = np.unpackbits(hashes, axis=1, bitorder="little") * 2 * np.minimum(words.size, lines.HEAVY)[:, None]
        own = [np.packbits(votes[words.line == k].sum(axis=0) > np.minimum(words.size, lines.HEAVY)[words.line == k].sum(), bitorder="little") for k in range(len(texts))]
        assert (lines.line_hashes(texts, high, low_bit=low) == np.array(own)).all()


def test_only_the_bytes_of_long_words_go_through_the_roller(monkeypatch):
    """Before, all bytes of the texts did."""
    data = np.frombuffer(b"short words " * 100 + b"incomprehensibilities " + b"short words " * 100 + b"antidisestablishmentarianism", dtype=np.uint8)
    starts, ends = common.word_spans(data)
    long, seen, real = common.Roller(5), [], common.Roller.words
    want = real(long, data, starts, ends)
    monkeypatch.setattr(common.Roller, "words", lambda self, data, *a: seen.append(len(data)) or real(self, data, *a))
    got = common.word_hashes(data, starts, ends, long)
    assert seen == [len("incomprehensibilities") + len("antidisestablishmentarianism")]
    assert (got == want)[ends - starts > 16].all()


def test_hashes_are_staged_without_a_dictionary_and_texts_not_sorted(spark):
    docs = documents(spark, ["a line of some words\nand one more of them", "a line of some words\nbut another end"])
    rows = common.stage(lines._hashed(docs, "doc_id", "text", 1), dictionary=False)
    files = glob.glob(rows.staged_at.removeprefix("file://") + "/*.parquet")
    columns = [pq.read_metadata(f).row_group(0).column(k) for f in files for k in range(10) if pq.read_metadata(f).num_rows]
    assert columns and not any("DICTIONARY" in e for c in columns for e in c.encodings)
    plan = lines.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
