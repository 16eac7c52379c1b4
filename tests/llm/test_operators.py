import hashlib
import itertools
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from shutterlake.llm import ann, chat, jaccard, linededup, mixing, packing, quality, sharding, sketches, unigram

BPE = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")


def pairs_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_chat(spark):
    nasty = ["", "plain", "<|end|>", "\\", "\\<|", "<|turn|>assistant<|text|>x<|end|>", " lead", "trail ", "\n\n", "é🙂́", "<", "|>", "<|endoftext|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, None, None), (2, None, "system", "first"), (None, 0, "assistant", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    out = {r.conv_id: r for r in chat.format_conversations(df, BPE).collect()}
    got = chat.parse(out[1].formatted)
    assert [t for _, t in got] == nasty
    for conv, want in ((1, "".join(t for i, t in enumerate(nasty) if i % 2)), (2, ""), (None, "x"), (3, "samesame")):
        r = out[conv]
        assert "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == want
        tok = chat.tokenizer(BPE)
        assert r.ids == tok.encode(r.formatted, add_special_tokens=False).ids
        assert "".join(chat.unescape(tok.decode(r.ids[s.start : s.end], skip_special_tokens=False)) for s in r.loss_tokens) == want
    assert chat.parse(out[2].formatted) == [("system", "first"), ("", "")]
    assert chat.format_conversations(df.limit(0), BPE).count() == 0


def test_chat_runs_of_turns_encode_alike(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", f" text {i} ") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(df, BPE).first()
    c = chat._Conversation(1, chat.tokenizer(BPE))
    monkeypatch.setattr(chat, "RUN_CHARS", 30)
    for _, _, role, text in rows:
        c.add(role, text)
    cut = c.row()
    assert cut["ids"] == whole.ids and [tuple(x.values()) for x in cut["loss_spans"]] == [tuple(x) for x in whole.loss_spans]


def brute_nearest(vectors, queries, k):
    for q in queries:
        d = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)
        yield q, d[:k]


@pytest.mark.parametrize(("sf", "every", "tiles"), [("sf0.001", 10, None), ("sf0.1", 20, None), ("sf0.001", 10, (60, 7))])
def test_ann_recall_and_exact_scores(spark, sf, every, tiles, monkeypatch):
    if tiles:
        monkeypatch.setattr(ann, "SCAN_ROWS", tiles[0])
        monkeypatch.setattr(ann, "QUERY_ROWS", tiles[1])
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in rows.collect()}
    got = defaultdict(dict)
    for r in ann.nearest(rows, F.col("vec_id") % every == 0).collect():
        got[r.query_id][r.vec_id] = r.score
    hits = total = 0
    for q, near in brute_nearest(vectors, [v for v in vectors if v % every == 0], 10):
        total += len(near)
        hits += sum(i in got[q] for _, i in near)
        assert all(abs(math.dist(vectors[q], vectors[i]) - s) < 1e-9 for i, s in got[q].items())
        assert len(got[q]) == 10
    assert hits / total >= 0.9


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [3.0, 4.0]), (9, []), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = pairs_of(ann.nearest(df, F.col("vec_id") % 2 == 0, k=2), "query_id", "rank", "vec_id")
    assert sorted(got) == [(0, 1, 1), (0, 2, 2), (2, 1, 0), (2, 2, 1), (8, 1, 0), (8, 2, 1)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_unigram_counts_are_the_tokenizers(spark, odd, sf):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = unigram.vocabulary(PIECES)
    low = min(s for _, s in vocab)
    for fallback in (True, False):
        extra = [(f"<0x{b:02X}>", low) for b in range(256)] if fallback else []
        tok = Tokenizer(models.Unigram([("<unk>", low), *vocab, *extra], unk_id=0, byte_fallback=fallback))
        tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        texts = [r.text or "" for r in odd.collect()] + ["  a  b ", "日本語🙂🙂", "a▁b", "aaaa" * 50] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
        c = unigram.Counter(vocab, fallback)
        assert [c.count(t) for t in texts] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    out = unigram.count_tokens(odd, PIECES)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == odd.count()
    assert unigram.token_counts(odd.limit(0), PIECES).count() == 0


def test_unigram_ties():
    vocab = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    assert unigram.Counter(vocab).count("ab") == 2  # the longer last piece wins among equal paths


def test_min_cost_flow_uses_overlap_before_repeats():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 15})
    taken = {p: sum(f.values()) for p, f in flow.items()}
    assert sum(f.get("a", 0) for f in flow.values()) == 20 and sum(f.get("b", 0) for f in flow.values()) == 15
    assert max(taken.values()) <= 20 and sum(max(0, t - 10) for t in taken.values()) == 5


def least_cost(patterns, quotas, repeats):
    """Least repetition cost of meeting as much of the quotas as can be met, by trying all."""
    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for split in itertools.product(*[range(min(patterns[p] * repeats, quotas[s]) + 1) for p, s in arcs]):
        taken, met = Counter(), Counter()
        for (p, s), n in zip(arcs, split, strict=True):
            taken[p] += n
            met[s] += n
        if all(taken[p] <= repeats * patterns[p] for p in patterns) and all(met[s] <= quotas[s] for s in quotas):
            cost = sum(max(0, taken[p] - r * patterns[p]) for p in patterns for r in range(1, repeats))
            best = min(best, (-sum(met.values()), cost))
    return best


@pytest.mark.parametrize("case", range(12))
def test_min_cost_flow_by_trying_all(case):
    rng = np.random.default_rng(case)
    patterns = {p: int(rng.integers(1, 4)) for p in [("a",), ("a", "b"), ("b",), ("b", "c")][: 2 + case % 3]}
    quotas = {s: int(rng.integers(0, 6)) for s in "abc"}
    repeats = 2 + case % 2
    flow = mixing.min_cost_flow(patterns, quotas, repeats)
    taken = {p: sum(f.values()) for p, f in flow.items()}
    met = {s: sum(f.get(s, 0) for f in flow.values()) for s in quotas}
    assert all(taken[p] <= repeats * patterns[p] for p in patterns) and all(met[s] <= quotas[s] for s in quotas)
    cost = sum(max(0, taken[p] - r * patterns[p]) for p in patterns for r in range(1, repeats))
    assert (-sum(met.values()), cost) == least_cost(patterns, quotas, repeats)


def test_mix(spark, odd):
    out = mixing.mixture(odd).collect()
    assert len(out) == odd.count()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size, r.target][0] += r.taken
    for (_, target), (taken, _, _) in by.items():
        assert abs(taken - target) <= 1
    assert sorted(map(tuple, mixing.mixture(odd).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert mixing.mixture(odd.limit(0)).count() == 0
    t = mixing.weighted_targets([("a", 100), ("b", 100), (None, 100)])
    assert t["a"] == 200 and abs(sum(t.values()) - 450) < 1e-9 and t[None] == pytest.approx(250 / 3)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark, odd):
    keys = [0, 1, 2, 77, -1, -(2**63), 2**63 - 1, *range(1000, 1300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 1000):
        assert [r[0] for r in df.select(sharding.jump_hash("k", n)).collect()] == [jump(k % 2**64, n) for k in keys]
    out = sharding.shard_documents(odd).collect()
    places = defaultdict(list)
    for r in out:
        assert r.grown_shard in (r.shard, 16)
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and len(out) == odd.count()
    assert {r["size"]: r.text_crc32 for r in out}[1] == 0
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_line_templates(spark, odd):
    df = lines(spark, ["user 17 logged in from berlin today\nonly here stands this line", "user 99 logged in from berlin today\nshort one", "a b c d x1\nshort one", None, ""])
    got = dict(pairs_of(linededup.drop_recurring_lines(df), "doc_id", "text"))
    assert got == {0: df.first().text, 1: "short one", 2: "a b c d x1", 3: None, 4: ""}
    varied = lines(spark, [f"job started by {n} on the main queue of this host" for n in ("ann", "bob", "cid")])
    assert [r.text for r in linededup.drop_recurring_lines(varied).orderBy("doc_id").collect()] == [varied.first().text, "", ""]
    unlike = lines(spark, ["the big red fox ran far away over hills", "the big red car was not sold for months"])
    assert linededup.drop_recurring_lines(unlike).where("text = ''").count() == 0
    assert linededup.drop_recurring_lines(varied, min_docs=4).where("text = ''").count() == 0
    assert [r.text for r in linededup.drop_recurring_lines(varied, min_docs=3).orderBy("doc_id").collect()] == [varied.first().text, "", ""]
    out = linededup.drop_recurring_lines(odd, counts=True)
    assert out.count() == odd.count() and out.where("doc_id = 1 and text = ''").count() == 0
    assert linededup.drop_recurring_lines(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [4, 10, 1000])
def test_fields_of_few_values_stay_fields(spark, n):
    few = [("ann", "alpha"), ("bob", "beta"), ("ann", "beta"), ("bob", "alpha")] if n == 4 else [(f"n{chr(97 + i % 10)}", f"h{chr(97 + i % 7)}") for i in range(n)]
    df = lines(spark, [f"job started by {x} on the main queue of the host {y}" for x, y in few])
    got = pairs_of(linededup.drop_recurring_lines(df), "doc_id", "text")
    assert sorted(got) == [(0, df.first().text), *((i, "") for i in range(1, n))]


def test_lines_of_numbers_recur_where_equal(spark):
    df = lines(spark, ["12 34 56 78\n| 12 | 15 | 18 |\nborn 12 May 1950\nuser 17 logged in from berlin today", "90 11 22 33\n| 12 | 15 | 19 |\nborn 3 May 1961\nuser 99 logged in from berlin today", "12 34  56 78\n| 12 | 15 | 18 |\nborn 12 May 1951"])
    got = [r.text for r in linededup.drop_recurring_lines(df).orderBy("doc_id").collect()]
    assert got == [df.first().text, "90 11 22 33\n| 12 | 15 | 19 |\nborn 3 May 1961", "born 12 May 1951"]


def test_short_lines_recur_whole(spark):
    df = lines(spark, ["All rights reserved.\n\npage 1\nLes.", " All  rights\treserved.\n\npage 2\nLes.", "all rights reserved.\n \npage 1"])
    got = [r.text for r in linededup.drop_recurring_lines(df).orderBy("doc_id").collect()]
    assert got == [df.first().text, "\npage 2", "all rights reserved.\n "]


def test_texts_of_many_lines(spark):
    # 80,000 lines a text: the time a line takes must not grow with their number
    long = "\n".join(f"this is one of a great many lines and its word is {'x' * (i % 50)}{chr(97 + i % 26)}" for i in range(80_000))
    df = lines(spark, [long, long + "\nthe last line of all stays here"])
    start = time.time()
    got = [r.text for r in linededup.drop_recurring_lines(df).orderBy("doc_id").collect()]
    assert got == [long, "the last line of all stays here"]
    assert time.time() - start < 60


def test_a_rare_template_of_a_leaf_recurs_too(spark):
    often = [f"the new job of {x} was put on the main queue" for x in ("ann", "bob", "cid", "dan")]
    df = lines(spark, [*often, *[f"the new job {x} never ran as its host fell" for x in ("alpha", "beta")]])
    got = [r.text for r in linededup.drop_recurring_lines(df).orderBy("doc_id").collect()]
    assert got == [often[0], "", "", "", "the new job alpha never ran as its host fell", ""]


def spark_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else int(v).to_bytes(8, "little", signed=True), seed & (2**64 - 1))
        seed = seed - 2**64 if seed >= 2**63 else seed
    return seed


def brute_sketch(text, k=128):
    w = [spark_hash([x.encode()]) for x in text.translate({c: " " for c in range(9, 14)}).split(" ") if x]
    h = {spark_hash(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {spark_hash(w)} if w else set()
    return sorted(h)[:k]


def brute_likeness(a, b, k=128):
    u = sorted(set(a) | set(b))[:k]
    return 1.0 if not u else len(set(u) & set(a) & set(b)) / len(u)


def test_fingerprints_by_brute_force(spark, odd):
    out = sketches.fingerprint_documents(odd).collect()
    docs = sorted([(r.doc_id, r.text or "") for r in odd.collect()], key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()), reverse=True)
    show = lambda s: "".join(f"{h % 2**64:016x}" for h in s)
    want = []
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), brute_likeness(a, b), brute_likeness(a, c)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert sketches.fingerprint_documents(odd.limit(0)).count() == 0


def test_next_crosses_blocks(spark):
    ids = [0, 1, 2, 3, 500, 501, 900, 1000]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.text: r.next_text for r in sketches.with_next(df, rows=2).collect()}
    assert got == {f"t{i}": f"t{ids[k - 1]}" for k, i in enumerate(ids)}


@pytest.mark.parametrize("ids", [[0, 5, 2**62], [-(2**63), 5, 2**63 - 1], [-1, 0, None, 7], [*range(3000), 10**15, -(10**15)], [None] * 40, [7] * 40])
def test_next_of_any_ids(spark, ids):
    df = spark.createDataFrame([(d, f"{i:05d}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(3)
    out = sketches.with_next(df, rows=100 if len(ids) > 100 else 2).collect()
    order = [t for _, _, t in sorted(((d is not None, d or 0, f"{i:05d}") for i, d in enumerate(ids)), reverse=True)]
    assert {r.text: r.next_text for r in out} == dict(zip(order, [*order[1:], order[0]], strict=True))
    sizes = Counter(r.block for r in out)
    assert max(sizes.values()) <= max(12, len(ids) // 10) and len(out) == len(ids)


def test_block_of_many_bounds(spark):
    bounds = [f"{i:06d}" for i in range(0, 3000, 3)]
    keys = [f"{i:06d}" for i in range(-3 % 7, 3100, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(sketches.block_of(F.col("k"), bounds)).collect()] == [sum(b <= k for b in bounds) for k in keys]


def test_sketch_estimates_and_merges(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1000, 4000))
    df = sketches.with_sketch(spark.createDataFrame([("x", a), ("x", b), ("y", None)], "g string, text string"))
    both = df.where("g = 'x'").select(F.collect_list("sketch").alias("s")).select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    r = both.select(sketches.resemblance("a", "b").alias("j"), sketches.containment("a", "b").alias("c"), sketches.distinct_estimate("a").alias("n")).first()
    assert abs(r.j - 0.5) < 0.15 and abs(r.c - 2 / 3) < 0.2 and abs(r.n - 2996) < 900
    merged = {r.g: r.sketch for r in sketches.merge_sketches(df, ["g"]).collect()}
    whole = {tuple(r.s) for r in both.select(sketches.merge("a", "b").alias("s")).collect()}
    assert {tuple(merged["x"])} == whole and merged["y"] == []


def word_sets(rows, width):
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        yield doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def count_components(rows, width, percent):
    return len({g for g, (_, s) in zip(*grouped(rows, width, percent), strict=True) if s})


def grouped(rows, width, percent):
    sets = list(word_sets(rows, width))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group, sets


def brute_components(rows, width, percent):
    group, sets = grouped(rows, width, percent)
    least = {}
    for (d, s), g in zip(sets, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, len(s), least.get(g)) for (d, s), g in zip(sets, group, strict=True)), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_similarity_components_by_brute_force(spark, odd, width, percent):
    rng = np.random.default_rng(width)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for base in range(6):
        words = [f"b{base}w{x}" for x in rng.integers(0, 60, rng.integers(5, 120))]
        for copy in range(5):
            edited = [w if rng.random() > 0.01 * copy else "new" for w in words]
            rows.append((100 + 10 * base + copy, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = sorted(pairs_of(jaccard.similarity_components(df, width, percent), "doc_id", "n_shingles", "component_id"), key=str)
    assert got == brute_components(rows, width, percent)
    kept = pairs_of(jaccard.keep_one_of_each(df, width, percent), "doc_id", "text")
    wordless = [(d, t) for d, t in rows if not (t or "").encode().split()]
    assert len(kept) == len(wordless) + count_components(rows, width, percent)
    assert not Counter(kept) - Counter(rows) and not Counter(wordless) - Counter(kept)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_similarity_join_loses_no_link(spark, odd, width, percent):
    rng = np.random.default_rng(width)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for base in range(3):  # groups in which every two are linked, with exact copies
        words = [f"b{base}w{x}" for x in rng.integers(0, 60, 120)]
        texts = [" ".join([*words[: 120 - i], *[f"new{i}"] * (i > 0)]) for i in range(5)]
        rows += [(100 + 10 * base + i, t) for i, t in enumerate([*texts, texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    members, links = jaccard.similarity_join(df, width, percent)
    sets = [s for _, s in word_sets(rows, width)]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    keys = [jaccard.set_key(jaccard.shingles(t, width)) if s else None for (_, t), s in zip(rows, sets, strict=True)]
    counts = [sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    want = sorted(((d, len(s), k, n) for (d, _), s, k, n in zip(rows, sets, keys, counts, strict=True)), key=str)
    found = [(r.doc_id, r.n_shingles, r.set_key and bytes(r.set_key), r.n_links) for r in members.collect()]
    assert sorted(found, key=str) == want
    pairs = {(a, b) for a, x in zip(keys, sets, strict=True) for b, y in zip(keys, sets, strict=True) if a and b and a < b and near(x, y)}
    assert sorted((bytes(r.u), bytes(r.v)) for r in links.collect()) == sorted(pairs)
    assert sorted(pairs_of(members, "doc_id", "n_shingles", "component_id"), key=str) == brute_components(rows, width, percent)


def test_one_row_of_each_component_stays(spark):
    near = " ".join(f"w{i}" for i in range(60))
    clean, alone = "a clean text of a number that comes twice in this table", "a text without a number that comes twice as a copy"
    rows = [(1, near + " end"), (2, near), (2, clean), (2, clean), (None, alone), (None, alone), (None, "another text without a number is here"), (2, ""), (2, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pairs_of(jaccard.keep_one_of_each(df), "doc_id", "text")
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], *rows[6:]], key=str)
    assert jaccard.keep_one_of_each(df.limit(0)).count() == 0


def test_similarity_join_of_nothing(spark, odd):
    members, links = jaccard.similarity_join(odd.limit(0))
    assert members.count() == links.count() == 0


def test_similarity_of_nothing(spark, odd):
    assert jaccard.similarity_components(odd.limit(0)).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(0)
    lists = [sorted({int(x) for x in rng.integers(0, 50, int(rng.integers(1, 40)))}) for _ in range(30)]
    for need in (1, 3, 10, 20, 31):
        want = {i: n for i in range(50) if (n := sum(i in x for x in lists)) >= need}
        assert jaccard.divide_skip(lists, need) == want


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_the_index_finds_all_with_less_work_than_a_full_merge(percent):
    rng = np.random.default_rng(percent)
    base = [np.unique(rng.integers(0, 2**62, 300).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.02 * i, rng.integers(0, 2**62, len(b)).astype(np.uint64), b)) for b in base for i in range(40)] + [np.zeros(0, np.uint64)]
    index, least = jaccard.Index(sets), 0
    for q in (base[0], sets[50], np.zeros(0, np.uint64), rng.integers(0, 2**62, 20).astype(np.uint64)):
        work = {}
        want = [i for i, s in enumerate(sets) if len(s) and len(q) and 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
        assert sorted(index.search(q, percent, work)) == want
        entries = sum(map(len, index.lists(q)))
        assert work.get("merged", 0) <= entries / 2 and work.get("merged", 0) + work.get("probes", 0) <= entries + len(q)
        least = max(least, entries)
    assert least > 1000
    assert jaccard.Index([]).search(base[0], percent) == []


def test_parity_never_loses_a_pair():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 900))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 80 * (len(a) + len(b) - same):
            assert jaccard.near_by_parity([jaccard.parity(a)], [jaccard.parity(b)], np.array([len(a)]), np.array([len(b)]), 80).all()


def test_packing(spark, odd, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ["", "a", " a", "a ", "a  b", "x <|endoftext|> y", "a\nb", "a\n\nb", "a \nb", " x y  z", "don't  stop", *[r.text or "" for r in odd.collect()]]
    e = packing.encoder(BPE)
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df, lot in ((docs, 10_000), (docs, 1 << 20), (odd, 4096)):
        pieces = packing.pack(df, BPE, lot=lot).collect()
        made = defaultdict(list)
        seqs = defaultdict(list)
        for p in pieces:
            made[p.doc_id, p.doc_tokens].append((p.start, p.length))
            seqs[p.sequence_id].append((p.offset, p.length))
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at == 2048 or at & (at - 1) == 0 and at < 2048
        want = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in df.collect())
        assert sum(p.length for p in pieces) == want
        if df is docs:
            ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
            for p in pieces:
                assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length]
            for (d, n), parts in made.items():
                assert sum(x for _, x in parts) == n == len(ids[d])
    r = packing.crc32_of_ids(packing.pack(docs, BPE)).first()
    assert 0 <= r.ids_crc32 < 2**32
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_packing_balances_cost():
    sizes = [900, 800, 700, 600, 500, 400, 100, 96]
    got = packing.assign(sizes, [2048, 2048])
    cost = defaultdict(float)
    for _, _, n, k in got:
        cost[k] += packing.cost(n)
    assert abs(cost[0] - cost[1]) < 0.2 * max(cost.values())


@pytest.mark.parametrize("case", range(30))
def test_packing_assigns_as_plain_loops_do(case):
    rng = np.random.default_rng(case)
    sizes = [int(x) for x in rng.integers(0, 40, rng.integers(1, 30))]
    room = packing.capacities(sum(sizes), 32, True)
    left, spent, pieces, want = [*room], [0.0] * len(room), [(n, i, 0) for i, n in enumerate(sizes) if n], []
    while pieces:
        n, doc, start = sorted(pieces, key=lambda p: (-p[0], p[1], p[2]))[0]
        pieces.remove((n, doc, start))
        able = [k for k in range(len(room)) if left[k] >= n]
        k = min(able, key=lambda k: (spent[k], k)) if able else max(range(len(room)), key=lambda k: (left[k], -k))
        take = min(n, left[k])
        if take < n:
            pieces.append((n - take, doc, start + take))
        want.append((doc, start, take, k))
        left[k] -= take
        spent[k] += packing.cost(take)
    assert packing.assign(sizes, room) == want and not any(left)


def plain_risk(gp, gu, prior):
    loss = lambda x: math.log1p(math.exp(-x))
    first = prior * sum(loss(g) for g in gp) / len(gp)
    second = sum(loss(-g) for g in gu) / len(gu) - prior * sum(loss(-g) for g in gp) / len(gp)
    return first, second


def test_risk_and_gradient():
    rng = np.random.default_rng(3)
    seen = set()
    for prior, shift in itertools.product((0.2, 0.6, 0.95), (-4.0, 0.0, 4.0)):  # the second part is above and below 0
        net = quality.Network(rng.normal(1, 1, (25, 4)), rng.normal(0, 1, (40, 4)), prior, steps=3)
        net.w[4] = np.array([shift])
        p, u = rng.normal(1, 1, (25, 4)), rng.normal(0, 1, (40, 4)) - (shift < 0)
        first, second = quality.risk_parts(net.logit(p), net.logit(u), prior)
        assert (first, second) == pytest.approx(plain_risk(net.logit(p).tolist(), net.logit(u).tolist(), prior))
        seen.add(second >= 0)

        def objective():
            a, b = plain_risk(net.logit(p).tolist(), net.logit(u).tolist(), prior)
            return (a + b if second >= 0 else -b) + quality.DECAY / 2 * sum(float((w * w).sum()) for w in net.w)

        for w, g in zip(net.w, net.gradient(p, u), strict=True):
            for at in np.ndindex(w.shape):
                kept, w[at] = w[at], w[at] + 1e-5
                high = objective()
                w[at] = kept - 1e-5
                low = objective()
                w[at] = kept
                assert (high - low) / 2e-5 == pytest.approx(g[at], abs=1e-6)
    assert seen == {True, False}


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_is_estimated_without_negatives(prior):
    rng = np.random.default_rng(4)
    draw = lambda n, y: rng.normal(1.5 * y, 1, (n, 3))
    n = int(3000 * prior)
    unlabelled = rng.permutation(np.concatenate([draw(n, 1), draw(3000 - n, -1)]))
    assert abs(quality.estimate_prior(draw(2000, 1), unlabelled) - prior) < 0.08
    assert quality.estimate_prior(draw(5, 1), unlabelled) == quality.FEW_PRIOR


def test_quality_of_repeated_ids(spark):
    good, bad = "a plain sentence of words that reads well and ends here.", "$$$ ### !!! @@@"
    docs = spark.createDataFrame([(1, good)] * 3000 + [(2, bad)] * 50 + [(None, bad)] * 50 + [(i, good if i % 2 else bad) for i in range(3, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 3000 + [(i, i % 2) for i in range(3, 200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = {}
    frame, quality_rows = quality._featured, quality._some_ids(docs, 10, "web")
    assert quality_rows.count() == 10 == quality_rows.distinct().count()

    def counted(df, keep):
        rows["n"] = df.count()
        return frame(df, keep)

    quality._featured = counted
    try:
        net = quality.fit(docs, labels)
    finally:
        quality._featured = frame
    assert rows["n"] <= 2 * 199 and net is not None
    out = quality.scores(docs, labels)
    assert out.count() == docs.count()


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    held = [(got[r.doc_id].score, got[r.doc_id].predicted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels.collect())
    pos, neg = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    accuracy = np.mean([p == y for _, p, y in held])
    assert auc > 0.95 and accuracy > 0.9, (auc, accuracy)
    out = quality.scores(odd, labels)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    none = quality.scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scores(odd.limit(0), labels).count() == 0
