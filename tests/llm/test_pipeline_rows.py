"""The stages after the classifier, and run()'s rows, against plain Python and SQL."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as p
import duckdb
import public_tokenizers as P
from test_operators import brute_components

from shutterlake.llm import quality
from shutterlake.llm import queries as q


def brute_lines(rows):
    """doc_id: text, without lines that recur; ids are unique."""
    keys, leaves = {}, defaultdict(lambda: defaultdict(set))
    for d, text in rows:
        for i, line in enumerate(text.split("\n")):
            tokens = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            mask = tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)
            if len(tokens) < 4 or sum(t != "<*>" for t in mask) < 0.7 * len(tokens):
                keys[d, i] = [("line", tokens)] if tokens else []
            else:
                keys[d, i] = mask
                leaves[len(mask), mask[:3]][mask].add(d)
    made = {}
    for texts in leaves.values():
        count, docs = Counter(), defaultdict(set)
        for mask, ids in texts.items():
            for c in enumerate(mask):
                count[c] += 1
                docs[c] |= ids
        for mask in texts:
            laws = ([c[1] != "<*>" and len(docs[c]) > 1 and count[c] > least * len(texts) for c in enumerate(mask)] for least in (0, 0.5))
            found = [tuple(t if f else "<*>" for t, f in zip(mask, law, strict=True)) for law in laws if sum(law) >= 0.7 * len(mask)]
            made[mask] = [("template", x) for x in found] or [("mask", mask)]
    keys = {k: made[v] if isinstance(v, tuple) else v for k, v in keys.items()}
    first = {}
    for (d, _), names in keys.items():
        for x in names:
            first[x] = min(d, first.get(x, d))
    out = {}
    for d, text in rows:
        kept = [line for i, line in enumerate(text.split("\n")) if not any(first[x] < d for x in keys[d, i])]
        new = "\n".join(kept)
        if new == text or re.search(r"[^\x20\x09-\x0D]", new):
            out[d] = new
    return out


def test_stages_and_run_by_brute_force(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    # near copies in one line each, which no template catches
    copies = [r.asDict() | {"doc_id": 10_000 + r.doc_id, "text": " ".join(["copied", *r.text.split()])} for r in docs.orderBy("doc_id").limit(40).collect()]
    docs.union(spark.createDataFrame(copies, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.scores(docs, labels).collect() if r.predicted == 1}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    stage = p.quality_stage(spark, docs, sf)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(good) and 0 < len(good) < docs.count()
    lines = brute_lines(rows)
    assert lines != dict(rows)
    stage = p.line_stage(spark, spark.createDataFrame(stage.collect(), stage.schema), sf)
    assert {r.doc_id: r.text for r in stage.collect()} == lines
    near = {d for d, _, c in brute_components(sorted(lines.items()), 5, 80) if d == c}
    near |= {d for d, t in lines.items() if not t.split()}
    assert len(near) < len(lines)
    stage = p.near_stage(spark, spark.createDataFrame(stage.collect(), stage.schema), sf)
    kept = stage.collect()
    assert {r.doc_id for r in kept} == near and len(kept) == len(near)
    con = duckdb.connect()
    con.register("documents", stage.toPandas())
    times = {d: -(-taken // max(size, 1)) for d, size, taken in con.execute(f"select doc_id, size, taken from ({q.oracle_sql()['op4_flow_mix']})").fetchall()}
    stage = p.mix_stage(spark, spark.createDataFrame(kept, stage.schema), sf)
    assert Counter(r.doc_id for r in stage.collect()) == {d: n for d, n in times.items() if n}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: n * (len(tok.encode(lines[d], add_special_tokens=False).ids) + 1) for d, n in times.items() if n}
    got = Counter()
    for r in p.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want
