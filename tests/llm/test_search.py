"""The permutation index against brute force, and the pipeline against its operators."""

import numpy as np
import pytest

from pricelore.llm import permutation


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(8, 16))
    x = (centers[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:140] = x[99]  # equal vectors: ties go to smaller ids
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [1.0, None] + [0.5] * 14, 0), (None, x[0].tolist(), 0), (5200, [1.0], 0), rows[0]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = permutation.search(frame, frame.where("vec_id % 50 = 0")).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by, hits = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 3000, 50))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        hits += len({r.vec_id for r in found} & set(best.tolist()))
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in found}
        assert all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in found)
    assert hits / (5 * len(by)) >= 0.9
    assert [r.vec_id for r in by[100]] == [99, 101, 102, 103, 104]


def test_ties_across_shards_go_to_smaller_ids(spark):
    """Twenty groups of sixty equal vectors lie in all shards: each member's nearest are the smallest other ids of its group."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    groups = [rng.choice(3000, 60, replace=False) for _ in range(20)]
    groups = [g[~np.isin(g, np.concatenate(groups[:i]))] if i else g for i, g in enumerate(groups)]
    of = {}
    for g in groups:
        x[g] = x[g[0]]
        of |= {int(i): sorted(map(int, g)) for i in g}
    x[2999] = 4 * x[groups[0][0]]  # a multiple has the same cosine
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    by = {}
    for r in permutation.search(frame, frame.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r)
    seen = 0
    for q, found in by.items():
        if q in of and 2999 not in of[q]:
            seen += 1
            assert [r.vec_id for r in found] == [i for i in of[q] if i != q][:5]
            assert len({r.score for r in found}) == 1 and found[0].score == pytest.approx(1.0, abs=1e-15)
    assert seen > 50


def test_search_prunes_and_still_finds_the_nearest(spark):
    n = 20_000  # 64 shards of about 312: more than LEAST / CANDIDATES, so that the rest of a shard isn't reranked
    assert n / 64 > 1.5 * permutation.LEAST / permutation.CANDIDATES
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 32))
    x = centers[rng.integers(0, 40, n)] + rng.normal(size=(n, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in permutation.search(frame, frame.where("vec_id % 500 = 0")).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    assert sorted(by) == list(range(0, n, 500))
    for q, found in by.items():
        score = unit @ unit[q]
        score[q] = -2
        hits += len(found & set(np.argsort(-score)[:5].tolist()))
    assert hits / (5 * len(by)) >= 0.9


def test_search_of_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id) for r in permutation.search(frame, frame.where("vec_id % 50 = 0")).collect()}
    assert got == {(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)}
    assert permutation.search(frame.where("vec_id = 9"), frame).count() == 0
    assert permutation.search(frame, frame.where("vec_id = 9")).count() == 0


def test_footrule_equals_the_plain_sum():
    rng = np.random.default_rng(1)
    order = np.stack([rng.permutation(12)[:6] for _ in range(40)]).astype(np.int16)
    queries = order[:5]
    for q, far in zip(queries, permutation.footrule(queries, order, 12)):
        plain = [sum(abs(i - (list(x).index(p) if p in x else 6)) - (6 - i) for i, p in enumerate(q) if p in x) for x in order]
        assert far.tolist() == plain


def test_pipeline_runs_its_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import random

    import corpus_pipeline
    from pricelore.llm import mixing, quality, queries, simhash, toxicity

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "mixing", "packing"]
    rng = random.Random(3)
    words = "the of and to house river light stone wind garden path cold bread salt".split()
    rows = []
    for i in range(300):
        text = ". ".join(" ".join(rng.choice(words) + str(rng.randrange(40)) if rng.random() < 0.4 else rng.choice(words) for _ in range(12)) for _ in range(8))
        if i % 7 == 0:
            text += ". you filthy wretch"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000 + i, rows[1][1], "en", "s0", 5) for i in range(4)] + [(2000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 7 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    left = docs.where(docs.doc_id.isin([i for i, s in score.items() if s < 0.5]))
    kept = {r.doc_id for r in quality.rules(left).where("kept").collect()}
    left = left.where(left.doc_id.isin(list(kept)))
    one = {r.component_id for r in simhash.near_duplicates(left).collect()}
    left = left.where(left.doc_id.isin(list(one)))
    drawn = {r.doc_id for r in mixing.mix(left).where("sampled").collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == drawn and drawn
    assert 2000 not in drawn and not any(s >= 0.5 and i in drawn for i, s in score.items())
    ids = {}
    for r in sorted(pieces, key=lambda r: r.start):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    text = {r[0]: r[1] for r in rows}
    assert all(v == queries.byte_ids([text[i]])[0] + (1).to_bytes(4, "little") for i, v in ids.items())
