"""Operators on documents, against brute-force versions on small tables with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pricelore.llm import licenses, lm_scoring, mixing, quality, simhash, toxicity
from pricelore.llm.common import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary="the of and to house river light stone wind garden path cold".split()):
    return " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "de"]), f"s{i % 3}") for i in range(60)]
    base = prose(rng, 150)
    rows += [(100 + i, base + f" tail{i}", "en", "hot") for i in range(70)] + [(200 + i, base, "en", "hot") for i in range(5)]
    notice = licenses.TEMPLATES["bsd"].replace("binary forms", "binary strange forms")
    rows += [(300, "See the MIT License and the GNU General Public License. CC-BY, mit  license", "en", "s1"), (301, f"intro words {notice} outro", "en", "s1")]
    rows += [(400, None, "en", "s1"), (401, "", None, None), (402, " \n\t ", "fr", "s1"), (None, "no id at all", "en", "s2"), (0, rows[0][1], "en", "s0")]
    rows += [(500, "x y z w v u " * 40, "en", "s2"), (501, "line one\nline one\n\n# $ %\nline one", "xx", "s2"), (502, prose(rng, 4000), "en", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in corpus()], "doc_id long, text string, lang string, source string, n_words int, kept int").repartition(3)


def brute_components(fps, most):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= most:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def plain_fingerprint(text):
    import xxhash

    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    roots = brute_components(fps, 3)
    least = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{fp:016x}", least.get(root)) for r, fp, root in zip(rows, fps, roots))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


def test_simhash_links_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 8)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(200)}
    center = rng.getrandbits(64)
    for _ in range(300):
        x = center
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    found = {r.node: r.root for r in components(links).collect()}
    ours = {}
    for x, root in zip(fps, brute_components(fps, 3)):
        ours.setdefault(root, set()).add(x)
    theirs = {}
    for x in fps:
        theirs.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {300: 300, 301: 300}


def test_empty_tables(spark, docs):
    none = docs.where("doc_id = -1")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.representatives(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert quality.rules(none).count() == 0
    assert mixing.mix(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert lm_scoring.score(none, lm_scoring.model(none)).count() == 0


def test_representatives_keep_one_of_each_group(docs):
    kept = [r.doc_id for r in simhash.representatives(docs).collect()]
    found = simhash.near_duplicates(docs).collect()
    assert sorted(i for i in kept if i is not None) == sorted({r.component_id for r in found if r.component_id is not None})
    assert kept.count(None) == len({r.fingerprint for r in found if r.component_id is None})
    assert simhash.representatives(docs).columns == docs.columns


def test_representatives_judge_rows_that_share_an_id_by_their_texts(spark):
    copied, other = "river light stone wind garden path " * 5, "entirely different words that nobody has copied from anywhere"
    frame = spark.createDataFrame([(5, copied), (7, copied), (7, other), (None, copied), (8, None)], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in simhash.representatives(frame).collect()}
    assert kept == {(5, copied), (7, other), (8, None)}


def test_representatives_keep_one_of_equal_rows_and_leave_columns_alone(spark):
    """Columns named like the operator's own, nulls that change places, maps, and rows that repeat the smallest id."""
    text, other = "river light stone wind garden path " * 5, "entirely different words that nobody has copied from anywhere"
    rows = [(1, text, 777, None, "a", {"k": 1}), (1, text, 777, None, "a", {"k": 1}), (1, text, None, 777, "a", {"k": 1}), (2, text, 1, 1, "b", None), (None, other, 3, 4, "c", None), (None, other, 3, 4, "c", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _text_hash long, d1 long, row string, `odd.name` map<string,int>")
    got = simhash.representatives(frame)
    assert got.columns == frame.columns
    kept = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(kept) == 2 and kept[1] == rows[4] and kept[0] in (rows[0], rows[2])


def test_license_phrases_equal_the_plain_version(docs):
    got = Counter()
    for r in licenses.scan(docs).collect():
        got[r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] += 1
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    want = Counter()
    for doc_id, text, *_ in corpus():
        n, starts, labels = licenses.plain(text)
        want[doc_id, n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels)] += 1
    assert got == want


def test_license_notices_are_found_by_their_diagonals(docs):
    by = {r.doc_id: r for r in licenses.scan(docs).collect()}
    span = by[301].spans[0]
    n = len(licenses.words(licenses.TEMPLATES["bsd"].encode()))
    assert by[301].labels == "bsd" and len(by[301].spans) == 1 and (span.first_word, span.last_word) == (2, n + 2)
    assert by[100].labels == "" and by[301].score > 0.9


def plain_quality(text):
    text = text or ""
    words = SPACE.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts_equal_the_plain_version(docs):
    rows = quality.rules(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *plain_quality(t)) for i, t, *_ in corpus())
    assert not any(r.kept for r in rows if r.base_failed)


def test_divergence_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    rows = [([3, 1, 0], [0.2, 0.3, 0.5]), ([5, 5, 0], [0.5, 0.5, 0.0]), ([0, 0, 0], [1.0, 0.0, 0.0]), ([4, 0, 0], [0.0, 0.0, 1.0])]
    got = spark.createDataFrame(rows, "c array<long>, s array<double>").select(quality.divergence(F.col("c"), F.col("s"))).collect()
    for (counts, shares), (value,) in zip(rows, got):
        p = np.array(counts) / max(1, sum(counts))
        m = (p + np.array(shares)) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        assert value == pytest.approx(math.sqrt((kl(p) + kl(shares)) / 2) if sum(counts) else 0.0, abs=1e-9)


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 200), "en") for i in range(200)] + [(1000 + i, " | ".join(f"w{rng.randrange(10**6)}" for _ in range(150)), "en") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.rules(frame).where("kept").collect()}
    base = {i for i, t, _ in rows if not plain_quality(t)[-1]}
    assert kept == {i for i in base if i < 1000}
    assert {r.doc_id for r in quality.kept(frame).collect()} == kept


def test_mixing_keeps_the_budget(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    targets = {"source": {"hot": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.2}, "lang": {"en": 0.6, "de": 0.4}}
    rows = mixing.mix(docs, targets, budget=0.5).collect()
    assert len(rows) == len(corpus())
    expected = sum(r.tokens * r.probability for r in rows) / sum(r.tokens for r in rows)
    assert expected == pytest.approx(0.5, abs=0.01)
    assert all(0 <= r.probability <= 1 for r in rows)


def test_mixing_equals_plain_raking(spark):
    cells = [("a", "x", "t", 100), ("a", "y", "t", 300), ("b", "x", "u", 50), ("b", "y", "t", 250), ("b", "x", "t", 10), ("a", "x", "u", 90)]
    got = mixing.fitted(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")).collect()
    weight = {c[:3]: float(c[3]) for c in cells}
    whole = sum(weight.values())
    target = []
    for d in range(3):
        sums = Counter()
        for k, v in weight.items():
            sums[k[d]] += v
        scale = sum(math.sqrt(v) for v in sums.values())
        target.append({k: math.sqrt(v) / scale * whole for k, v in sums.items()})
    for _ in range(300):
        for d in range(3):
            sums = Counter()
            for k, v in weight.items():
                sums[k[d]] += v
            weight = {k: v * target[d][k[d]] / sums[k[d]] for k, v in weight.items()}
    for r in got:
        assert r.weight == pytest.approx(weight[r.source, r.lang, r.topic], rel=1e-3)
    sums = Counter()
    for r in got:
        sums[r.source] += r.weight
    assert all(sums[k] == pytest.approx(v, rel=1e-3) for k, v in target[0].items())


def test_mixing_forms_agree(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    few = {(r.doc_id, r.sampled) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    rows = mixing.mix(docs).collect()
    assert {(r.doc_id, r.sampled) for r in rows} == few and len(rows) == len(corpus())
    assert Counter(r.doc_id for r in mixing.sampled(docs).collect()) == Counter(r.doc_id for r in rows if r.sampled)


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        parts = [prose(rng, 12) for _ in range(6)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            parts[rng.randrange(6)] += " you filthy wretch"
        rows.append((i, ". ".join(parts)))
        labels.append((i, 1, toxic))
    rows += [(9000, None), (9001, ""), (None, "filthy wretch")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    truth = dict((i, t) for i, _, t in labels)
    model = toxicity.train(frame, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(frame, model).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in got if r.doc_id in truth and r.held]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    assert right / len(held) > 0.97
    for r in held:
        if truth[r.doc_id] and r.score >= 0.5:
            assert all("filthy" in s.text for s in r.offending)
    assert {r.score for r in got if r.doc_id in (9000, 9001)} == {0.0}
    kept = {r.doc_id for r in toxicity.kept(frame, model).collect()}
    assert kept == {r.doc_id for r in got if r.score < 0.5}


def test_toxicity_without_labels_finds_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).where("score > 0.01").count() == 0


def test_lm_scores_equal_the_plain_sum(docs):
    vocab = lm_scoring.model(docs)
    rows = lm_scoring.Rows(vocab)
    by = {}
    for r in lm_scoring.score(docs, vocab).collect():
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in corpus():
        parts = licenses.words((text or "").encode())
        want = lm_scoring.log_probabilities(vocab, rows, parts).sum()
        assert any(r.n_tokens == len(parts) and r.pseudo_log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-3) for r in by[doc_id])
        assert all((r.mean_log_probability is None) == (r.n_tokens == 0) for r in by[doc_id])


def test_lm_is_a_distribution_and_prefers_order(spark):
    rng = random.Random(1)
    cycle = "a b c d e f g h".split()
    rows = [(i, " ".join(cycle[(i + j) % 8] for j in range(400))) for i in range(150)]
    mixed = [cycle[rng.randrange(8)] for _ in range(400)]
    rows += [(900, " ".join(mixed)), (901, "zzz qqq " * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    vocab = lm_scoring.model(frame)
    _, z = lm_scoring.forward(vocab.network, lm_scoring.contexts(vocab.classes[:10]))
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-4)
    mean = {r.doc_id: r.mean_log_probability for r in lm_scoring.score(frame, vocab).collect()}
    assert mean[0] > mean[900] + 0.5 and mean[0] > mean[901]
    counts = {bytes(r.word): r.n for r in lm_scoring.word_counts(frame).collect()}
    assert counts[b"zzz"] == 20 and sum(counts.values()) == 151 * 400 + 40


def test_lm_trains_on_every_position(spark):
    cycle = "p q r s t u v w".split()  # every eighth token alone would be one word of the eight
    frame = spark.createDataFrame([(i, " ".join(cycle * (45 + i))) for i in range(150)], "doc_id long, text string").coalesce(1)
    scored = lm_scoring.score(frame, lm_scoring.model(frame)).collect()
    assert min(r.mean_log_probability for r in scored) > -0.2


def test_lm_counts_rare_words(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KNOWN", 6)
    rows = [(i, "a b c d e f " * 3 + f"g g h rare{i}") for i in range(5)] + [(9, "z"), (None, ""), (10, "g h rare9 never")]
    frame = spark.createDataFrame(rows[:-1], "doc_id long, text string")
    vocab = lm_scoring.model(frame)
    counts = {bytes(r.word): r.n for r in lm_scoring.word_counts(frame).collect()}
    assert len(vocab.rows) == 6
    rare = sum(k for w, k in counts.items() if w not in vocab.rows)
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), vocab).collect()}
    assert len(got) == len(rows) and got[None].mean_log_probability is None
    for doc_id, text in rows:
        parts = licenses.words(text.encode())
        c = vocab.classes[[vocab.rows.get(w, len(vocab.classes) - 1) for w in parts]] if parts else np.zeros(0, dtype=int)
        z = lm_scoring.forward(vocab.network, lm_scoring.contexts(c))[1][np.arange(len(c)), c] if parts else np.zeros(0)
        own = [math.log(counts.get(w, 1) / (rare + 1)) for w in parts if w not in vocab.rows]
        assert got[doc_id].pseudo_log_likelihood == pytest.approx(z.sum() + sum(own), rel=1e-4, abs=1e-6)


def test_lm_classes_follow_frequency(spark):
    text = " ".join(f"w{i} " * (400 - i) for i in range(400))
    vocab = lm_scoring.vocabulary(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert (np.diff(vocab.classes) >= 0).all() and vocab.classes[-1] == lm_scoring.CLASSES - 1


def test_quality_measures_each_text_once(docs):
    kept = quality.kept(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "xxhash64" not in plan and len(plan) < 20_000
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter(r.doc_id for r in quality.rules(docs).where("kept").collect())


def test_quality_of_an_empty_table_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    assert quality.kept(docs.where("doc_id = -1")).count() == 0
    odd = docs.select("*", F.lit(1).alias("own"), F.lit("a").alias("m"), F.lit(2).alias("words"))
    kept = quality.kept(odd)
    assert kept.columns == odd.columns and kept.count() == quality.kept(docs).count()


def test_every_language_with_its_share_has_references(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{chr(97 + i % 70 % 26)}{chr(97 + i % 70 // 26)}{rng.choice('xyz')}" for _ in range(60)), f"l{i % 70}") for i in range(420)]
    rows += [(1000, "ax bx cx " * 20, "rare"), (1001, "one two three four five six seven eight nine ten eleven", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = {r.lang: r.words for r in quality.common_words(frame).collect()}
    assert set(common) == {f"l{k}" for k in range(70)} | {""} | ({"rare"} if "rare" in common else set())
    n = Counter(w for _, t, lang in rows if lang == "l7" for w in t.split())
    assert common["l7"] == [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))]
    assert quality.rules(frame).count() == len(rows)


def test_toxicity_score_is_the_noisy_or_of_its_sentences(spark):
    rng = random.Random(6)
    weights = np.zeros(toxicity.FEATURES, dtype=np.float32)
    for w in ("filthy", "wretch"):
        weights[toxicity.features(w.encode())[0]] = 3.0
    model = toxicity.Model(weights, -4.0)
    rows = [(i, prose(rng, 30) + ". you filthy wretch! " * (i % 3)) for i in range(20)] + [(50, "a. " * 30_000), (51, "!!! ... \n\n"), (None, None)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc_id, text in rows:
        clear = 1.0
        for part in re.split(r"[.!?\n]", (text or "").lower()):
            if part.split():
                z = -4.0 + sum(sum(weights[f] for f in toxicity.features(w.encode())) for w in part.split())
                clear *= 1 - 1 / (1 + math.exp(-z))
        assert got[doc_id].score == pytest.approx(1 - clear, rel=1e-5, abs=1e-9)
    assert len(got[2].offending) == 2 and got[51].n_sentences == 0


def test_filters_of_empty_tables_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    model = toxicity.Model(np.zeros(toxicity.FEATURES, dtype=np.float32), -4.0)
    odd = docs.select("*", *(F.lit(1).alias(c) for c in ("row", "draw", "gain", "topic", "tokens", "score", "fp", "component_id", "probability")))
    none = odd.where("doc_id = -1")
    for stage in (lambda d: toxicity.kept(d, model), quality.kept, simhash.representatives, mixing.sampled):
        assert stage(none).columns == odd.columns and stage(none).count() == 0
        assert stage(odd).columns == odd.columns


def test_sampled_shares_meet_the_targets(spark):
    rng = random.Random(12)
    cells = [(s, lang, t, rng.randrange(200, 4000)) for s in "abcdef" for lang in ("x", "y", "z") for t in ("t", "u") if rng.random() < 0.9]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    whole = sum(c[3] for c in cells)
    got = mixing.fitted(frame, budget=0.5).collect()
    assert all(0 <= r.weight <= r.tokens * (1 + 1e-9) for r in got)
    total = sum(r.weight for r in got)
    assert total == pytest.approx(0.5 * whole, rel=1e-3)
    for d in range(3):
        have, sums = Counter(), Counter()
        for c, r in [(c, next(r for r in got if r[:3] == c[:3])) for c in cells]:
            have[c[d]] += c[3]
            sums[c[d]] += r.weight
        level = 0.0
        for _ in range(100):  # what categories lack goes to the others
            full = [k for k in have if have[k] <= level * math.sqrt(have[k])]
            free = sum(math.sqrt(have[k]) for k in have if k not in full)
            level = max(level, (total - sum(have[k] for k in full)) / free) if free else level
        for k in have:
            assert sums[k] == pytest.approx(min(have[k], level * math.sqrt(have[k])), rel=1e-3)


def test_contradicting_targets_are_followed_as_far_as_can_be(spark):
    cells = [("a", "x", "t", 100), ("b", "y", "t", 100), ("c", "z", "t", 50)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = {r.source: r for r in mixing.fitted(frame, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, budget=0.4).collect()}
    assert got["c"].weight == 0 and sum(r.weight for r in got.values()) == pytest.approx(100, rel=1e-3)
    assert {r.followed for r in got.values()} == {0.0}
