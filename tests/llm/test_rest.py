"""Neighbours, toxicity, mixing, url filter, pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlake.llm import ann, mixing, toxicity, url_filter
from gridlake.llm.common import without_rows


def brute_neighbours(ids, vectors, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


@pytest.mark.parametrize("kind", ["unit", "clusters", "lengths"])
def test_recall(frame, kind):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((1500, 24))
    if kind == "clusters":
        x = x[draw.integers(0, 40, 1500)] + 0.2 * draw.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= draw.uniform(0.5, 2, (1500, 1))
    ids = np.arange(1500)
    got = ann.search(frame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), block=400, queries=30).collect()
    want = brute_neighbours(ids, x, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(want) and all(sorted(f) == list(range(1, 21)) for f in found.values())
    assert sum(len(set(want[q]) & {v for v, _ in f.values()}) for q, f in found.items()) / (20 * len(want)) >= 0.9
    for q, f in found.items():
        scores = [f[r][1] for r in range(1, 21)]
        assert scores == sorted(scores, reverse=True) and abs(f[1][1] - x[q] @ x[f[1][0]]) < 1e-12


def test_odd_vectors(frame):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (8, [1.0, 0.0, 0.0]), (0, [1.0, 0.0]), (9, [])]
    got = ann.search(frame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.search(frame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(frame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [draw.choice(words) for _ in range(draw.randrange(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["nastyword", "zorgle" + draw.choice(words), "blastard"]))
        rows.append((i, " ".join(text), "en", f"s{i % 3}"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_words_and_beginnings(frame, corpus):
    rows, labels = corpus
    docs = frame(rows + [(9000, None, None, None), (None, "nastyword blastard", "x", "y")], "doc_id long, text string, lang string, source string")
    scored = toxicity.toxicity(docs, frame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")).collect()
    truth = dict(labels)
    out = [r for r in scored if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored if r.doc_id is not None)
    assert len(out) > 100 and sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored) and len(scored) == 902
    assert next(r for r in scored if r.doc_id is None).predicted == 1 and next(r for r in scored if r.doc_id == 9000).predicted == 0


def test_held_out_labels_are_not_seen(frame, corpus):
    rows, labels = corpus
    docs = frame(rows[:300], "doc_id long, text string, lang string, source string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, frame(some, "doc_id long, toxic int")).collect()} for some in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_or_rows(frame):
    docs = frame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.toxicity(docs, frame([], "doc_id long, toxic int")).collect()] == [0, 0]
    assert toxicity.toxicity(frame([], "doc_id long, text string"), frame([], "doc_id long, toxic int")).count() == 0


def one_sided(n, share, precision, cover, seed=0):
    """Labels, and votes of voters that vote toxic or abstain, with the given precision and share of texts voted on."""
    draw = np.random.default_rng(seed)
    toxic = draw.random(n) < share
    votes = [draw.random(n) < np.where(toxic, c * p / share, c * (1 - p) / (1 - share)) for p, c in zip(precision, cover)]
    return toxic, votes, draw


def counted(votes):
    x = votes.astype(float)
    return len(votes), votes.sum(0), (x.T @ x).astype(int)


def test_label_model_finds_one_sided_precisions_and_correlations():
    precision = [0.93, 0.72, 0.47, 0.30, 0.18, 0.92]
    toxic, votes, draw = one_sided(200_000, 0.1, precision, [0.05, 0.06, 0.08, 0.1, 0.1, 0.04])
    votes.append(votes[0] & (draw.random(len(toxic)) < 0.95))  # a voter that repeats another
    votes = np.array(votes).T
    model = toxicity.LabelModel(*counted(votes), np.ones(7), 0.1)
    assert np.abs(model.precision - [*precision, 0.93]).max() < 0.05
    pairs = np.argwhere(model.correlated).tolist()
    assert pairs == [[0, 6], [6, 0]] and model.correlation[0, 6] > 0.9
    posterior = model.posterior(votes)
    for low, high in ((0, 0.05), (0.05, 0.2), (0.2, 0.5), (0.5, 0.9), (0.9, 1)):  # what it says comes true
        some = (posterior > low) & (posterior <= high)
        assert abs(posterior[some].mean() - toxic[some].mean()) < 0.05
    alone = model.posterior(np.eye(7, dtype=bool))
    assert (np.diff(alone[[4, 3, 2, 1, 0]]) > 0.02).all()  # voters differ, in the order of their precisions
    repeated, independent = model.posterior(np.array([[1, 0, 0, 0, 0, 0, 1], [1, 0, 0, 0, 0, 1, 1]]))
    assert independent > repeated + 0.1  # a repeated opinion adds little, another one much


def test_label_model_of_voters_for_both_sides():
    draw = np.random.default_rng(1)
    toxic = draw.random(200_000) < 0.3
    rates = [(0.5, 0.02), (0.4, 0.05), (0.3, 0.1), (0.1, 0.4), (0.05, 0.3)]
    votes = np.array([draw.random(len(toxic)) < np.where(toxic, a, b) for a, b in rates]).T
    model = toxicity.LabelModel(*counted(votes), np.array([1, 1, 1, -1, -1]), 0.3)
    assert np.abs(model.toxic - [a for a, _ in rates]).max() < 0.03 and np.abs(model.clean - [b for _, b in rates]).max() < 0.03


def test_label_model_without_evidence_keeps_the_prior():
    model = toxicity.LabelModel(0, np.zeros(2, int), np.zeros((2, 2), int), np.array([1, -1]), 0.2, np.array([0.9, 0.0]))
    assert np.isfinite(model.posterior(np.array([[0, 0], [1, 1]]))).all()
    few = toxicity.LabelModel(1000, np.array([10, 30]), np.array([[10, 1], [1, 30]]), np.array([1, -1]), 0.2, np.array([0.9, 0.0]))
    assert abs(few.precision[0] - 0.9) < 0.01 and few.toxic[1] == few.clean[1]
    assert toxicity.LabelModel(5, np.zeros(0, int), np.zeros((0, 0), int), np.zeros(0), 0.2).posterior(np.zeros((1, 0))).tolist() == [pytest.approx(0.2)]


def test_votes_are_counted_as_by_hand(frame, corpus):
    rows, _ = corpus
    voters = toxicity.Voters(["nastyword", "blastard", "zorg*", "zorgl*"], [0.9, 0.9, 0.8, 0.8])
    texts = [t for _, t, *_ in rows] + ["", "!!! 1234 ???", "nastyword!!!!!!!!! zorglethe"]
    n, votes, both = toxicity.count_votes(frame([(t,) for t in texts], "text string").repartition(3), voters)
    plain = []
    for t in texts:
        w = set(t.lower().split()) | {x for x in t.lower().replace("!", " ").split()}
        stems = {x[:k] for x in w for k in (4, 5) if len(x) > k}
        marks, digits = sum(c in "!?" for c in t), sum(c.isdigit() for c in t)
        plain.append(["nastyword" in w, "blastard" in w, "zorg" in stems, "zorgl" in stems, marks > 0.15 * len(t), digits > 0.15 * len(t)])
    plain = np.array(plain)
    assert n == len(texts) and votes.tolist() == plain.sum(0).tolist() and both.tolist() == (plain[:, :, None] & plain[:, None, :]).sum(0).tolist()


def test_training_follows_the_gradient():
    draw = np.random.default_rng(2)
    dense = draw.random((60, 5)) < 0.4
    target = np.clip(0.2 + 0.6 * dense[:, 0] + 0.1 * draw.random(60), 0, 1)
    sizes = dense.sum(1)
    flat = np.concatenate([np.flatnonzero(r) for r in dense])
    got = toxicity.train(flat, sizes, target, 5, passes=400)
    x = np.column_stack([dense, np.ones(60)])
    toxic = target > 0.5
    cost = np.where(toxic, toxic.sum() ** -0.5, (~toxic).sum() ** -0.5)
    cost /= cost.sum()
    w = np.zeros(6)
    for _ in range(60_000):  # plain gradient descent on the same loss
        w -= 0.5 * (x.T @ (cost * (1 / (1 + np.exp(-x @ w)) - target)) + 1e-4 * np.append(w[:-1], 0))
    assert np.abs(got - w).max() < 0.05


def test_screen_keeps_what_tells_the_classes_apart():
    n = np.array([0, 7, 20, 100, 100, 100])
    toxic = np.array([0, 7, 20, 10, 60, 100.0])
    assert toxicity.screen(n, toxic, 1000, 0.1).tolist() == [2, 4, 5]  # too rare, and no different from all, stay out
    assert toxicity.screen(n, toxic, 1000, 0.1, most=1).tolist() == [5]
    assert toxicity.screen(n, toxic, 0, 0.1).tolist() == []


def test_scores_are_those_of_the_weights(frame, corpus):
    rows, labels = corpus
    docs = frame(rows, "doc_id long, text string, lang string, source string")
    classifier, _, _ = toxicity.fit(docs, frame(labels, "doc_id long, toxic int"), trained=200)
    assert np.count_nonzero(classifier.weights) > 1
    for r in toxicity.score(docs, classifier).collect()[:100]:
        z = sum(float(classifier.weights[k]) for k in {toxicity.slot(x) for x in toxicity.features(rows[r.doc_id][1])})
        assert r.score == pytest.approx(1 / (1 + np.exp(-z - float(classifier.weights[-1]))))


def test_toxicity_of_odd_tables(frame, corpus):
    """Repeated rows, a very long text, a group of copies that is a third of all rows, columns named as the result's."""
    rows, labels = corpus
    texts = [(i, t) for i, t, *_ in rows] + [(0, rows[0][1])] * 2 + [(7000, " ".join(t for _, t, *_ in rows) * 5)]
    texts += [(8000 + i, rows[1][1]) for i in range(450)]
    docs = frame([(i, t, 0.5, True, "x") for i, t in texts], "doc_id long, text string, score double, held_out boolean, predicted string")
    got = toxicity.toxicity(docs, frame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(texts) and len({r.score for r in got if r.doc_id == 0}) == 1
    truth = dict(labels)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97
    assert {r.predicted for r in got if 8000 <= r.doc_id} == {truth[1]}
    kept = toxicity.clean(docs, frame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def brute_targets(sizes, weights, most):
    total, capped, target = sum(sizes), set(), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        target = {i: most * sizes[i] for i in capped} | {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return [target[i] for i in range(len(sizes))]
        capped |= set(over)


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 5, 3, 1], [0, 10, 0], [7], [10, 1000, 1000, 1, 1, 1]])
def test_targets(frame, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.source_targets(frame(rows, "source string, source_size long")).collect()}
    want = brute_targets(sizes, [1 + i % 3 for i in range(len(sizes))], 3)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix(frame):
    draw = random.Random(9)
    rows = [(i, "w " * draw.randrange(0, 60), None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", "x") for i in range(3000)]
    rows += [(5, "a b", "s1", "x"), (5, "a b", "s1", "x"), (None, "a\u00a0b\x1fc d", "s2", None), (7001, None, "s3", None)]
    docs = frame(rows, "doc_id long, text string, source string, COPIES string")
    got = mixing.mix(docs.repartition(5)).collect()
    assert len(got) == len(rows) and {r["size"] for r in got if r.doc_id is None} == {2}
    for source in {r.source for r in got}:
        some = [r for r in got if r.source == source]
        taken, target = sum(r["size"] * r.copies for r in some), some[0].target
        assert some[0].source_size == sum(r["size"] for r in some)
        assert abs(taken - target) <= 0.03 * target + 120 and max(r.copies for r in some) <= 3
        assert max(r.copies for r in some) - min(r.copies for r in some) <= 1
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixture(docs)
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(frame([], "doc_id long, text string, source string")).count() == 0


def brute_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    hits = [(len((h + p).encode()), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(hits)[2:] if hits else (None, "allow")))


def test_urls(frame):
    urls = [None, "", "no scheme.net/", "http://A.Example.NET/en/x?y#z", "http://example.net/en/", "http://xexample.net/en/", "https://example.com/de/1", "http://a.example.com/DE/", "http://net", "http://net/", "ftp://x.org/fr/://y.net/", "http://u.org?/fr/", "http://b.org/fr/#", "http://é.net/ü", "x://\n.net/a\nb", "http://.net/", "http://a..net/", "://net/"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)]
    got = url_filter.filter_urls(frame(rows, "page_id long, url string, host string, RULE string")).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in sorted(got)] == [brute_judge(u, url_filter.RULES) for u in urls]
    assert url_filter.filter_urls(frame([], "page_id long, url string")).count() == 0


def test_large_tables_and_colliding_digests(tmp_path, monkeypatch):
    draw = random.Random(1)
    rules = [(draw.choice(["block", "allow"]), f"h{draw.randrange(3000)}.org", "/" + "p" * draw.randrange(3)) for _ in range(5000)]
    for digest in (None, lambda s: len(s)):
        if digest:
            monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", digest)
        table = url_filter.DigestArray(f"{tmp_path}/{url_filter.write_table(rules, str(tmp_path))}")
        known = {f"{h}\n{p}".encode() for _, h, p in rules}
        probes = [f"h{i}.org\n/{'p' * (i % 4)}".encode() for i in range(0, 3500, 7 if digest else 1)]
        found = table.find(probes)
        assert [k >= 0 for k in found] == [p in known for p in probes]
        assert all(table.string(k) == p for k, p in zip(found, probes) if k >= 0)


def test_rows_leave_by_keys(frame):
    docs = frame([(1, "a", 5), (1, "a", 5), (None, "b", 6), (None, "c", 7)], "doc_id long, t string, away_doc_id int")
    got = without_rows(docs, {"doc_id": F.col("doc_id"), "t2": F.col("t")}, frame([(None, "b")], "doc_id long, t2 string"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [(1, "a", 5), (None, "c", 7)]


def test_pipeline(spark, tmp_path, frame, corpus):
    rows, labels = corpus
    long = "some long passage of perfectly clean words that goes on and on " * 12
    rows = rows[:240] + [(5000, rows[1][1], "en", "s0"), (5001, long, "en", "s1"), (5002, long + "end", "en", "s2"), (5003, None, None, None)]
    docs = frame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        seen[name] = [r.doc_id for r in at.collect()]
    assert not any(i % 6 == 0 for i in seen["toxicity"] if i < 240) and 5000 in seen["exact_dedup"] and 1 not in seen["exact_dedup"]
    assert len(seen["near_dedup"]) == len(set(seen["near_dedup"])) <= len(seen["exact_dedup"])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(seen["mixing"])
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
