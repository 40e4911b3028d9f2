"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline

from gridlake.llm import near_dedup, simhash


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_similar(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stage_keeps_no_two_similar_texts(spark, frame):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(draw.choice(words) for _ in range(12))
    texts = [None, " \n", "one", "ONE", "a b c d", "a b c d e", "a b c d f"]
    for _ in range(40):
        base = [draw.choice(words) for _ in range(draw.choice([8, 30, 60, 150, 400]))] + line.split()
        texts.append(" ".join(base))
        for _ in range(draw.randrange(4)):
            edited = list(base)
            for _ in range(draw.randrange(1, 2 + len(base) // 25)):
                edited[draw.randrange(len(edited))] = draw.choice(words)
            texts.append(" ".join(edited))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    draw.shuffle(rows)
    stays = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, frame(rows, "doc_id long, text string, source string").repartition(3), "").collect()}
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if brute_similar(texts[i], texts[j])]
    assert len(pairs) > 20
    assert not [p for p in pairs if p[0] in stays and p[1] in stays]
    assert set(range(len(texts))) - set(stays) <= {j for _, j in pairs}


def test_groups_of_copies_null_ids_and_empty_tables(frame):
    base = [f"x{i}" for i in range(100)]
    rows = [(i if i else None, " ".join(base[:i] + ["#"] + base[i + 1 :])) for i in range(60)]
    got = near_dedup.dedup(frame(rows + rows[:3] + [(None, "else"), (7, "other")], "doc_id long, text string")).collect()
    kept = sorted((r.text for r in got if len(r.text) > 9), key=len)
    assert len(kept) < 60 and not any(brute_similar(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert (1, rows[1][1]) in [(r.doc_id, r.text) for r in got] and {"else", "other"} <= {r.text for r in got}
    assert near_dedup.dedup(frame([], "doc_id long, text string")).count() == 0


def test_sketches_lose_no_similar_pair():
    draw = random.Random(5)
    for n in (1, 4, 9, 40, 300, 2000):
        for _ in range(20):
            a = [f"w{draw.randrange(10**6)}" for _ in range(n + 4)]
            b = [w if draw.random() > draw.choice([0, 0.01, 0.03]) else "new" for w in a][draw.randrange(3) :]
            x, y = near_dedup.shingles(" ".join(a)), near_dedup.shingles(" ".join(b))
            apart = int(sum(int(v).bit_count() for v in (near_dedup.sketch(x) ^ near_dedup.sketch(y)).view("uint64")))
            assert apart <= len(set(x.tolist()) ^ set(y.tolist()))
            assert not near_dedup.similar(x, y) or 9 * apart <= len(x) + len(y)


def test_loose_groups_make_few_candidates(frame, monkeypatch):
    draw, found, plain = random.Random(3), [], near_dedup._similar_pairs
    base = [f"x{i}" for i in range(150)]
    texts = [" ".join(f"y{draw.random()}" if draw.random() < 0.05 else w for w in base) for _ in range(150)]
    monkeypatch.setattr(near_dedup, "_similar_pairs", lambda near, keyed: (found.append(near.count()), plain(near, keyed))[1])
    stays = near_dedup.dedup(frame(list(enumerate(texts)), "doc_id long, text string")).collect()
    pairs = [(i, j) for j in range(150) for i in range(j) if brute_similar(texts[i], texts[j])]
    kept = {r.doc_id for r in stays}
    assert not [p for p in pairs if kept.issuperset(p)] and set(range(150)) - kept <= {j for _, j in pairs}
    assert found[-1] < 3 * len(pairs) + 150  # of 11,175 pairs


def test_stage_links_by_ball_hashing_and_verifies(spark, frame, monkeypatch):
    linked, plain = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: (linked.append(plain(docs)), linked[-1])[1])
    long = [f"x{i}" for i in range(3000)]
    rows = [(5, " ".join(long)), (2, " ".join(long[:-1] + ["end"])), (None, " ".join(long)), (8, "a b a b"), (9, "b a b")]
    # one line often, so that few bits differ, but different texts otherwise
    rows += [(10 + i, "the same line over and over again " * 400 + " ".join(f"z{i * 1000 + j}" for j in range(8))) for i in range(2)]
    stays = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(rows, "doc_id long, text string"), "").collect()}
    assert stays == {2, 8, 9, 10, 11}
    named = {r.doc_id: r.component_id for r in linked[0].collect()}
    assert named[5] == named[None] == 2 and named[11] == named[10] == 10


def test_sketches_part_loose_texts():
    draw = random.Random(3)
    texts = [" ".join(f"y{draw.random()}" if draw.random() < 0.05 else f"x{i}" for i in range(150)) for _ in range(60)]
    found = [near_dedup.shingles(t) for t in texts]
    apart = lambda x, y: sum(int(v).bit_count() for v in (near_dedup.sketch(x) ^ near_dedup.sketch(y)).view("uint64"))
    far = [(x, y) for j, x in enumerate(found) for y in found[:j] if not near_dedup.similar(x, y)]
    left = [(x, y) for x, y in far if 9 * apart(x, y) <= len(x) + len(y)]
    assert len(far) > 1000 and len(left) < len(far) // 20
