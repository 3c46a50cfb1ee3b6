import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from babelscore.llm import common, jaccard_join, substring_dedup
from tests.llm.helpers import edge_rows, empty, frame, random_text, words_of


def plain_removed(rows, window=20):
    """Earliest place of every window by (id, start); later places' words go."""
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    texts = [(i, words_of(t)) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            at = (key(i), s)
            seq = tuple(w[s:s + window])
            first[seq] = min(first.get(seq, at), at)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (key(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substrings_equal_plain_search(spark):
    rows = edge_rows()
    got = substring_dedup.removed_words(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_removed([(r[0], r[1]) for r in rows])
    assert substring_dedup.removed_words(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("held,batch", [(1, 3), (40, 7), (1 << 19, 1000)])
def test_runs_in_small_pieces(seed, held, batch, monkeypatch):
    """The counting of edges without Spark: tasks of two documents, four partitions, tiny batches."""
    sd = substring_dedup
    monkeypatch.setattr(sd, "HELD", held)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3 if seed % 2 else 12)]
    passages = [random_text(rng, vocab, rng.randint(20, 60)) for _ in range(3)]
    docs = [" ".join(random_text(rng, vocab, rng.randint(0, 25)) + " " + rng.choice(passages) for _ in range(rng.randint(0, 3)))
            + " u%d" % i for i in range(14)]

    def rows_of(batches):
        return [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]

    def resolved(batches):
        parts = defaultdict(list)
        for r in rows_of(batches):
            a, hn, d, _, start, _, kind = r[:7]
            to = (hash((a, hn)) if kind in (sd.BRANCHES, sd.BRANCHES + sd.AGAIN, sd.ELEMENT) else hash((d, start)) if kind == sd.REPEATED
                  else hash(a))
            parts[to % 4].append(r)
        for p in parts.values():
            p.sort(key=lambda r: (*r[:3], r[4], r[3]))
            yield from rows_of(sd.resolve([sd.batch_of(zip(*p[i:i + batch])) for i in range(0, len(p), batch)]))

    def combined(found):
        for start in range(0, len(docs), 2):
            c = sd.Combiner()
            for d in range(start, min(start + 2, len(docs))):
                rows = found(d)
                if rows is not None:
                    yield from c.add(*rows)
            yield from c.rest()

    def run_rows(d):
        got = sd.runs_of_text(common.Texts(pa.array([docs[d]])), 20, 6)
        if got is None:
            return None
        key, text, _, s, n = got
        return key, text, np.full(len(s), d), np.full(len(s), 7 * d), s, n

    first = list(resolved(combined(run_rows)))

    def window_rows(d):
        at = np.array([s + k for _, _, doc, _, s, n, kind, _, _ in first if kind == sd.CHECK and doc == d for k in range(n)], dtype=np.int64)
        if not len(at):
            return None
        t = common.Texts(pa.array([docs[d]]))
        view = np.lib.stride_tricks.sliding_window_view(t.hashes(*t.words()[:2]), 20)[at]
        one, two = (sd.sequence_hash(view, m).view(np.int64) for m in (3**30, 5**20))
        return one, two, np.full(len(at), d), np.full(len(at), 7 * d), at, np.ones(len(at), dtype=np.int64)

    second = list(resolved(combined(window_rows)))
    gone, seen = defaultdict(set), {r[:2] for r in first + second if r[6] == sd.FIRST}
    for a, hn, d, tie, s, n, kind, _, _ in first + second:
        if kind == sd.REPEATED:
            assert tie == 7 * d and (a, hn) in seen  # every repeated element has a source
            gone[d].update(range(s, s + n + 19))
    got = [(d, len(w := words_of(t)), len(gone[d]), " ".join(x for k, x in enumerate(w) if k not in gone[d])) for d, t in enumerate(docs)]
    assert sorted(got, key=repr) == plain_removed(list(enumerate(docs)))


def test_paths_are_maximal_and_ranked(spark):
    """Chains, a branching node, a circle and a self loop: heads and offsets by hand."""
    edges = [(0, 1, 2, 3), (1, 2, 3, 5), (2, 3, 4, 1), (3, 4, 5, 2),  # 0-1-2-3: one path, but node 4 branches
             (4, 4, 6, 7), (5, 6, 7, 1), (6, 7, 8, 1),  # out of node 4
             (7, 20, 21, 4), (8, 21, 20, 4),  # a circle
             (9, 30, 30, 2), (10, 40, 41, 9)]  # a self loop, an element alone
    edges += [(100 + i, 1000 + i, 1001 + i, 2) for i in range(300)]  # a long chain
    rows = spark.createDataFrame([(i, u, v, n) for i, u, v, n in edges], "id long, u long, v long, n int")
    got = {r["id"]: (r["path"], r["offset"]) for r in substring_dedup.ranked(substring_dedup.linked(rows), "test-ranks").collect()}
    want = {0: (0, 0), 1: (0, 3), 2: (0, 8), 4: (4, 0), 5: (4, 7), 6: (4, 8)} | {100 + i: (100, 2 * i) for i in range(300)}
    assert got == want


def test_occurrences_in_step_merge():
    none = np.zeros(0, dtype=np.int64)
    assert [x.tolist() for x in substring_dedup.in_step(*[none] * 5)] == [[]] * 5
    rows = [(0, 5, 3, 1, 0), (0, 8, 2, 1, 3), (0, 12, 1, 1, 7), (0, 8, 2, 2, 0), (1, 10, 4, 1, 5), (1, 12, 1, 1, 7), (1, 14, 2, 1, 9)]
    got = substring_dedup.in_step(*(np.array(c, dtype=np.int64) for c in zip(*rows)))
    assert sorted(zip(*(x.tolist() for x in got))) == [(0, 5, 5, 1, 0), (0, 8, 2, 2, 0), (0, 12, 1, 1, 7), (1, 10, 6, 1, 5)]


def test_long_spans(spark):
    """A passage that two other documents hold comes out as one span each, on one path."""
    rng = random.Random(3)
    words = [f"x{i}" for i in range(5000)]
    passage = " ".join(rng.choices(words, k=400))
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(6)]
    rows = [(1, texts[0] + " " + passage), (2, texts[1] + " " + passage + " " + texts[2]), (3, passage + " " + texts[3]),
            (4, texts[4] + " " + texts[5]), (None, None), (7, "")]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sorted(got) == [2, 3]
    assert [(got[d]["start"], got[d]["n_words"]) for d in (2, 3)] == [(50, 400), (0, 400)]
    assert got[2]["path"] == got[3]["path"] and got[2]["offset"] == got[3]["offset"]


def test_texts_of_one_id_whose_short_hashes_collide(spark):
    """Texts that share 32 bits of their hash, under the null id and under one id, stay apart."""
    long = " ".join(f"r{i}" for i in range(30))
    pool = spark.range(600_000).selectExpr(f"if(id % 2 = 0, concat('{long} ', id), concat('short ', id)) AS t")
    low = pool.selectExpr("t", "xxhash64(t) & 4294967295 AS low").groupBy("low").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    twins = low.filter("substr(a, 1, 2) != substr(b, 1, 2)").select("a", "b").first()
    rows = [(i, t) for i in (None, 5) for t in (*twins, long, "start " + long)] + [(6, long)]
    got = substring_dedup.removed_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_removed(rows)


def plain_groups(rows):
    def shingles(t):
        w = words_of(t)
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
             for i in range(len(rows))]
    key = lambda i: -(1 << 63) if i is None else i
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], min((rows[j][0] for j in seen), key=key), len(links[i])))
    return sorted(out, key=repr)


def test_a_family_of_near_copies_moves_in_proportion_to_its_size(spark, monkeypatch):
    """Rows that meet in blocks, for families of 300 and 1,200 documents of one text with a word changed;
    a few others of the family are far from its centre. All links are counted."""
    moved = []
    together = jaccard_join.together

    def counted(df):
        moved.append(df.count())
        return together(df)
    monkeypatch.setattr(jaccard_join, "together", counted)
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = {}
    for n in (300, 1200):
        texts = [" ".join(base[:k % 140] + [f"new{k}"] + base[k % 140 + 1:]) for k in range(n)]
        texts += [" ".join(base[:cut]) for cut in (146, 140, 132, 126)]  # ever shorter versions
        moved.clear()
        got = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=32).collect()
        rows[n] = sum(moved)
        if n == 300:
            assert sorted(map(tuple, got)) == sorted(plain_groups(list(enumerate(texts))))
        else:
            assert {r["class_id"] for r in got} == {0} and all(r["n_links"] >= n - 1 for r in got if r["doc_id"] < n)
    assert rows[1200] < 6 * rows[300] + 100  # blocks of 32 alone: 16 times


@pytest.mark.parametrize("block", [3, 512])
def test_groups_equal_all_pairs(spark, block):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(200)]
    rows = [(r[0], r[1]) for r in edge_rows()]
    for family in range(4):
        base = words_of(random_text(rng, vocab, rng.randint(20, 80)))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((100 + len(rows), " ".join(w)))
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = jaccard_join.near_duplicates(docs, block=block).collect()
    expected = plain_groups(rows)
    assert sorted(map(tuple, got), key=repr) == expected
    if block == 512:
        kept = jaccard_join.representatives(docs)
        assert kept.columns == docs.columns
        ids = sorted((r["doc_id"] for r in kept.filter("trim(replace(text, '\n', '')) != ''").collect()), key=repr)
        smallest = {(c, i) for i, c, _ in expected if i == c}
        assert set(ids) >= {i for _, i in smallest if i not in (1, 2, 3, None)}
        assert len([i for i in ids if i is not None and i >= 100]) == len({c for i, c, _ in expected if i is not None and i >= 100})


def test_groups_of_nothing(spark):
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    assert jaccard_join.representatives(empty(spark)).count() == 0


def test_least_matches_follow_the_posterior():
    least = jaccard_join.least_matches()
    assert least == sorted(least) and least[-1] < 0.8 * jaccard_join.HASHES
    # With a looser tolerance more pairs go.
    assert all(a >= b for a, b in zip(jaccard_join.least_matches(1e-2), least))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    edges = spark.createDataFrame(chain, "u long, v long")
    got = {r["node"]: r["root"] for r in common.components(edges, "test").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def plain_labels(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_labels_join_all_that_pairs_connect():
    rng = random.Random(9)
    cases = [(4, [(0, 2), (1, 3), (2, 3)]), (4, [(2, 3), (1, 3)])]
    order = list(range(300))
    rng.shuffle(order)
    cases.append((300, list(zip(order, order[1:]))))  # a chain
    cases.append((41, [(i + s, j + s) for s in (0, 20) for i in range(20) for j in range(i)] + [(19, 40), (40, 25)]))  # bridged cliques
    cases += [(60, [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 70))]) for _ in range(200)]
    for n, pairs in cases:
        for size in (1, 7, len(pairs)):  # calls on one label array
            label = np.arange(n)
            for i in range(0, len(pairs), size):
                jaccard_join.join_labels(label, *np.array(pairs[i:i + size]).T)
            assert label.tolist() == plain_labels(n, pairs)
