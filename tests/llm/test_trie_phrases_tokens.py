"""The conversation trie, phrase collocations and token files against plain versions and awkward inputs."""
import glob
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from babelscore.llm import collocations, conversation_trie, scans, token_files
from babelscore.session import scratch_path
from tests.llm.helpers import edge_rows, empty, frame

TURNS = "conv_id long, turn long, role string, text string"


# -- conversation trie -------------------------------------------------------------------------

def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, t = role or "", text or ""
            order = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), order, (r, t)))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        base = c - int(np.fmod(c, 100))
        head = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 6
        built[c] = tuple(own.get(base, [])[:head] + turns[head:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    leaves = {n for n, m in members.items() if all(len(built[c]) == len(n) for c in m)}
    out = []
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children), sum(x in leaves for x in below),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([0, 1, 2, 100, 101, -100, -5, 250, 200]) + rng.randint(0, 12)
        size = rng.choice([1, 1, 2, 3, 6, 9])
        rows += [(conv, rng.choice([k, k, k, None]), rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "yo ü", "", None])) for k in range(size)]
    rows += [(None, 0, "user", "hi"), (None, None, None, None), (7, 3, "a", "b"), (7, 3, "a", "b"), (7, 3, "ab", "")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_plain_one(spark, seed, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS", 3)
    rows = talk(seed)
    random.Random(seed).shuffle(rows)
    got = conversation_trie.trie(frame(spark, rows, TURNS)).drop("k1", "k2").collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    """A third of all turns in one conversation, a third of all conversations equal, in many ranges."""
    rows = [(100, k, "user", f"turn {k % 7}") for k in range(900)]
    rows += [(1000 + i, 0, "user", "same") for i in range(300)] + [(1000 + i, 1, "bot", "same too") for i in range(300)]
    rows += [(2000 + i, k, "user", f"{i % 50}") for i in range(150) for k in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversation_trie.trie(spark.createDataFrame(rows, TURNS).repartition(5)).drop("k1", "k2").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_colliding_fingerprints_are_found_and_another_seed_is_taken(spark, monkeypatch):
    """With a tiny modulus everything collides; with the second seed's bases nothing does."""
    true, seeds = conversation_trie.prefixes, []

    def weak(slim, seed):
        seeds.append(seed)
        found, bases = true(slim, seed)
        return (found.select(*[(F.col(c) % 2).alias(c) if c[:2] in ("f0", "f1", "f2") else c for c in found.columns]) if seed == 0 else found), bases
    monkeypatch.setattr(conversation_trie, "prefixes", weak)
    rows = talk(5)
    got = conversation_trie.trie(spark.createDataFrame(rows, TURNS)).drop("k1", "k2").collect()
    assert seeds == [0, 1] and sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.trie(empty(spark, TURNS)).count() == 0
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


def test_stored_turns_hold_each_text_once(spark):
    rows = conversation_trie.turn_rows(spark.createDataFrame(talk(1), TURNS), "conv_id", "turn", "role", "text")
    got = conversation_trie.stored_turns(rows).collect()
    want = Counter((r or "", t or "") for c, _, r, t in talk(1) if c is not None)
    assert {(r["role"], r["text"]): r["n"] for r in got} == dict(want) and all(r["one_text"] for r in got)


@pytest.mark.parametrize("batch", [1, 4, 1000])
def test_scans_compose(batch):
    """Totals over batches are those of one pass, and fingerprints compose as a monoid."""
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 5, 60))
    plain, hashed, base = rng.integers(0, 50, 60), rng.integers(0, scans.PRIME, 60), 48_271
    state, places, sums, prints = None, [], [], []
    for i in range(0, 60, batch):
        place, before, upto, state = scans.scan_batch(group[i:i + batch], [plain[i:i + batch], hashed[i:i + batch]], [None, base], state)
        places += place.tolist()
        sums += upto[0].tolist()
        prints += upto[1].tolist()
        assert (upto[0] - before[0] == plain[i:i + batch]).all()
    for i, g in enumerate(group):
        of = np.flatnonzero(group[:i + 1] == g)
        assert places[i] == len(of) and sums[i] == plain[of].sum()
        assert prints[i] == sum(int(v) * pow(base, k + 1, scans.PRIME) for k, v in enumerate(hashed[of])) % scans.PRIME
    assert scans.powers(base, np.array([0, 1, 65_535, 65_536, 10**7])).tolist() == [pow(base, k, scans.PRIME) for k in (0, 1, 65_535, 65_536, 10**7)]


# -- collocations ------------------------------------------------------------------------------

def plain_phrases(rows, least, longest=5, top=2000):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    often = {k: a for k, a in f.items() if a >= least}
    out = []
    for lang in total:
        mine = {p: a for (x, p), a in often.items() if x == lang}
        found = []
        for p, a in mine.items():
            if len(p) < 2:
                continue
            inside = [b for q, b in mine.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 100 * a for b in inside):
                continue
            score, k = min((1000 * a * total[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, mine[p[:k]], mine[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, total[lang], -s))
    return sorted(out)


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b-c", "é", "naïve", "x#y", "日本"] + [f"w{i}" for i in range(12)]
    fixed = ["new york city", "a b c d e f", "of the of the", "straße für alle"]
    rows = []
    for i in range(n):
        text = "".join((rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words)) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "\r"])
                       for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("fr", "only once"), ("en", "..,,\n"), ("de", "x" * 3000)] + [("en", "again and again")] * 9


@pytest.mark.parametrize("seed,least,shard", [(0, 3, 1 << 20), (1, 6, 7), (2, 2, 50)])
def test_phrases_equal_plain_search(spark, seed, least, shard, monkeypatch):
    """Whole results, also with tries of a few phrases (many scans) and tasks that flush all the time."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    rows = phrase_rows(seed)
    docs = frame(spark, [(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)]).repartition(3)
    got = collocations.mine(docs, least=least, top=25).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, least, top=25)


def test_phrase_tables_are_a_file_for_each_core(spark, monkeypatch):
    """However many partitions the shuffles have, what they leave does not start a process for a file of each."""
    files, whole, rng = [], collocations.materialise, random.Random(3)

    def counted(df, name):
        out = whole(df, name)
        files.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(collocations, "materialise", counted)
    docs = [(k, " ".join(rng.choices([f"w{i}" for i in range(60)], k=200)), "en") for k in range(60)]
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = collocations.mine(spark.createDataFrame(docs, "doc_id long, text string, lang string"), least=3).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found and len(files) > 6 and max(files) <= spark.sparkContext.defaultParallelism  # 40 before


def test_no_phrases(spark):
    assert collocations.mine(empty(spark)).count() == 0
    assert collocations.mine(frame(spark, edge_rows()[:5])).count() == 0


@pytest.mark.parametrize("size", [2, 3, 5])
def test_double_array_counts_as_a_dictionary(size):
    rng = np.random.default_rng(size)
    names = rng.integers(1, 2**63, 60, dtype=np.uint64)
    phrases = np.unique(names[rng.zipf(1.4, (4000, size)).clip(1, 60) - 1], axis=0)
    trie = collocations.DoubleArray(phrases)
    assert len(set(trie.slot.tolist())) == len(phrases) and len(trie.base) < 4 * (len(phrases) + 200) * size

    class Text:
        h = names[rng.zipf(1.4, 3000).clip(1, 60) - 1]
        piece = np.sort(rng.integers(0, 300, 3000))

        def within(self, n):
            return self.piece[:len(self.h) - n + 1] == self.piece[n - 1:]
    text = Text()
    want = Counter(tuple(text.h[i:i + size].tolist()) for i in np.flatnonzero(text.within(size)))
    got = trie.counts(text)[trie.slot]
    assert got.tolist() == [want[tuple(p.tolist())] for p in phrases] and got.sum() > 100


def test_words_that_share_a_hash_are_counted_again_by_another(spark, monkeypatch):
    true, seeds = collocations.vocabulary, []

    def clashing(docs, seed):
        seeds.append(seed)
        found = true(docs, seed)
        return found if seed else found.withColumn("h", F.col("h") % 5)
    monkeypatch.setattr(collocations, "vocabulary", clashing)
    rows = phrase_rows(4, 30)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.mine(docs, least=3).collect())) == plain_phrases(rows, 3)
    assert seeds == [0, 1]


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 9 * 10**15 + 1, 3 * 10**12 + 11, 10**12 + 9), (100, 10**16, 100, 100), (3, 7, 1, 2)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.exact_score("a", "n", "l", "r")).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]


# -- token files -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    t.encode_special_tokens = True
    return t


def test_units_encode_as_whole_texts(tokenizer):
    rng = random.Random(1)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", " ", "　", " ", "\x85", "\x1c", ".", ",", "'s", "'", "1", "23", "日", "😀", "<|endoftext|>",
             "*", "#", "…", "—", "\r\n", "​", "word", "it's", "don't", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [None, "", " ", "x" * 9000]
    encoder = token_files.Encoder(token_files.tokenizer_json())
    for shrink in (False, True):
        ids, off = encoder.encode(pa.array(texts, pa.string()), 0)
        assert all(ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t, a, b in zip(texts, off, off[1:]))
        encoder.shrink()
    assert encoder.encode(pa.array([], pa.string()), 0)[1].tolist() == [0]


def test_new_units_encode_together(tokenizer, monkeypatch):
    """Units that come apart by the tokeniser's rules are encoded many at a time, each with its own ids; others, and all
    if that fails or the tokeniser is not byte-level, one by one."""
    rng = random.Random(7)
    ends = ["a", "Z", "\u00e9", "1", ".", "'s", ")", "\u3000", "\xa0", "\x85", "\x1c", " ", "\n", "<|endoftext|>", "\U0001f600", "'", "ll"]
    units = list(dict.fromkeys("".join(rng.choice(ends + [" ", "\n"]) for _ in range(rng.randint(1, 6))) for _ in range(6000)))
    texts = units + ["".join(f"{rng.choice(' \n')}{x}" for x in rng.choices(units, k=20)) for _ in range(300)]
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    calls, spec = [], token_files.tokenizer_json()

    def plain(x):
        ids, off = x.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip(off, off[1:])]

    for case in ("together", "apart", "other"):
        encoder = token_files.Encoder(spec)
        if case == "together":
            single = encoder.single_ids
            monkeypatch.setattr(encoder, "single_ids", lambda some: calls.append(len(some)) or single(some))
            assert plain(encoder) == want and 0 < sum(calls) < 0.8 * len(encoder.index)
            encoder.shrink()
            assert plain(encoder) == want
        elif case == "apart":
            monkeypatch.setattr(encoder, "joined_ids", lambda some: None)
            assert plain(encoder) == want
        else:
            encoder.id_bytes = encoder.id_bytes[:0]
            assert plain(encoder) == want
    encoder = token_files.Encoder(spec)
    assert encoder.joined_ids([" a", "b"]) is None and encoder.joined_ids([" a", " b"])[1].tolist() == [1, 1]


def test_units_are_looked_up_once_in_a_slice_of_some_megabytes(spark, tokenizer, monkeypatch, tmp_path):
    """Each slice cuts, deals and looks up its own units, so many small ones repeat that work."""
    texts = ["some words of text " * 1000 + str(k) for k in range(100)]  # 1.9 MB
    calls, whole = [], token_files.split_batch
    monkeypatch.setattr(token_files, "split_batch", lambda batch, text, *limit: calls.append(
        [p.num_rows for p in whole(batch, text, *limit)]) or whole(batch, text, *limit))
    run = []
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, fn, schema: run.append(fn) or self.sparkSession.createDataFrame([], schema))
    token_files.write(frame, str(tmp_path / "files"))
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([0] * 100), pa.array(texts), pa.array([{"none": None}] * 100)],
                                       ["doc_id", "tie", "text", "meta"])
    out = pa.Table.from_batches(list(run[0]([batch])))
    assert calls == [[100]]  # two slices before
    assert out["ids"].to_pylist() == [[*tokenizer.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def test_new_units_keep_their_numbers(tokenizer):
    """Units that are encoded together and alone, mixed, get their own numbers."""
    encoder = token_files.Encoder(token_files.tokenizer_json())
    units = [b" a", b"b", b" \xc3\xa9", b"\nc", b"  ", b" d\xc2\xa0", b" e"]
    found = encoder.learn(units)
    assert found.tolist() == [encoder.index[u] for u in units] and sorted(found) == list(range(len(units)))
    for u, k in zip(units, found):
        ids = encoder.store[encoder.start[k]:encoder.start[k] + encoder.size[k]]
        assert ids.tolist() == tokenizer.encode(u.decode(), add_special_tokens=False).ids


def test_token_files_in_document_order(spark, tokenizer):
    rows = edge_rows()
    docs = frame(spark, rows).select("*", F.lit(1).alias("my col"))
    path = scratch_path(spark, "test-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(docs, path, metadata=("lang", "my col"), page_rows=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(token_files.read(spark, path, ("doc_id", "start", "n_tokens", "ids", "meta")).collect(), key=lambda r: r["start"])
    key = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert key == sorted(key) and len(got) == len(rows)
    start = 0
    for r in got:
        assert r["start"] == start and len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 and r["meta"]["my col"] == 1
        start += r["n_tokens"]
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    sums = {r["start"]: r["ids_crc32"] for r in token_files.with_checksum(token_files.read(spark, path)).collect()}
    assert sums == {r["start"]: zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) for r in got}
    assert len(spark.read.parquet(f"{path}/parts").collect()) > 1  # several ranges, numbered through


def test_token_files_read_in_parts(spark):
    """A range of ids reaches the scan as a filter, metadata reads leave the ids out, and the files have
    small pages, page indexes and the wanted encodings."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.concat_ws(" ", F.lit("text of"), "id"), 50).alias("text"), F.lit("en").alias("lang"))
    path = scratch_path(spark, "test-token-parts")
    token_files.write(docs, path, metadata=("lang",), row_group_bytes=16 << 10, page_rows=100)
    some = token_files.read(spark, path, ("doc_id", "n_tokens", "start"), 500, 520)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(500, 521))
    plan = some._jdf.queryExecution().toString()
    assert "ids" not in plan.split("== Physical Plan ==")[1] and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(doc_id,500\)", plan)
    file = pq.ParquetFile(sorted(glob.glob(f"{path.removeprefix('file:')}/tokens/*.parquet"))[0]).metadata
    assert file.num_row_groups > 1
    columns = {file.row_group(0).column(c).path_in_schema: file.row_group(0).column(c) for c in range(file.num_columns)}
    assert columns["doc_id"].encodings == ("DELTA_BINARY_PACKED",) and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_token_files_of_nothing(spark):
    path = scratch_path(spark, "test-no-tokens")
    token_files.write(empty(spark), path)
    assert token_files.with_checksum(token_files.read(spark, path)).count() == 0
