"""Each operator against brute force, an exact round trip or held-out accuracy, on small tables with odd rows."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from folioflow.llm import ann, bpe, curriculum, hmm, hostrules, langid, minhash, ordinal, tokenstore, toxicity  # noqa: E402
from folioflow.llm.common import Workspace, bounded_sample, held_out  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, size long"
WORDS = {"en": "the of and tion ing ther with this that have from".split(), "de": "der und die ung keit schen eine nicht über für".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def corpus(seed=0, n=120):
    """Documents with nulls, empty and long texts, copies, near copies, and a column whose name clashes."""
    rng = random.Random(seed)
    rows = [(1, None, "en", None, 5), (2, "", "en", "a", None), (3, " \n\t ", None, "a", 1), (4, "x", "de", "b", 1)]
    rows.append((5, "lang " * 9000 + "tail", "en", "b", 0))
    for i in range(6, n):
        lang = rng.choice(["en", "de"])
        text = prose(rng, lang, rng.randint(30, 200))
        if i % 5 == 0 and len(rows) > 8:
            _, text, lang, *_ = rows[rng.randrange(6, len(rows))]
            words = text.split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i, text, lang, rng.choice(["a", "a", "b", "c"]), i))
    return rows + [rows[10]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- near duplicates ---------------------------------------------------------


def brute_groups(rows, plan):
    sets = {}
    for i, text, *_ in rows:
        sets.setdefault(i, []).append(set(minhash.shingles(text, plan.width).tolist()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= plan.percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("plan", [minhash.Plan(3, 85), minhash.Plan(5, 80)])
def test_near_groups_equal_brute_force(spark, docs, plan):
    want = brute_groups(corpus(), plan)
    got = minhash.near_groups(docs, Workspace(spark, "t"), plan).collect()
    assert len(got) == len(corpus())
    assert {r.id: r.component_id for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)
    assert {r.id: r.n_shingles for r in got}[1] == 0 and len(set(want.values())) < len(want)


def test_near_groups_link_through_a_hub_and_across_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(200), rng.choice([2, 8, 14, 20])):
            words[k] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None, 0))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 5)
    plan = minhash.Plan(3, 85)
    got = minhash.near_groups(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "t"), plan).collect()
    assert {r.id: r.component_id for r in got} == brute_groups(rows, plan)


def test_near_copies_are_compared_with_one_centre(spark, monkeypatch):
    rng, asked, confirm = random.Random(3), [], minhash.confirm
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(3):
            words[rng.randrange(300)] = f"own{i}x{j}"
        rows.append((i, " ".join(words), None, None, 0))

    def counted(pairs, texts, plan):
        asked.append(pairs.count())
        return confirm(pairs, texts, plan)

    monkeypatch.setattr(minhash, "confirm", counted)
    got = minhash.near_groups(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "t"), minhash.Plan(3, 85)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 60
    assert sum(asked) < 3 * len(rows)  # a pair for each node and smallest node of a bucket: 275 of them


def test_components_go_on_with_open_edges_only(spark, monkeypatch):
    """Stars, a path in order of ids, a path in any order and random edges: the smallest ids, and edges that are done aren't read again."""
    rng, saved = random.Random(5), []
    order = rng.sample(range(300, 400), 100)
    edges = [(7, i) for i in range(8, 60)] + [(99, i) for i in range(60, 99)] + [(i, i + 1) for i in range(100, 160)]
    edges += [*zip(order, order[1:]), *((rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(50)), (8, 7)]
    edges = [(a, c) for a, c in edges if a != c]
    forest = minhash.Forest()
    for a, c in edges:
        forest.join(a, c)
    ws = Workspace(spark, "t")
    save = ws.save
    monkeypatch.setattr(ws, "save", lambda df, name: (out := save(df, name), saved.append(out.count()) if name == "edges" else None)[0])
    got = minhash.components(ws, spark.createDataFrame(edges, "a long, c long").repartition(3)).collect()
    assert sorted((r.id, r.comp) for r in got) == sorted((x, forest.find(x)) for x in {v for e in edges for v in e})
    assert saved[0] == len({(min(e), max(e)) for e in edges}) and saved[-1] == 0 and all(a > b for a, b in zip(saved, saved[1:])) and sum(saved) < 3 * saved[0]


def test_near_groups_of_ids_that_repeat(spark):
    """Rows of one id are one document: (1, A), (5, A), (2, B), (5, B) are all component 1."""
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black")
    rows = [(1, a), (5, a), (2, b), (5, b), (9, c), (7, ""), (7, c), (3, None), (None, b), (None, "no one has this text at all"), (None, "")]
    rows += [(1, a)] * 60 + [(40, a.replace("beta", "Beta"))] * 200
    plan = minhash.Plan(3, 85)
    source = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = minhash.near_groups(source, Workspace(spark, "t"), plan).collect()
    assert len(got) == len(rows)
    told = {}
    for r in got:
        told.setdefault(r.id, set()).add(r.component_id)
    assert told == {1: {1}, 5: {1}, 2: {1}, 40: {1}, 9: {7}, 7: {7}, 3: {3}, None: {1, None}}
    assert brute_groups([r for r in rows if r[0] is not None], plan) == {i: min(c) for i, c in told.items() if i is not None}
    left = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in minhash.without_copies(source, Workspace(spark, "t"), plan).collect())
    assert left == [(-1, ""), (-1, "no one has this text at all"), (1, a), (3, ""), (7, c)]


def test_copies_that_stay_equal_brute_force(spark, docs):
    plan = minhash.Plan(5, 80)
    clash = docs.withColumn("id", F.lit("x")).withColumn("row", F.lit(1)).withColumn("node", F.lit(2))
    got = minhash.without_copies(clash, Workspace(spark, "t"), plan)
    assert got.columns == clash.columns
    want = brute_groups(corpus(), plan)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, g in want.items() if i == g)


def test_lanes_that_differ_are_the_same_in_both_forms(spark):
    rng = np.random.default_rng(4)
    words = rng.integers(-(1 << 63), (1 << 63) - 1, (50, 2, 9), dtype=np.int64)
    words[:25, 1, :5] = words[:25, 0, :5]
    rows = spark.createDataFrame([(i, w[0].tolist(), w[1].tolist()) for i, w in enumerate(words)], "i int, a array<long>, c array<long>")
    got = {r.i: r.n for r in rows.select("i", minhash.lanes_apart("a", "c", 9).alias("n")).collect()}
    for i, (a, c) in enumerate(words.view(np.uint64)):
        plain = sum((int(x) >> k & 15) != (int(y) >> k & 15) for x, y in zip(a, c) for k in range(0, 64, 4))
        assert got[i] == plain == int(minhash.differing(a, c[None, :])[0])


def test_lanes_of_linked_pairs_are_within_the_bound():
    plan = minhash.Plan(3, 85)
    q, n = 0.15 * 15 / 16, plan.hashes
    tail = [sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(least, n + 1)) for least in (plan.most_differ, plan.most_differ + 1)]
    assert tail[1] <= minhash.MISSED < tail[0]


def test_near_groups_of_nothing(spark, empty):
    assert minhash.near_groups(empty, Workspace(spark, "t")).count() == 0


def test_shingles_of_short_texts_and_case():
    assert len(minhash.shingles("a b", 3)) == 1 and len(minhash.shingles(None, 3)) == 0
    assert (minhash.shingles("A b\x0bC d", 3) == minhash.shingles("a B c D", 3)).all()
    assert not (minhash.shingles("É b c", 3) == minhash.shingles("é b c", 3)).all()


def test_signature_estimates_are_close():
    plan, rng = minhash.Plan(3, 85), np.random.default_rng(0)
    h = minhash.Hashes(plan)
    for share in (0.5, 0.8, 0.95):
        both, own = int(1000 * share), 1000 - int(1000 * share)
        a = rng.integers(0, 1 << 63, both + own).astype(np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, own).astype(np.uint64)])
        sig = [np.frombuffer(h.signature(h.minima(np.unique(x))), dtype=np.uint64) for x in (a, b)]
        true = both / (both + 2 * own)
        assert abs(float(minhash.estimates(sig[0], sig[1][None, :], plan.hashes)[0]) - true) < 0.16


# --- toxicity ----------------------------------------------------------------


def test_folding_undoes_disguises():
    assert toxicity.fold("ІD1ÓT, 1d10t!") == toxicity.fold("idiot idiot")
    assert toxicity.fold(None) == "  " and toxicity.fold("ＳＣＵＭ") == toxicity.fold("scum")


def test_toxicity_learns_and_leaves_clean_alone(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, "en", 60).split()
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vilesome", "vilester", "grotty"])
        rows.append((i, " ".join(words), "en", "a", 0))
        if i < 240:
            labels.append((i, 1, int(i % 4 == 0)))
    labels.append((None, 1, 1))
    docs = spark.createDataFrame([*rows, (900, None, None, None, 0), (901, "V1LESOME gr0tty " + rows[1][1], None, None, 0)], SCHEMA)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Workspace(spark, "t"))
    got = {r.doc_id: r.score for r in toxicity.measure(docs, lexicon).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(300))
    assert got[901] >= 0.7 > got[900] and got[900] == got[1]


def test_toxicity_learns_from_texts_with_one_beginning_and_end(spark):
    rng, frame = random.Random(4), "a line of forty letters that all texts do share"
    rows = []
    for i in range(120):
        body = prose(rng, "en", 40).split()
        if i % 4 == 0:
            body[7] = "vilesome"
        rows.append((i, f"{frame} {' '.join(body)} {frame}", "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.measure(docs, toxicity.learn(docs, labels, Workspace(spark, "t"))).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(120))


def test_toxicity_exceptions_and_no_labels(spark, docs):
    lexicon = toxicity.Lexicon({" trash ": 5.0}, [toxicity.fold("trash can")], 2.0, 8.0)
    a = lexicon.automaton()
    assert lexicon.measure("a trash can here", a)[1] == 0 and lexicon.measure("you trash", a)[1] == 1
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"), Workspace(spark, "t"))
    assert {r.score for r in toxicity.measure(docs, none).collect()} == {0.5}


# --- token store, byte-level BPE ---------------------------------------------


def test_store_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ws, enc = Workspace(spark, "t"), Tokenizer.from_file(path)
    special = [(900, "a <|endoftext|> b", None, None, 0), (901, "<|endoftext|><|endoftext|>", None, None, 0), (902, "x<|endoftext|>  y ", None, None, 0)]
    rows = sorted(corpus() + special, key=lambda r: r[0])
    paths = tokenstore.write_store(docs.union(spark.createDataFrame(special, SCHEMA)), ws, path)
    ids = [enc.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    got = sorted(tokenstore.read_checks(spark, paths).collect(), key=lambda r: r.row)
    assert [r.doc_id for r in got] == [r[0] for r in rows] and all(r.verified for r in got)
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    back = {r.row: list(r.ids) for r in tokenstore.read_ids(spark, paths).collect()}
    assert back == dict(enumerate(ids))
    chunks = spark.read.parquet(paths["chunks"])
    assert chunks.count() == chunks.select("digest").distinct().count() and chunks.agg(F.sum("n_ids")).first()[0] < sum(map(len, ids))


def test_store_finds_damage(spark, docs):
    ws = Workspace(spark, "t")
    paths = tokenstore.write_store(docs, ws, public_tokenizers.path("byte_bpe_50k.json"))
    bad = ws.save(spark.read.parquet(paths["chunks"]).withColumn("payload", F.when(F.col("n_ids") > 64, F.overlay("payload", F.lit(b"\x07"), F.lit(3))).otherwise(F.col("payload"))), "bad")
    broken = tokenstore.read_checks(spark, paths | {"chunks": bad._folio_path})
    assert broken.where("not verified").count() > 0


def test_store_of_nothing(spark, empty):
    paths = tokenstore.write_store(empty, Workspace(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenstore.read_checks(spark, paths).count() == 0


def test_chunks_tile_documents():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 60_000).astype(np.uint16)
    ids[5000:30_000] = 7  # nowhere to cut
    bounds = np.array([0, 0, 1, 70, 4000, 40_000, 60_000])
    ends, counts = tokenstore.chunk_ends(tokenstore.rolling_cuts(ids), bounds)
    sizes, last = np.diff(np.concatenate([[0], ends])), np.cumsum(counts)
    assert counts.sum() == len(ends) and sizes.max() <= tokenstore.MAX_IDS and counts[0] == 0
    for k in range(1, len(counts)):
        mine = slice(last[k - 1], last[k])
        assert ends[mine][-1] == bounds[k + 1] and sizes[mine].sum() == bounds[k + 1] - bounds[k]
        assert (sizes[mine][:-1] >= tokenstore.MIN_IDS).all()


def test_rolling_hash_is_the_polynomial():
    ids, width = np.arange(300, dtype=np.uint16) * 37, tokenstore.WINDOW
    want = []
    for end in range(width, len(ids) + 1):
        h = 0
        for i in ids[end - width : end].tolist():
            x = (i + 1) * 0x9E3779B1 % 2**32
            h = (h * 0x01000193 + (x ^ x >> 15)) % 2**32
        h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
        if (h ^ h >> 13) & tokenstore.MASK == 0:
            want.append(end)
    assert tokenstore.rolling_cuts(ids).tolist() == want


def test_crcs_join():
    parts = [b"abc", b"", b"\x00" * 900, bytes(range(256)) * 8]
    assert tokenstore.join_crcs((zlib.crc32(p), len(p)) for p in parts) == zlib.crc32(b"".join(parts))


def test_bpe_equals_tiktoken_and_decodes(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = [" é😀 日本語", "a  b \n c ", " x\x1cy", "it's 12'30", "<|endoftext|>", "é"]
    both = docs.union(docs.sparkSession.createDataFrame([(500 + i, t, None, None, 0) for i, t in enumerate(odd)], SCHEMA))
    for r in bpe.decode(bpe.encode(both, path, pattern, offsets=True), path, pattern).collect():
        text = r.text or ""
        assert list(r.ids) == own.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert list(r.char_starts) == [len(text.encode()[:s].decode(errors="ignore")) for s in r.byte_starts]
        assert r.size is None or isinstance(r.size, int)


# --- language, quality -------------------------------------------------------


def test_language_of_held_out_texts(spark, docs):
    out = held_out("doc_id", 5, 0)
    model = langid.learn(docs.where(~out), Workspace(spark, "t"))
    got = {r.doc_id: r for r in langid.predict(docs.withColumn("held_out", out), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    asked = [r for r in got.values() if r.held_out and r.doc_id > 5]
    assert asked and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in asked)


def test_language_without_training(spark, docs, empty):
    model = langid.learn(empty, Workspace(spark, "t"))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}


def test_temperature_lowers_overconfidence():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    right = rng.random(400) < 0.8
    logits = np.zeros((400, 2))
    logits[np.arange(400), np.where(right, y, 1 - y)] = 9.0
    t = langid.fit_temperature(logits, y)
    assert abs(1 / (1 + math.exp(-9 / t)) - right.mean()) < 0.02


def test_ordinal_grades_in_order(spark):
    rng = random.Random(8)
    rows, ratings = [], []
    for i in range(400):
        g = i % 3
        words = [w if rng.random() > 0.35 * g else "!!!" + w.upper() for w in prose(rng, "en", 80).split()]
        rows.append((i, " ".join(words), None, None, 0))
        if i < 300:
            ratings.append((i, 2 - g))
    docs = spark.createDataFrame([*rows, (999, None, None, None, 0)], SCHEMA)
    model = ordinal.learn(docs, spark.createDataFrame(ratings, "doc_id long, quality int"), Workspace(spark, "t"))
    assert model.grades == [0.0, 1.0, 2.0] and (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in ordinal.grade(docs, model).collect()}
    means = [np.mean([got[i].expected_grade for i in range(300, 400) if 2 - i % 3 == g]) for g in range(3)]
    assert means[0] < 0.6 < means[1] < 1.5 < means[2]
    assert np.mean([got[i].selected == (i % 3 == 0) for i in range(300, 400)]) > 0.9 and len(got) == 401


def test_ordinal_keeps_learning_data_packed(spark, docs, monkeypatch):
    """What the driver holds of 12,000 texts are arrays of four bytes a number, equal to the texts' features."""
    held = []
    monkeypatch.setattr(ordinal, "fit", lambda data, grades: held.extend(data) or ordinal.Model(grades, np.zeros(ordinal.BINS), np.zeros(1)))
    ordinal.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(4, 60)], "doc_id long, quality int"), Workspace(spark, "t"))
    want = sorted((f[0].tolist(), f[1].astype(np.float32).tolist()) for f in (ordinal.features(r.text) for r in docs.where("doc_id between 4 and 59").dropDuplicates(["doc_id"]).collect()))
    assert sorted((at.tolist(), values.tolist()) for at, values, _ in held) == want
    assert {x.dtype.itemsize for at, values, _ in held for x in (at, values)} == {4}


def test_ordinal_learns_from_all_of_many_grades(spark):
    rng = random.Random(9)
    rows = []
    for i in range(404):
        g = i % 101
        words = [w if rng.random() < g / 100 else "!!!" + w.upper() for w in prose(rng, "en", 80).split()]
        rows.append((i, " ".join(words), None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = ordinal.learn(docs, spark.createDataFrame([(i, i % 101) for i in range(404)], "doc_id long, quality int"), Workspace(spark, "t"))
    assert model.grades == [float(g) for g in range(101)] and (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r.expected_grade for r in ordinal.grade(docs, model).collect()}
    means = [np.mean([got[i] for i in got if low <= i % 101 < low + 25]) for low in (0, 25, 50, 76)]
    assert all(a + 5 < b for a, b in zip(means, means[1:])) and means[-1] > 60


def test_ordinal_without_ratings(spark, docs):
    model = ordinal.learn(docs, spark.createDataFrame([], "doc_id long, quality int"), Workspace(spark, "t"))
    assert ordinal.grade(docs, model).where("not selected").count() == 0


# --- neighbours --------------------------------------------------------------


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(800, 16)), np.repeat(rng.normal(size=(1, 16)), 400, axis=0), rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(300, 16))]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    odd = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] + [1.0] * 15, 0), (5150, [None] + [1.0] * 15, 0), (5200, [1.0], 0), (None, [1.0] * 16, 0)]
    got = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), Workspace(spark, "t")).collect()
    v = x.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        s = v @ v[q]
        s[q] = -9
        best = sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine) and sorted(r.score for r in mine) == [r.score for r in mine][::-1]
        hits += len({r.vec_id for r in mine} & set(best))
    assert hits >= 0.9 * 5 * 30 and {r.query_id for r in got} == set(range(0, 1500, 50))


def test_few_vectors_are_searched_exactly(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in ann.search(few, Workspace(spark, "t")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(few.limit(0), Workspace(spark, "t")).count() == 0


def test_vectors_of_other_sizes_ids_and_lengths(spark):
    """Tiny and huge vectors have their cosines; repeated ids ask for themselves, equal rows once; each length by itself."""
    big, small = 1e300, 1e-300
    rows = [(0, [big, 0.0]), (0, [0.0, small]), (0, [0.0, small]), (1, [big, big]), (2, [0.0, big]), (3, [small, 0.0]), (50, [1.0, 2.0, 2.0]), (51, [2.0, 4.0, 4.0]), (52, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Workspace(spark, "t"), k=2).collect()
    told = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got)
    half = round(math.sqrt(0.5), 12)
    assert told == [(0, 1, 2, 1.0), (0, 1, 3, 1.0), (0, 2, 1, half), (0, 2, 1, half), (50, 1, 51, 1.0)]


def test_queries_that_find_too_few_are_sent_to_all_parts(spark, monkeypatch):
    """A router that sends queries where nothing lies costs time, not results."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))

    def nowhere(vectors, recall, k):
        return ann.Router(np.zeros((4, 1)), np.zeros(1), np.zeros((1, 3)), np.array([0.0, 1.0, 2.0]), 1)

    monkeypatch.setattr(ann, "fit", nowhere)
    monkeypatch.setattr(ann.Router, "ranked", lambda self, u: np.where((u[:, :1] > 0.9), [[2, 1, 0]], [[1, 0, 2]]))
    x[0] = [9, 0, 0, 0]
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r for r in ann.search(table, Workspace(spark, "t")).collect() if r.query_id == 0]
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = v @ v[0]
    s[0] = -9
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == np.argsort(-s)[:5].tolist()


def test_bounded_sample_is_bounded_and_stable(spark):
    ids = spark.range(5000)
    a, b = ({r.id for r in bounded_sample(ids.repartition(n), ["id"], 300).collect()} for n in (2, 7))
    assert a == b and len(a) == 300


# --- hidden Markov model -----------------------------------------------------


def test_hidden_markov_counts_and_likelihoods(spark, docs):
    ws = Workspace(spark, "t")
    flagged = docs.withColumn("held_out", held_out("doc_id", 7, 2))
    texts = flagged.where("not held_out")
    counts = hmm.count_words(texts.select("text"), ws)
    model = hmm.train(texts.select("text"), counts, ws)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    got = hmm.score(flagged, counts, model, ws, ["doc_id", "held_out"]).collect()
    rows = {r[0]: r[1] for r in corpus()}
    train = [hmm.words_of(r[1]) + ["end"] for r in corpus() if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = {}
    for words in train:
        for w in words:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for r in got:
        words = hmm.words_of(rows[r.doc_id]) + ["end"]
        base = sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert r.n_tokens == len(words) and r.n_known == sum(w in c for w in words) and r.train_tokens == n
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert len(got) == len(corpus())


def test_training_passes_until_the_whole_corpus_settles(spark, docs, monkeypatch):
    monkeypatch.setattr(hmm, "SEED_TEXTS", 2)
    texts, ws = docs.where("doc_id <> 5").select("text"), Workspace(spark, "t")
    counts = hmm.count_words(texts, ws)
    model = hmm.train(texts, counts, ws)
    rows = hmm.symbol_lists([r.text for r in texts.collect()], counts)
    told = model.log_likelihoods(rows).sum()
    more = hmm.updated(*model.expected(rows), hmm.prior_of(counts)).log_likelihoods(rows).sum()
    assert more - told < 2e-4 * abs(told)


def test_words_of_columns_equal_those_of_texts():
    import pyarrow as pa

    texts = [None, "", " \t", "Ab  cD\x0b\x0ceÉ\x1cf ", "\nx", "a a\u00a0b A"]
    doc, codes, words = hmm.coded_words(pa.array(texts))
    words = words.to_pylist()
    assert [[words[c] for c in codes[doc == i]] for i in range(len(texts))] == [hmm.words_of(t) for t in texts]
    assert hmm.classes_of(pa.array(words, pa.binary())).tolist() == [hmm.class_of(w) for w in words]


def test_expected_counts_equal_sums_over_all_paths():
    """Of rows of unequal length, whether held whole or in stretches of few tokens."""
    rng = np.random.default_rng(6)
    model = hmm.Model(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T)
    rows = [np.array(r) for r in ([1, 2, 3, 1, 0], [0], [2, 2, 0], [3, 1, 1, 0])]
    start, move, emit, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for row in rows:
        weights = {}
        for path in np.ndindex(*[2] * len(row)):
            p = model.start[path[0]] * model.emit[row[0], path[0]]
            for t in range(1, len(row)):
                p *= model.move[path[t - 1], path[t]] * model.emit[row[t], path[t]]
            weights[path] = p
        z = sum(weights.values())
        total += math.log10(z)
        for path, p in weights.items():
            start[path[0]] += p / z
            for t, s in enumerate(path):
                emit[row[t], s] += p / z
                if t:
                    move[path[t - 1], s] += p / z
    for most in (1, 3, 7, 1000):
        got = model.expected_and_likelihood(rows, most)
        assert np.allclose(got[0], start) and np.allclose(got[1], move) and np.allclose(got[2], emit) and abs(got[3] - total) < 1e-9
        assert abs(model.log_likelihoods(rows, most).sum() - total) < 1e-9


def test_common_words_are_bounded_where_counts_tie(spark, monkeypatch):
    monkeypatch.setattr(hmm, "COMMON", 5)
    table = spark.createDataFrame([(bytearray(f"w{i}".encode()), 9 if i < 3 else 2) for i in range(40)], "word binary, c long")
    top = hmm.most_common(table)
    assert len(top) == 5 and {c for _, c in top[:3]} == {9} and top == hmm.most_common(table.repartition(5))


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    row = np.array([3, 1, 4, 0], dtype=np.int32)
    total = 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = model.start[path[0]] * model.emit[row[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[row[t], path[t]]
        total += p
    assert abs(model.log_likelihoods([row, row[:2]])[0] - math.log10(total)) < 1e-12


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 4, rng.integers(5, 40)).astype(np.int32) for _ in range(30)]
    model = hmm.Model(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T)
    before = model.log_likelihoods(rows).sum()
    for _ in range(5):
        s, m, e = model.expected(rows)
        assert abs(e.sum() - sum(map(len, rows))) < 1e-6
        model = hmm.Model(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))
    assert model.log_likelihoods(rows).sum() > before


# --- mixing, host rules ------------------------------------------------------


def test_mix_meets_its_targets(spark, docs):
    got = curriculum.curriculum_mix(docs, Workspace(spark, "t"), keep=["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(corpus())
    total = sum(len(minhash_words(r[1])) for r in corpus())
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    by = {s: [r for r in got if r.source == s] for s in names}
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6 * total
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1 and rs[0].target <= 3 * rs[0].source_size + 1e-9
        assert all(0 <= r.taken <= 3 * r.size for r in rs)
    again = curriculum.curriculum_mix(docs.repartition(7), Workspace(spark, "t"), keep=["doc_id"]).select("row.doc_id", "taken").collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def minhash_words(text):
    return (text or "").encode().split()


def test_training_order_follows_the_schedules(spark, docs):
    mixed = curriculum.curriculum_mix(docs, Workspace(spark, "t"))
    rows = curriculum.training_order(mixed, partitions=4).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert sum(r.words for r in rows) == mixed.agg(F.sum("taken")).first()[0]
    shape = np.array(curriculum.SCHEDULES[1])
    for u in (0.1, 0.5, 0.9):
        t = spark.range(1).select(curriculum.due_time(F.lit(u), curriculum.SCHEDULES[1])).first()[0]
        xs = np.linspace(0, t, 2001)
        ys = np.interp(xs, [0, 0.5, 1], shape)
        assert abs(float(((ys[1:] + ys[:-1]) / 2 * np.diff(xs)).sum()) - u) < 1e-6
    assert curriculum.curriculum_mix(docs.limit(0), Workspace(spark, "t")).count() == 0


def test_rules_equal_a_direct_count(spark, docs):
    odd = [(700, "a b c d e f g h " * 3, None, "z", 0), (701, "x\nx\n \n\nx", None, "z", 0), (702, "#$ |<> é ü", None, None, 0)]
    both = docs.union(docs.sparkSession.createDataFrame(odd, SCHEMA))
    got = hostrules.host_rules(both, Workspace(spark, "t"), F.col("source"), keep=["doc_id"]).collect()
    texts = {r[0]: r[1] or "" for r in [*corpus(), *odd]}
    for r in got:
        text = texts[r.row.doc_id]
        words = text.encode().split()
        seen, again = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                again |= {p + k for p in places for k in range(8)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in hostrules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    z = [r for r in got if r.row.doc_id in (700, 701)]
    assert all(not r.kept for r in z) and len(got) == len(corpus()) + 3
    plan = hostrules.host_rules(both, Workspace(spark, "t"), F.col("source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_beta_prior_shrinks(spark):
    hosts = spark.createDataFrame([("a", 1000, 10), ("b", 1000, 30), ("c", 1, 1)], "host string, host_docs long, host_failed long")
    a, b = hostrules.beta_prior(hosts)
    assert a > 0 and b > 0 and (1 + a) / (1 + a + b) < 1
    assert hostrules.beta_prior(hosts.limit(0)) == pytest.approx((1e-6, 1 - 1e-6))
