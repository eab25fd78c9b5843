"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from tickflow.llm import bpe, brown, chat, features, jaccard, langid, packing, quality, sharding, substrings, suffixes, vectors, vocab
from tickflow.llm.frames import components, prepare
from tickflow.llm.text import byte_hashes, pack_varints, shingle_hashes, unpack_varints, words_of

DOCS = "doc_id long, text string, lang string, score double, n string"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_texts(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéoü") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [None, "", " \n\t ", "x", "One two", "one TWO", "  a  b \n\n c  ", "don't  stop\x1c 'll\n  \n"]
    texts += [prose(rng.randint(5, 150)) for _ in range(25)]
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(4)]
    base = prose(200).split()
    for k in (0, 1, 3, 9, 40):
        edited = list(base)
        for i in rng.sample(range(200), k):
            edited[i] = "edit" + str(i) + str(k)
        texts.append(" ".join(edited))
    texts += [texts[10]] * 3 + ["ab" * 700, "z" * 5000 + "é" * 300]
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    prepare(spark)
    rows = [(i, t, "en", 0.5, "n") for i, t in enumerate(texts)]
    rows += [rows[12], (None, "row without id", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], DOCS)


def test_bpe_round_trip(docs, empty):
    path = vocab.default_path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=vocab.read_ranks(path), special_tokens={})
    out = bpe.decode(bpe.encode(docs.withColumnRenamed("n", "ids"), path, block_bytes=3000), path).join(
        docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(out) == docs.count() - 1  # the join leaves the null id out
    for r in out:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(empty, path).count() == 0


def test_pretokens_equal_the_pattern():
    rng = random.Random(1)
    alphabet = [*"ab 's't  \n\t\r.,!1٣é中\x1c\x85​　'", "'re", " the", "  "]
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(40)]
        codes, offsets, words = bpe.pretokens(pa.array(texts))
        for i, text in enumerate(texts):
            own = [words[c] for c in codes[offsets[i]:offsets[i + 1]]]
            assert own == bpe._PATTERN.findall(text)


def test_varints():
    codes = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1] * 100)
    offsets = np.array([0, 0, *range(8, 801, 8), 800])
    back, where = unpack_varints(pa.array(pack_varints(codes, offsets), pa.binary()))
    assert back.tolist() == codes.tolist() and where.tolist() == offsets.tolist()


def test_language_id(spark, empty):
    rng = random.Random(2)
    words = {"en": "the of and with".split(), "de": "der und nicht für".split(), "es": "el los para año".split(), "fr": "le des été pour".split()}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", "x", "ab"]) for _ in range(40)), k, None, None)
            for i, k in enumerate(list(words) * 40)]
    table = spark.createDataFrame(rows + [(900, None, "en", None, None), (901, " 12 . ", "de", None, None)], DOCS)
    model = langid.train(table.where("doc_id % 5 <> 2"))
    assert set(model["families"]) == {"germanic", "romance"}
    out = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    assert all(out[r[0]]["lang_pred"] == r[2] and 0.5 < out[r[0]]["score"] <= 1 for r in rows)
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (900, 901))
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(table, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_brown_scores(spark, docs, texts, empty):
    from pyspark.sql import functions as F

    out = brown.score(docs, F.col("doc_id") % 3 != 0).collect()
    assert len(out) == docs.count() and "text" not in out[0].asDict()
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + ["\n"]
    train = [t for i, t in enumerate(texts) if i % 3] + ([texts[12]] if 12 % 3 else [])
    counts = Counter(w for t in train for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    for r in out:
        own = tokens(texts[r["doc_id"]] if r["doc_id"] is not None else "row without id")
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert brown.score(empty, F.lit(True)).count() == 0
    none = brown.score(docs, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)}


def brute_brown(texts, train, clustered, classes):
    """The scores by one pass over plain lists, with the module's exchange of the frequent words and its formulas."""
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\n"] for t in texts]
    learned = [t for t, is_train in zip(tokens, train) if is_train]
    counts = Counter(w for t in learned for w in t)
    top = sorted((w for w in counts if w != "\n"), key=lambda w: (-counts[w], w))[:clustered]
    k, size = len(top), classes + 2
    place = {w: i for i, w in enumerate(top)} | {"\n": k + 1}
    bigrams = np.zeros((k + 2, k + 2))
    for t in learned:
        for a, b in zip(["\n", *t], t):
            bigrams[place.get(a, k), place.get(b, k)] += 1
    cls = brown.exchange(bigrams, classes, 2)
    member = np.eye(size)[cls]
    table = member.T @ bigrams @ member
    near = defaultdict(lambda: np.zeros(2 * size))
    for t in learned:
        for a, w, b in zip(["\n", *t], t, [*t[1:], "\n"]):
            if w not in place:
                near[w][cls[place.get(a, k)]] += 1
                near[w][size + cls[place.get(b, k)]] += 1
    names = sorted(near)
    seen, n = np.array([near[w] for w in names]).reshape(-1, 2 * size), np.array([counts[w] for w in names])
    tables, before = np.hstack([table[:, :classes].T, table[:classes]]), None
    for _ in range(brown.ALL_ROUNDS):
        now = np.argmax(seen @ brown.weights_of(tables), axis=1)
        if before is not None and n[now != before].sum() <= brown.MOVED * n.sum():
            break
        before, tables = now, np.array([seen[now == c].sum(axis=0) for c in range(classes)])
    of = dict(zip(names, (size + np.argmax(seen @ brown.weights_of(tables), axis=1)).tolist())) | {w: int(cls[i]) for w, i in place.items()}
    unknown = size + classes
    pairs = np.zeros((unknown + 1, unknown + 1))
    for t in learned:
        for a, b in zip(["\n", *t], t):
            pairs[of[a], of[b]] += 1
    once, twice = (sum(v == i for v in counts.values()) for i in (1, 2))
    transition, emission = brown.probabilities(pairs, unknown, size, once, twice)
    out = []
    for t in tokens:
        c = [of["\n"]] + [of.get(w, unknown) for w in t]
        out.append(sum(transition[a, b] + emission[b] + (math.log10(counts[w]) if counts[w] else 0) for a, b, w in zip(c, c[1:], t)))
    return out


@pytest.mark.parametrize("clustered, classes", [(20, 3), (1000, 4), (0, 2)])
def test_brown_scores_equal_brute_force(spark, texts, clustered, classes):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    own = brute_brown(texts, [i % 4 > 0 for i in range(len(texts))], clustered, classes)
    for r in brown.score(table, F.col("doc_id") % 4 > 0, clustered=clustered, classes=classes).collect():
        assert math.isclose(r["score"], own[r["doc_id"]], rel_tol=1e-9), r["doc_id"]


def test_contexts_are_folded_by_word(monkeypatch):
    rng = random.Random(9)
    rows = sorted((rng.choice(["a", "b", "hot", "hot", "hot", "é", "z"]), i // 3, i, rng.randint(0, 4)) for i in range(300))
    around = [{rng.randrange(6): rng.randint(1, 300) for _ in range(rng.randint(0, 3) * (r[1] % 4 > 0))} for r in rows]
    batches = []
    for at in range(0, len(rows), 7):
        some, near = rows[at:at + 7], around[at:at + 7]
        flat = [x for d in near for pair in sorted(d.items()) for x in pair]
        packed = pack_varints(np.array(flat, np.int64), np.cumsum([0] + [2 * len(d) for d in near]))
        batches.append(pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in some]), pa.array([r[2] for r in some], pa.int32()), pa.array([r[0] for r in some]),
             pa.array([r[3] for r in some]), pa.array(packed, pa.binary())], names=["block", "code", "word", "n", "around"]))
    monkeypatch.setattr(brown, "PLACES", 5)
    out = [r for b in brown._fold(3)(batches) for r in b.to_pylist()]
    word_of = {(r[1], r[2]): r[0] for r in rows}
    assert sorted((b, c) for r in out for b, c in zip(r["blocks"], r["codes"])) == sorted(word_of)
    firsts = Counter()
    for r in out:
        word, = {word_of[b, c] for b, c in zip(r["blocks"], r["codes"])}
        own = [i for i, x in enumerate(rows) if x[0] == word]
        assert r["n"] == sum(rows[i][3] for i in own) and len(r["blocks"]) <= max(5, 7)
        assert dict(zip(r["bins"], r["counts"])) == dict(sum((Counter(around[i]) for i in own), Counter()))
        firsts[word] += r["first"]
    assert firsts == Counter({w: 1 for w in set(word_of.values())})


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    kind = np.arange(24) % 3  # three kinds of words, each followed by the next kind
    counts = rng.poisson(0.3, (26, 26)) + 20.0 * np.pad(kind[:, None] == (kind + 2) % 3, ((0, 2), (0, 2)))

    def likelihood(cls):
        member = np.eye(5)[cls]
        table = member.T @ counts @ member
        x = lambda a: (a * np.log(np.maximum(a, 1e-300))).sum()
        return x(table) - x(table.sum(axis=0)) - x(table.sum(axis=1))

    start = np.concatenate([np.arange(24) % 7 % 3, [3, 4]])
    found = brown.exchange(counts, 3, 2)
    assert likelihood(found) >= likelihood(start)
    for w in range(24):  # no single move is better
        for c in range(3):
            other = found.copy()
            other[w] = c
            assert likelihood(other) <= likelihood(found) + 1e-6


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(covered)


def test_quality_counts(spark, empty):
    prepare(spark)
    rng = random.Random(4)
    texts = make_texts() + ["a b c a b c a b c", "l\nl\n\n\nl \nl", "# * $ | <> & %", "w " * 60]
    good = [" ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice("ALPHA!! BETA## | $$".split()) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(60)]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts + good + bad)], DOCS)
    n = len(texts)
    labels = spark.createDataFrame([(n + i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.judge(table, quality.train(table, labels)).collect()}
    for i, t in enumerate(texts):
        own = base_counts(t)
        assert tuple(out[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == own
        assert out[i]["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
    assert all(out[n + i]["kept"] == (i < 60) for i in range(120))
    assert quality.judge(empty, (None, 1.0, 0.0)).count() == 0
    assert quality.train(table, labels.where("quality = 1"))[0] is None  # one label: nothing to learn


def repeats(texts, width):
    raws = [(t or "").encode() for t in texts]
    windows = Counter(r[i:i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if windows[r[i:i + width]] > 1:
                hit[i:i + width] = b"\1" * width
        spans = [m.span() for m in re.finditer(b"\1+", bytes(hit))]
        out.append((bytes(b for b, h in zip(r, hit) if not h), spans))
    return out


@pytest.mark.parametrize("group", [0, 256])
def test_repeated_substrings(docs, texts, empty, group):
    expected = repeats([*texts, texts[12], "row without id"], 200)
    out = substrings.remove_repeats(docs, group=group, block=1500)
    for r in out.withColumn("clean", substrings.as_text("kept")).collect():
        kept, spans = expected[r["doc_id"] if r["doc_id"] is not None else -1]
        assert bytes(r["kept"]) == kept and [(s["begin"], s["end"]) for s in r["spans"]] == spans
        assert r["clean"] == kept.decode("utf-8", "ignore")
    assert substrings.remove_repeats(empty).count() == 0


def test_anchors_cover_all_windows():
    raw = np.frombuffer(random.Random(7).randbytes(3000), np.uint8)
    bounds = np.array([0, 900, 1000, 3000])
    a = suffixes.anchors(suffixes.Hashes(raw), bounds, 200)
    starts = [s for low, high in zip(a.low, a.high) for s in range(low, high + 1)]
    assert starts == [s for b, e in zip(bounds, bounds[1:]) for s in range(b, e - 199)]
    assert ((a.low <= a.at) & (a.at <= a.low + 136)).all()


def linked_components(texts, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("frequent", [2, 10**6])
def test_jaccard_components(docs, texts, empty, frequent):
    sizes, root = linked_components(texts)
    out = jaccard.near_duplicate_components(docs, frequent=frequent).where("doc_id is not null").collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], root[r["doc_id"]])
    assert jaccard.near_duplicate_components(empty).count() == 0


def test_jaccard_near_the_threshold(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for k in range(60):  # edits of one text: some pairs just link, some just do not
        own = list(base)
        for i in rng.sample(range(120), k % 7):
            own[i] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(own[k % 11:]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    _, root = linked_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicate_components(table).collect()} == dict(enumerate(root))


def test_jaccard_of_contained_texts(spark):
    rng = random.Random(23)
    texts = []
    for _ in range(40):  # a text of 100 shingles, passages of 80 to 88 of them, and edited copies
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(104)]
        texts.append(" ".join(base))
        for _ in range(3):
            m = rng.randint(80, 88)
            at = rng.randint(0, 100 - m)
            texts.append(" ".join(base[at:at + m + 4]))
        for _ in range(4):
            own = list(base)
            for i in rng.sample(range(104), rng.randint(2, 3)):
                own[i] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(own))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    _, root = linked_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicate_components(table).collect()} == dict(enumerate(root))


def test_jaccard_lists_of_unequal_sizes(spark):
    rng = random.Random(22)
    rows, wanted = [], set()
    length = lambda n: n - -(-80 * n // 100) + 1
    for k in range(200):  # pairs that reach the threshold, as prefix rows of two components
        x = rng.sample(range(1000 * k, 1000 * k + 1000), 100)
        y = rng.sample(x, 80 + k % 9)
        for t, own in ((2 * k, x), (2 * k + 1, y)):
            rows += [(s, t, len(own), t) for s in sorted(own)[:length(len(own))]]
        wanted.add((2 * k, 2 * k + 1))
    placed = spark.createDataFrame(rows, "shingle long, t long, n int, root long")
    assert {(r["a"], r["b"]) for r in jaccard._apart(placed, 80).collect()} == wanted


def test_least_common_never_drops_a_linked_pair(spark):
    rows = [(n, m) for n in range(1, 60) for m in range(n, 60) if 100 * n >= 80 * m]
    out = spark.createDataFrame(rows, "n long, m long").withColumn("c", jaccard.least_common("n", "m", 80)).collect()
    length = lambda n: n - -(-80 * n // 100) + 1
    for n, m, c in out:
        need = -(-80 * (n + m) // 180)
        # common shingles behind the prefix that ends first are at most those behind either
        assert c <= max(1, need - max(n - length(n), m - length(m))) and c <= length(n)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert out == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), spark).count() == 0


def test_sharding(spark, docs, empty):
    rng = random.Random(10)
    rows = [(i, "same text " * 30 if i % 3 == 0 else "t" * rng.randint(0, 400) + str(i)) for i in range(4000)] + [(None, None), (7, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard(table, 24).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    slots, weight = defaultdict(list), Counter()
    for r in out:
        assert r["size"] == size(r["text"]) and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(weight.values()) / 24
    assert max(abs(w - mean) for w in weight.values()) <= 0.03 * mean
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(table.repartition(2), 24).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in out}
    assert sharding.shard(empty, 24).count() == 0
    assert sharding.shard(docs, 3).count() == docs.count()


@pytest.mark.parametrize("cell_rows", [10**6, 40])
def test_vectors(spark, cell_rows):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(12, 16))
    points = np.repeat(middle, 12, axis=0) + rng.normal(size=(144, 16)) * 0.12
    rows = [(i, p.astype(np.float32).tolist(), 0) for i, p in enumerate(points)]
    rows += [(200, rows[3][1], 1), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 0), (204, [], 0),
             (205, [None] * 16, 0), (206, rows[3][1][:8], 0), (207, [x * 2 for x in rows[3][1]], 0), (208, [float("inf")] + [0.0] * 15, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    out = {r["vec_id"]: r for r in vectors.near_duplicates(table, cell_rows=cell_rows, block=16).collect()}
    real = {i: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for i, v, _ in rows
            if i not in (201, 202, 203, 204, 205, 206, 208)}
    root = {i: i for i in out}
    total = found = 0
    for i in real:
        links = [j for j in real if j != i and real[i] @ real[j] >= 0.95]
        total, found = total + len(links), found + out[i]["n_links"]
        assert out[i]["n_links"] <= len(links)
        for j in links:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    assert found >= 0.9 * total and (cell_rows == 40 or found == total)
    if cell_rows > 40:
        assert {i: r["component_id"] for i, r in out.items()} == root
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (201, 202, 203, 204, 205, 206, 208))
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_chat_round_trip(spark):
    path = vocab.default_path("byte_bpe_50k.tiktoken")
    odd = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\/s> [[INST]]", "", None, "plain é"]
    rows = [(c, t, role, odd[(c + t) % 5]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "tool", None, "assistant"])]
    rows += [rows[2], (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    made = chat.format_turns(turns, path)
    out = {r["conv_id"]: r for r in chat.read_back(made, path).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert out[c]["n_turns"] == len(own) and out[c]["loss_chars"] == len(loss)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for text in odd:
        if text:
            assert chat.unescape(chat.escape(text)) == text and not any(s in chat.escape(text) for s in chat.CONTROLS)
    ends = defaultdict(int)
    for r in sorted(made.where("conv_id = 1").collect(), key=lambda r: r["n"]):
        assert r["start"] == ends[1]
        ends[1] += r["length"]
    assert chat.read_back(chat.format_turns(turns.limit(0), path), path).count() == 0


def test_packing(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = vocab.default_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    wanted = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for t in [*texts, texts[12], "row without id"])
    out = packing.pack(docs.withColumnRenamed("n", "offset"), path, size=64, block_bytes=2000).collect()
    sequences = defaultdict(list)
    for r in out:
        assert 0 < r["length"] <= 64 and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    del by[12]  # a repeated row: both documents have the same id
    for pieces in by.values():
        pieces.sort()
        whole = [x for _, ids, _ in pieces for x in ids]
        assert [s for s, _, _ in pieces] == np.cumsum([0] + [len(i) for _, i, _ in pieces])[:-1].tolist()
        assert pieces[0][2] == len(whole) and wanted[tuple(whole)]
    assert packing.pack(empty, path).count() == 0


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    path, mark = vocab.default_path("byte_bpe_50k.json"), "<|endoftext|>"
    tokenizer = Tokenizer.from_file(path)
    texts = ["x" + mark, mark, "plain text", "one " + mark + mark + "  two \n" + mark + " three", "<|endoftext" + mark + "|>", "", None,
             "a  " + mark, "tail end"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for block_bytes in (1 << 20, 16):
        out = packing.pack(table, path, size=8, block_bytes=block_bytes).orderBy("doc_id", "start").collect()
        ids = defaultdict(list)
        for r in out:
            ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
        assert all(r["doc_tokens"] == len(ids[r["doc_id"]]) for r in out)


def test_sum_of_squares_choice():
    rng = random.Random(12)
    packer, size = packing.Packer(16), 16
    closed = []
    for k in range(300):
        n = rng.randint(1, 15)
        counts = packer.levels.copy()
        options = {}
        for h in [0, *np.flatnonzero(counts[:size])]:
            if h + n <= size:
                new = counts.copy()
                new[h] -= h > 0
                if h + n < size:
                    new[h + n] += 1
                options[h] = int((new[:size] ** 2).sum())
        closed += packer.add(k, np.arange(n))
        assert int((packer.levels[:size] ** 2).sum()) == min(options.values())
    closed += packer.close()
    assert all((s := sum(len(p[2]) for p in w)) == 16 or s & (s - 1) == 0 for w in closed)


def test_words_and_shingles():
    codes, offsets, words = words_of(pa.array([" A b\x0bc\n", "", "É b"]))
    assert [[words[c].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [["a", "b", "c"], [], ["É", "b"]]
    assert len(shingle_hashes(np.arange(4, dtype=np.uint64), 5)) == 0
    assert len(set(features.word_hashes(pa.array(["a", "b", "ab", "ba", "é", ""])).tolist())) == 6


def test_jaccard_tells_colliding_words_apart(spark):
    """The Thue-Morse word and its complement, which hashes by powers of an odd number cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ side] for x in bits) for side in (0, 1))
    rest = " ".join(f"w{i}" for i in range(40))
    table = spark.createDataFrame([(1, f"{a} x y z"), (2, f"{b} x y z"), (3, " ".join([a] * 9)), (4, " ".join([b] * 9)), (5, f"{rest} {a}"),
                                   (6, f"{rest} {b}"), (7, a), (8, b)], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_components(table).collect()}
    assert out == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (37, 5), 6: (37, 5), 7: (1, 7), 8: (1, 8)}


def test_byte_hashes():
    rng = random.Random(6)
    values = sorted({"".join(rng.choice("abé\x00中") for _ in range(rng.randint(0, 30))) for _ in range(4000)} | {"", "a", "a\x00", "a" * 8, "a" * 9})
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    values += ["".join("ab"[x ^ side] for x in bits) for side in (0, 1)]
    hashes = byte_hashes(pa.array(["skip", *values])[1:])
    assert len(set(hashes.tolist())) == len(values)
    assert byte_hashes(pa.array(values[::-1])).tolist() == hashes[::-1].tolist()
    assert len(byte_hashes(pa.array([], pa.string()))) == 0


def test_numbered_sets_equal_sets_of_words():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for width in (1, 2, 3, 5, 8):
        sets = jaccard.numbered_sets(pa.array(texts), width)
        own = []
        for t in texts:
            w = t.split()
            own.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
        for s, o in zip(sets, own):
            assert len(s) == len(o) and sorted(s.tolist()) == s.tolist()
        for i, j in itertools.combinations(range(0, 200, 7), 2):
            assert jaccard.overlap(sets[i], sets[j]) == len(own[i] & own[j])
