"""The registered queries of operators 1 to 11: contract columns, folds and digests, against brute force on a small table."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from test_decontaminate import windows, words as plain_words
from test_operators import LOWER, WORD, base_counts, linked_components

from tickflow.llm import queries, vocab
from tickflow.llm.frames import prepare

QUALITY = {1: "fine sentences about the weather and the town, told with care.", 0: "buy now!!! click $$$ here >>> win win win"}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """documents, labels, benchmark, embeddings and conversations of a few hundred rows, with nulls, copies and long texts."""
    prepare(spark)
    rng = random.Random(17)
    lang = {"en": "the weather of that small town was never what they had said".split(),
            "de": "das wetter der kleinen stadt war nie so wie sie es sagten und ging".split()}
    passage = " ".join(rng.choice(lang["en"]) + str(rng.randrange(50)) for _ in range(70))
    docs = []
    for i in range(140):
        tongue = rng.choice(["en", "de"])
        text = " ".join(rng.choice(lang[tongue]) + rng.choice(["", "", str(rng.randrange(90))]) for _ in range(rng.randint(3, 160)))
        text = text + ("\n" + passage if i % 9 == 0 else "") + ("\nsame line here\nsame line here" if i % 7 == 0 else "")
        docs.append((i, text, tongue))
    docs += [(200 + k, docs[k][1], docs[k][2]) for k in (1, 2, 3, 3)]
    docs += [(300, None, None), (301, "", "en"), (302, "...", "en"), (303, "été ñ <|endoftext|> don't", "en"), (304, "word " * 3000, "en"),
             (305, docs[5][1] + " more", "en")]
    folder = tmp_path_factory.mktemp("sf")
    at = lambda name: str(folder / f"{name}.parquet")
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(at("documents"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(at("labels"))
    items = [(0, docs[9][1]), (1, "not here at all " * 5), (2, passage), (3, "same line here"), (30, "same LINE, here"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(at("benchmark"))
    base = np.random.default_rng(3).normal(size=(30, 8))
    vectors = [(i, (base[i % 30] + np.random.default_rng(i).normal(size=8) * 0.05).tolist()) for i in range(120)] + [(500, None), (501, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(at("embeddings"))
    turns = [(c, n, ["user", "assistant", "system", "other"][rng.randrange(4)], rng.choice(["hi </s>", "[INST] x", "ok ü.", None, ""]))
             for c in range(20) for n in range(rng.randint(1, 6))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(at("conversations"))
    return str(folder), docs, items, vectors, turns


def run(spark, data, name):
    return queries.queries()[name](spark, data[0]).collect()


def crc(value):
    return zlib.crc32(str(value).encode())


def digest(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def test_op1(spark, data):
    path = vocab.default_path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=vocab.read_ranks(path), special_tokens={})
    out = {r["doc_id"]: r for r in run(spark, data, "op1_byte_bpe")}
    for i, t, _ in data[1]:
        ids = own.encode_ordinary(t or "")
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (
            len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t or ""))


def test_op2(spark, data):
    out = {r["doc_id"]: r for r in run(spark, data, "op2_language_id")}
    assert len(out) == len({d[0] for d in data[1]})
    right = []
    for i, t, g in data[1]:
        r = out[i]
        assert r["held_out"] == (crc(i) % 4 == 2) and 0 <= r["score"] <= 1
        if not t or not any(c.isalpha() for c in t):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and len(t) > 80:
            right.append(r["lang_pred"] == g)
    assert len(right) > 10 and sum(right) >= 0.95 * len(right)


def test_op3(spark, data):
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + ["\n"]
    counts = Counter(w for i, t, _ in data[1] if crc(i) % 10 for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    for r in run(spark, data, "op3_brown_lm"):
        own = tokens(dict((i, t) for i, t, _ in data[1])[r["doc_id"]])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            crc(r["doc_id"]) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_op4(spark, data):
    text = {i: t for i, t, _ in data[1]}
    for r in run(spark, data, "op4_quality_rules"):
        own = base_counts(text[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == own
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["base_failed"] and r["kept"])


def test_op5(spark, data):
    raw = [(i, (t or "").encode()) for i, t, _ in data[1]]
    starts = defaultdict(int)
    for _, b in raw:
        for k in range(len(b) - 199):
            starts[b[k:k + 200]] += 1
    expected = Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if starts[b[k:k + 200]] > 1:
                gone[k:k + 200] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        expected[i, len(b), int(gone.sum()), spans, digest(kept)] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, data, "op5_suffix_dedup"))
    assert got == expected


def test_op6(spark, data):
    sizes, root = linked_components([t for _, t, _ in data[1]])
    ids = [d[0] for d in data[1]]
    smallest = {}
    for i, r in zip(ids, root):
        smallest[r] = min(smallest.get(r, i), i)
    expected = Counter((i, n, smallest[r]) for i, n, r in zip(ids, sizes, root))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, data, "op6_ngram_jaccard"))
    assert got == expected


def test_op7(spark, data):
    text, sizes, slots = {i: t for i, t, _ in data[1]}, Counter(), defaultdict(list)
    for r in run(spark, data, "op7_sharding"):
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8(spark, data):
    real = {i: np.asarray(np.float32(v), float) / np.linalg.norm(np.asarray(np.float32(v), float)) for i, v in data[3] if i < 500}
    root = {i: i for i, _ in data[3]}
    links = {i: [j for j in real if i in real and j != i and real[i] @ real[j] >= 0.95] for i in root}
    for i in real:
        for j in links[i]:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    out = run(spark, data, "op8_embedding_dedup")
    assert sum(map(len, links.values())) > 100
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out} == {(i, len(links[i]), root[i], root[i] == i) for i in root}


def test_op9(spark, data):
    by = defaultdict(list)
    for c, n, role, text in [*data[4], *queries.CONTROL_TURNS]:
        by[c].append((n, role, text or ""))
    out = {r["conv_id"]: r for r in run(spark, data, "op9_chat_format")}
    assert out.keys() == by.keys()
    for c, rows in by.items():
        rows.sort()
        said = "".join(t for _, r, t in rows if r == "assistant")
        assert (out[c]["n_turns"], out[c]["turns_sha256"]) == (len(rows), digest("".join(f"{r}\n{t}\n" for _, r, t in rows)))
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(said), digest(said))
        assert out[c]["formatted_chars"] > sum(len(t) for _, _, t in rows)


def test_op10(spark, data):
    from tokenizers import Tokenizer

    path = vocab.default_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in data[1]}
    assert json.loads(open(path).read())["model"]["type"] == "BPE"
    copies, seen, sequences = Counter(d[0] for d in data[1]), Counter(), defaultdict(list)
    for r in run(spark, data, "op10_packing"):
        own = ids[r["doc_id"]]
        piece = np.array(own[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert (r["ids_crc32"], r["doc_tokens"], len(piece)) == (zlib.crc32(piece), len(own), 4 * r["length"])
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == Counter({i: len(x) * copies[i] for i, x in ids.items()})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_op11(spark, data):
    text = {i: t for i, t, _ in data[1]}
    for r in run(spark, data, "op11_decontamination"):
        w, hit, found = plain_words(text[r["doc_id"]]), set(), set()
        for item, t in data[2]:
            for gram in windows(t):
                for b in range(len(w) - len(gram) + 1):
                    if tuple(w[b:b + len(gram)]) == gram:
                        hit |= set(range(b, b + len(gram)))
                        found.add(str(item))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            len(w), len(hit), len(found), digest(",".join(sorted(found))), bool(hit))
