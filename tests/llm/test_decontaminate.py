"""Operator 11 against brute force: exact and proximity matches, hits, ids; nulls, short items, copies, clashing names."""

import random
import re

from tickflow.llm import decontaminate
from tickflow.llm.frames import prepare

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n_hit string, row long, term string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def windows(text):
    w = words(text)
    return {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()


def brute(docs, items):
    out = []
    for text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            for gram in windows(item):
                for b in range(len(w) - len(gram) + 1):
                    if tuple(w[b:b + len(gram)]) == gram:
                        hit |= set(range(b, b + len(gram)))
                        ids.add("" if item_id is None else str(item_id))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def fixture():
    rng = random.Random(7)
    vocabulary = [rng.choice(["la", "De", "é", "Ñ", "ñ", "İx", "e3"]) + str(rng.randrange(9)) * rng.randint(0, 2) for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randint(1, 30))) for i in range(15)]
    items += [(100, "the the the the the the the the the the the the"), (101, "one"), (102, ""), (None, prose(12)), (103, None)]
    items += [(104, items[3][1]), (105, items[3][1].upper().replace(" ", ", ")), (3, prose(11)), items[4], (106, "a'b-c"), (107, prose(400))]
    docs = [None, "", "...", "ONE", "the " * 30, "A b C", "x" * 3000]
    docs += [prose(rng.randint(1, 200)) for _ in range(10)]
    for i, text in items[:14] + items[-1:]:
        w = text.split()
        docs.append(prose(20) + " " + "; ".join(w).upper() + " " + prose(20) + "\n" + "\t".join(w[2:14]))
    docs += [docs[-1]] * 3 + [prose(3000) + " " + items[5][1] + " " + prose(3000)]
    return docs, items


def tables(spark):
    prepare(spark)
    docs, items = fixture()
    rows = [(i, t, "n", 5, "t") for i, t in enumerate(docs)] + [(None, docs[20], None, None, None), (20, docs[20], "n", 5, "t")]
    return (spark.createDataFrame(rows, DOCS).repartition(3), [r[1] for r in rows], items,
            spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, gram string").repartition(2))


def test_exact_phrases(spark, monkeypatch):
    docs, texts, items, benchmark = tables(spark)
    own = dict(zip(texts, brute(texts, items)))
    for limit in (decontaminate.BROADCAST_BYTES, 0):  # also with no table broadcast
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
        out = decontaminate.decontaminate(docs.select("*", docs["text"].alias("copy")), benchmark)
        assert out.columns == ["doc_id", "row", "term", "copy", "n_words", "n_hit", "item_ids", "contaminated"]
        got = out.collect()
        assert len(got) == len(texts)
        for r in got:
            n, hit, ids = own[r["copy"]]
            assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (n, hit, ids, hit > 0)
    assert sum(hit > 0 for _, hit, _ in own.values()) > 10


def test_empty_tables(spark):
    docs, texts, _, benchmark = tables(spark)
    clean = decontaminate.decontaminate(docs, benchmark.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r["n_hit"] or r["item_ids"] or r["contaminated"] for r in clean)
    assert decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0


def test_proximity_matches(spark):
    prepare(spark)
    gram = "alpha beta gamma delta eta theta iota kappa lambda mu".split()
    swapped = [gram[1], gram[0], *gram[2:]]
    one_in = [*gram[:5], "x", *gram[5:]]
    far = [*gram[:5], "x", "y", "z", *gram[5:]]
    texts = {0: gram, 1: ["q", *swapped], 2: one_in, 3: far, 4: gram[:9]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    cut = decontaminate.windows_of(spark.createDataFrame([(1, " ".join(gram)), (2, "beta")], "item_id long, text string"))
    index = decontaminate.build_index(docs, cut.grams)
    ids = {r["row"]: r["doc"]["doc_id"] for r in index.where("term = ''").collect()}
    length = {r["gram"]: r["length"] for r in cut.grams.collect()}

    def near(slop):
        out = set()
        for i, w in texts.items():
            for b in range(-slop, len(w)):
                for n, g in ((10, gram), (1, ["beta"])):
                    if b >= 0 and all(any(0 <= p < len(w) and w[p] == term for p in range(b + j - slop, b + j + slop + 1))
                                      for j, term in enumerate(g)):
                        out.add((i, n, b))
        return out

    for slop in (0, 1, 2):
        found = decontaminate.matches(index, cut.grams, slop).collect()
        got = [(ids[r["row"]], length[r["gram"]], r["start"]) for r in found]
        assert len(got) == len(set(got))
        assert set(got) == near(slop), slop
    assert {i for i, n, _ in near(1) if n == 10} == {0, 1, 2}


def test_no_python_in_the_plan(spark):
    docs, _, _, benchmark = tables(spark)
    plan = decontaminate.decontaminate(docs, benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
