"""Operator 13 against a plain search over whole audits, and its query against it on a table with every kind of damage."""

import hashlib
import itertools
import random
import zlib

from tickflow.llm import dialogue, queries
from tickflow.llm.frames import prepare

WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired turns): all states with their whole audits, no division, no vectors."""
    bad = faults(rows)
    ways = {0: (0, "", ())}

    def insert(ways):
        out = dict(ways)
        for _ in range(2):
            for q, (cost, audit, turns) in list(out.items()):
                role = "assistant" if q == 2 else "user"
                to = 3 if q == 2 else 2
                new = (cost + 2, audit + "I", (*turns, (role, "")))
                out[to] = min(out.get(to, new), new)
        return out

    for (role, text), fault in zip(rows, bad):
        after = {}
        for q, (cost, audit, turns) in itertools.chain(ways.items(), *[insert({p: w}).items() for p, w in ways.items()]):
            steps = [(q, cost + 3, "D", ())]
            need = "assistant" if q == 2 else "user"
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] == need[0] or (q == 0 and role[:1] == "s"):
                    steps.append((1 if role[:1] == "s" else 3 if q == 2 else 2, cost + extra, "K", ((role, text),)))
                steps.append((3 if q == 2 else 2, cost + 2 + extra, "R", ((need, text),)))
            for to, c, letter, turn in steps:
                new = (c, audit + letter, turns + turn)
                after[to] = min(after.get(to, new), new)
        ways = after
    ends = [insert({q: w}) for q, w in ways.items()]
    return min(w for e in ends for q, w in e.items() if q in (0, 3))


def expected(rows):
    """The report of the turns (turn, role, text) of one conversation in order."""
    plain = [(r, t) for _, r, t in rows]
    bad = faults(plain)
    numbers = [n for n, _, _ in rows if n is not None]
    cost, audit, turns = brute(plain)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{k: bad.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:])),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()}


def conversation(rng, n):
    texts = ["Hello.", "What now?", "No end", "", " \n", "Fine!", "More "]
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]),
             rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(1000)}.") for _ in range(n)]


def test_divide_and_conquer_equals_search():
    rng = random.Random(1)
    for i in range(400):
        rows = conversation(rng, rng.randint(1, 12))
        codes = bytes(dialogue.symbol(r[:1], f in ("blank", "duplicate"), f == "truncated") for (r, _), f in zip(rows, faults(rows)))
        table = dialogue.summary(codes)
        ends = [table[0][0][q] + 2 * dialogue.TAIL[q] for q in dialogue.STATES]
        vector = dialogue.start_at(0)
        for code in codes:
            vector = dialogue.advance_turn(vector, code)[1]
        last = dialogue.end_state(vector)
        audit = "".join(dialogue.edits_of(codes, 0, last)) + "I" * dialogue.TAIL[last]
        assert (min(ends), audit) == brute(rows)[:2], rows
        # the same through blocks of a few turns
        cut = rng.randint(1, 4)
        tables = [dialogue.summary(codes[at:at + cut]) for at in range(0, len(codes), cut)]
        path = dialogue.crossings(tables, 0, last, dialogue.advance, dialogue.retreat)
        parts = ["".join(dialogue.edits_of(codes[cut * k:cut * (k + 1)], p, q)) for k, (p, q) in enumerate(zip(path, path[1:]))]
        assert "".join(parts) + "I" * dialogue.TAIL[last] == audit


def test_repair_of_tables(spark):
    prepare(spark)
    rng = random.Random(2)
    by_conv = {c: conversation(rng, rng.randint(1, 15)) for c in range(40)}
    by_conv[41] = conversation(rng, 700)  # many blocks
    by_conv[42] = [("user", "same.")] * 90  # one hot row
    by_conv[None] = [("user", "a."), ("assistant", "b.")]
    rows = []
    for c, turns in by_conv.items():
        for i, (r, t) in enumerate(turns):
            rows.append((c, None if i == 0 and c in (3, None) else 5 if c == 42 else 2 * i, r, t, "x", "y"))
    rows += [(43, 1, None, None, None, None), (43, 2, None, "x.", None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, c string, symbols string")
    expect = {c: expected(sorted(((n, r or " ", " " if t is None else t) for k, n, r, t, *_ in rows if k == c),
                                 key=lambda x: (x[0] is not None, x[0] or 0))) for c in {r[0] for r in rows}}
    fixed = dialogue.repair(table.repartition(5), block=16)
    totals = {r["conv_id"]: r.asDict() for r in fixed.totals.collect()}
    report = {r["conv_id"]: r.asDict() for r in dialogue.report(fixed).collect()}
    assert totals.keys() == report.keys() == expect.keys()
    for c, own in expect.items():
        assert {k: v for k, v in (totals[c] | report[c]).items() if k != "conv_id"} == own, c
    edits = fixed.edits.where("conv_id = 41").orderBy("place").collect()
    assert "".join(e["edit"] for e in edits) == expect[41]["audit"]
    assert [e["place"] for e in edits] == list(range(len(edits)))
    none = dialogue.repair(table.limit(0))
    assert none.totals.count() == none.edits.count() == dialogue.report(none).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, i + (i > 3), r, t) for c in range(80) for i, (r, t) in enumerate(conversation(rng, rng.randint(1, 8)))]
    rows += [(100, None, "user", None), (101, 7, None, "a."), (102, 1, "user", "What? Yes. No"), (None, 1, "user", "a.")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r["conv_id"]: r.asDict() for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    kinds = set()
    for c in {r[0] for r in rows}:
        left = []
        for k, n, r, t in rows:
            if k != c:
                continue
            kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if n is None else n}".encode()) % 20
            kinds.add(kind)
            r, t = " " if r is None else r, " " if t is None else t
            t = "" if kind == 1 else "".join(x for x in t if x not in ".!?") if kind == 2 else t
            left += [(n, "user" if kind == 4 else r, t)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        if left:
            own = expected(left)
        else:
            own = dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0)
            own |= {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        assert out[c] == {"conv_id": c, **own}
    assert {0, 1, 2, 3, 4} <= kinds
    assert len(out) == len({r[0] for r in rows})
