"""The mix of sources, the trie of conversation prefixes and the repair of conversations, against plain loops."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from jobmill.llm import mixing, repair, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"
CLASHING = TURNS + ", place int, n int, digest string, level int, kind int, words string, heads int"


def clashing(rows):
    return [(*r, 1, 2, "x", 3, 4, "y", 5) for r in rows]


# ------------------------------------------------------------------ mixing


def shared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing what is over again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        rest = {s: w for s, w in weight.items() if s not in capped}
        each = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s, t in each.items() if t > most * sizes[s]]
        if not over:
            return capped | each
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def documents(n, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, None, 7]), rng.choice(["", "a", "  \n", "b " * rng.randint(1, 400), "wort " * rng.randint(0, 30), None]),
             rng.choice(["x", "x", "x", "x", "", "é", "z", "Z", "\U0001f600", None])) for i in range(n)]
    return rows + [(900, "lang " * 5000, "long"), (901, None, "hollow"), (902, " ", "hollow")]


ODD = "doc_id long, text string, source string, s int, size string, key int, block string, words double, shard int"


def test_mix_meets_its_targets(spark):
    rows = documents(300)
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 0.5, 3) for r in rows], ODD)
    got = mixing.mixed_documents(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i if i is not None else -1, size(t)) for i, t, _ in rows) or \
        sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = shared(sizes)
    assert sorted((round(r.target, 6), r.source_size) for r in got) == sorted((round(targets[s], 6), sizes[s]) for _, _, s in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    placed, sources = mixing.placed_documents(docs)
    pieces = mixing.mixed_pieces(placed, sources).collect()
    taken = {}
    for p in pieces:
        taken[p.source] = taken.get(p.source, 0) + p.length
    assert all(abs(taken.get(s, 0) - t) <= 0.5 for s, t in targets.items())
    assert sum(r.taken for r in got) == sum(taken.values())
    again = mixing.mixed_documents(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert len({(p.shard, p.place) for p in pieces}) == len(pieces)


def test_every_block_is_in_one_shard_and_its_words_too(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, targets = mixing.placed_documents(docs, weights=(1, 3), share=1.2)
    size = {r.s: (r.words, r.source_size) for r in targets.collect()}
    blocks = mixing.shard_blocks(targets, 16, 4).collect()
    want = {(s, b) for s, (words, _) in size.items() for b in range(math.ceil(words / 16))}
    assert {(r.s, r.block) for r in blocks} == want and len(blocks) == len(want)
    counts = [sum(r.shard == k for r in blocks) for k in range(math.ceil(len(want) / 4))]
    assert counts[:-1] == [4] * (len(counts) - 1) and 0 < counts[-1] <= 4
    pieces = mixing.mixed_pieces(placed, targets, 16, 4).collect()
    per = {}
    for p in pieces:
        per[p.s, p.nth] = per.get((p.s, p.nth), 0) + p.length
        assert 0 <= p.offset < p.offset + p.length
    whole = {(r.s, r.nth): (r.start, r.size) for r in placed.collect()}
    for key, (start, words) in whole.items():
        used, own = size[key[0]]
        overlap = sum(max(0, min(start + k * own + words, used) - (start + k * own)) for k in range(3))
        assert per.get(key, 0) == overlap
    tape = {}
    for s, nth in sorted(whole):
        assert nth == tape.get((s, "n"), 0) + 1 and whole[s, nth][0] == tape.get((s, "w"), 0)  # a tape without gaps
        tape[s, "n"], tape[s, "w"] = nth, whole[s, nth][0] + whole[s, nth][1]


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_documents(empty).collect() == []
    hollow = spark.createDataFrame([(1, None, None), (2, " ", "a"), (2, " ", "a")], empty.schema)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mixed_documents(hollow).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_draws_have_the_hypergeometric_distribution():
    rng = np.random.default_rng(1)
    for good, bad, take in ((30, 50, 20), (5, 1000, 400), (1000, 3, 500), (1, 1, 1), (7, 0, 3)):
        got = np.array([mixing.drawn(rng, good, bad, take) for _ in range(3000)])
        mean = take * good / (good + bad)
        assert got.min() >= max(0, take - bad) and got.max() <= min(good, take)
        spread = math.sqrt(take * good / (good + bad) * bad / (good + bad) * (good + bad - take) / max(1, good + bad - 1))
        assert abs(got.mean() - mean) <= 0.1 * spread + 1e-9 and abs(got.std() - spread) <= 0.1 * spread + 1e-9
    huge = [mixing.drawn(rng, 6 * 10**12, 10**13, 8 * 10**12) for _ in range(20)]
    assert all(abs(x - 3 * 10**12) < 2 * 10**7 for x in huge) and len(set(huge)) > 10
    for quota in (np.array([3, 0, 5, 1]), np.array([3 * 10**9, 0, 10**10, 17])):
        for take in (0, 1, int(quota.sum()) // 2, int(quota.sum())):
            left = mixing.split_quota(rng, quota, take)
            assert left.sum() == take and (left >= 0).all() and (left <= quota).all()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000])
def test_permutation_is_one(size):
    got = mixing.permuted(np.arange(size), size, 7, 3)
    assert sorted(got.tolist()) == list(range(size))
    assert size < 64 or got.tolist() != mixing.permuted(np.arange(size), size, 8, 3).tolist()


# ------------------------------------------------------------------ trie


def plain_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[:len(key)] == key]
        kids = lambda k: sum(len(x) == len(k) + 1 and x[:len(k)] == k for x in below)  # noqa: B023, E731
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(key)))
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), kids(key), sum(kids(k) == 0 for k in below),
                    sum((len(members[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(df, **options):
    return sorted([tuple(r) for r in trie.prefix_trie(df, **options).collect()], key=str)


def conversations(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * rng.choice([1, 1, 3]), rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["a b", "a b", "c", "", None, "x y z. "])))
    return rows + [(500, t, "user", "same words here") for t in range(60)] + [(c, 0, "user", "hot start") for c in range(600, 640)] + [(None, 1, "user", "no conversation")]


@pytest.mark.parametrize("options", [{}, {"limit": 4, "step": 3, "nodes_per_task": 10}])
def test_trie_matches_plain_loop(spark, options):
    rows = conversations(60)
    df = spark.createDataFrame(clashing(rows), CLASHING)
    assert found_trie(df, **options) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CLASHING)).collect() == []
    lone = [(4, None, None, None)]
    assert found_trie(spark.createDataFrame(lone, TURNS)) == plain_trie(lone)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 100, 5000):
        keys = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        keys[: n // 4, 0] = 7  # equal first words
        table = trie.SlotTable(keys)
        assert sorted(table.slots.tolist()) == list(range(n)) and (table.find(keys) == table.slots).all()
        foreign = keys.copy()
        foreign[:, 3] ^= np.uint64(1)
        assert (table.find(foreign) == -1).all()
    with pytest.raises(ValueError):
        trie.SlotTable(np.zeros((2, 4), np.uint64))


# ------------------------------------------------------------------ repair


def plain_damage(rows):
    """Per conversation the damaged rows (turn, role, text), sorted."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in convs.items()}


def plain_repair(rows):
    """All ways to edit a short conversation, tried one by one."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    options = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        extra = 3 if fault == "truncated" else 0
        edits = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            edits += [("K", extra, (role, text)), ("R", 3 + extra, ("user", text)), ("R", 3 + extra, ("assistant", text))]
        options.append(edits)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for choice in itertools.product(*options):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            items, audit, cost = [], "", 0
            for i, roles in enumerate(added):
                for role in roles:
                    items, audit, cost = [*items, (role, "")], audit + "I", cost + 3
                if i < len(rows):
                    letter, price, kept = choice[i]
                    audit, cost = audit + letter, cost + price
                    items += [kept] if kept else []
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in items)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in items))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def test_repair_matches_trying_everything(spark):
    rng = random.Random(8)
    rows = []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3])):
            rows.append((rng.choice([c, c, c, None]) if c > 140 else c, rng.choice([t, t, t * 2, None]), rng.choice(["user", "assistant", "system", "tool", "user", "assistant", None, ""]),
                         rng.choice(["Hi.", "What?", "cut", "no end ", "Hi.", "\t", None, "a. "])))
    rows = [r for r in rows if r[0] is not None] + [(None, 0, "user", "Hm."), (None, 1, "assistant", "So.")]
    damaged = {c: v for c, v in plain_damage(rows).items() if len(v) <= 4}
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(repair.damaged(spark.createDataFrame(clashing(rows), CLASHING))).collect()}
    assert set(got) == set(plain_damage(rows)) and len(damaged) > 140
    for conv, own in damaged.items():
        assert got[conv] == plain_repair(own), (conv, own)


def test_repair_of_long_and_empty_conversations(spark):
    assert repair.repaired(repair.damaged(spark.createDataFrame([], CLASHING))).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repaired(repair.damaged(spark.createDataFrame([(dropped, 0, "user", "x")], TURNS))).collect()
    assert [tuple(r) for r in row] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(30_000)] + [(2, 0, "user", "w " * 100_000 + "."), (2, 1, "assistant", "Yes.")]
    got = {r.conv_id: r for r in repair.repaired(spark.createDataFrame(long, TURNS)).collect()}
    assert (got[1].cost, got[1].audit) == (0, "K" * 30_000) and (got[2].cost, got[2].audit) == (0, "KK")
    text = "\n".join(f"{r}:{t}" for _, _, r, t in long[:30_000])
    assert got[1].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
