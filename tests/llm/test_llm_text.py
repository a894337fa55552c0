"""License scan, repeated strings, near duplicates and quality rules against plain loops."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark import Broadcast
from pyspark.sql import functions as F

from jobmill.llm import jaccard, licenses, quality, repeats
from jobmill.llm.components import components

ODD = "doc_id long, text string, lang string, source string, n_chars long, pos int, rep string, template string, bits double"
SCHEMA = "doc_id long, text string"


def odd_rows(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y", 0.5) for i, t in rows], ODD)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_licenses_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(licenses.SQL)
    names = [d[0] for d in cursor.description]
    mine = licenses.op1_licenses(spark, sf_dir)
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in mine.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_license_places_and_odd_rows(spark):
    long = "w " * 30_000 + "MIT License"
    rows = [(1, None), (2, ""), (None, "mit license"), (4, "cc by cc by-cc"), (4, "cc by cc by-cc"), (5, long), (6, "GNU  General\nPublic-License of the Apache License"),
            (7, "Permission is hereby granted, free of charge, to any persons obtaining a copy of this software and associated documentation files"), (8, "mit licenses ünd mit"), (9, "license")]
    got = [r.asDict() for r in licenses.scan_licenses(odd_rows(spark, rows))[0].collect()]
    assert len(got) == len(rows)
    for row in got:
        text = next(t for i, t in rows if i == row["doc_id"])
        w = words(text)
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        assert (row["n_words"], row["n_base"]) == (len(w), len(places))
        assert (row["first_word"], row["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in places})) and set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1
    assert next(r["labels"] for r in got if r["doc_id"] == 7) == "mit"  # one word differs, so the diagonal holds
    spans = licenses.scan_licenses(odd_rows(spark, rows))[1].where("doc_id = 7").collect()
    assert len(spans) == 1 and 0.8 <= spans[0].coverage < 1
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA))[0].collect() == []


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(raw[p:p + length])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def random_texts(seed, n):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcé \n") for _ in range(600))
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            a = rnd.randint(0, 500)
            parts.append(base[a:a + rnd.randint(1, 90)] if rnd.random() < 0.6 else "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 40))))
        rows.append((rnd.randint(0, 10**6) * 200 + i, "".join(parts)))
    return [*rows, (7, None), (9, ""), (11, "a" * 500), (13, "ab" * 300), (15, "a" * 300)]


@pytest.mark.parametrize(("gram", "options"), [(6, {}), (6, {"sample": 1, "hot_contexts": 3}), (20, {})])
def test_repeats_match_plain_loop(spark, gram, options):
    rows = random_texts(gram, 120)
    got = repeats.remove_repeats(odd_rows(spark, rows).repartition(5), 20, gram, **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, 20)


def test_repeats_stream_over_many_shards(spark, monkeypatch):
    """A shard far larger than what is sorted at once gives the same spans."""
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 101, 4000, dtype=np.uint8))
    rows = [(i, base[a:a + n].decode()) for i, (a, n) in enumerate(zip(rng.integers(0, 3800, 60).tolist(), rng.integers(10, 200, 60).tolist(), strict=True))]
    monkeypatch.setattr(repeats, "SHARD_ROWS", 7)
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), 20, 6).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, 20)


def test_repeats_of_repeated_and_missing_ids(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    got = repeats.remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 300), (1, 300), (2, 0)]
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = repeats.without_repeats(odd_rows(spark, [(1, text), (2, text + "é tail"), (3, text), (4, None), (5, "")]))
    assert kept.columns == odd_rows(spark, [(1, "")]).columns
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {1: (text, 300), 2: ("é tail", 6), 4: (None, None), 5: ("", 0)}


def brute_links(rows, least):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-ZÀ-Þ]", lambda m: chr(ord(m[0]) + 32), text or ""))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= least * (len(sets[a]) + len(sets[b]) - both):
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    return {i: (first[s] if s else i, find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize("block", [256, 5])
def test_near_duplicates_match_all_pairs(spark, block):
    rnd, rows = random.Random(4), []
    for family in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 30, 80, 200]))]
        for copy in range(rnd.choice([1, 2, 9, 25])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 99)}"
            rows.append((family * 1000 + copy, ("Ä " if copy % 2 else "") + " ".join(w)))
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "A b"), (10**6 + 3, "a, B"), (10**6 + 4, "...")]
    got = jaccard.near_duplicates(odd_rows(spark, rows).repartition(4), block=block).collect()
    assert {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in got} == brute_links(rows, 0.8)


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = jaccard.near_duplicates(spark.createDataFrame([(1, text), (1, text), (None, text), (2, "other words")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in got) == [(-1, 2), (1, 2), (1, 2), (2, 0)]
    left = jaccard.one_of_each_group(odd_rows(spark, [(1, text), (2, text + " more"), (3, "quite another text"), (4, None)]))
    assert {r.doc_id for r in left.collect()} == {1, 3, 4} and left.columns == odd_rows(spark, [(1, "")]).columns


def test_prefix_is_shortened_until_the_recall_is_met():
    length = jaccard.prefix_length()
    met = lambda k: 1 - (1 - 0.8 ** k) ** jaccard.TREES
    assert met(length) >= jaccard.TARGET > met(length + 1)


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 202), (202, 203), (203, 201), (300, 300)]
    random.Random(0).shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {201: 201, 202: 201, 203: 201}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_facts(text):
    w, where = re.findall(r"[^\x20\x09-\x0D]+", text or ""), {}
    for k in range(len(w) - 2):
        where.setdefault(tuple(w[k:k + 3]), []).append(k)
    again = {j for v in where.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
    seen, doubles = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), doubles, len(again)


def test_quality_facts_match_plain_loop(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b c a b c\n\n \nx\nx\nx\n"), (10**6 + 3, "\n"), (10**6 + 4, "a a a a"), (None, "é\x00 é\x0b x $%"), (10**6 + 5, "z " * 30_000)]
    got = quality.judge(odd_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        facts = brute_facts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == facts
        assert r.base_failed == (facts[0] < 50 or 100 * facts[4] > 50 * facts[0]) and not (r.base_failed and r.kept)
    assert quality.judge(spark.createDataFrame([], ODD)).collect() == []


def test_kneser_ney_is_a_distribution_and_matches_the_formula():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, quality.CODES, 3000))
    counts = rng.integers(1, 6, len(grams)).astype(float)
    p = np.exp2(-quality.kneser_ney(grams, counts).astype(float)).reshape(-1, quality.UNITS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    n = [max((counts == k).sum(), 0.5) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) for k in (1, 2, 3)]
    table = dict(zip(grams.tolist(), counts.tolist(), strict=True))
    gram = grams[7]
    context = [table[g] for g in range(gram & ~31, (gram & ~31) + 32) if g in table]
    gamma = sum(d[min(int(c), 3)] for c in context) / sum(context)
    lower = {}
    for g in table:
        lower[g & 32767] = lower.get(g & 32767, 0) + 1
    empty = quality.kneser_ney(np.empty(0, int), np.empty(0))
    assert np.allclose(empty, 5)
    top = (table[gram] - d[min(int(table[gram]), 3)]) / sum(context)
    assert top < p.ravel()[gram] < top + gamma


def test_bands_reject_noise_and_keep_prose(spark, sf_dir):
    rnd = random.Random(2)
    noise = [(10**6 + i, " ".join("".join(rnd.choice("bcdfgjkqvwxz0123456789#;") for _ in range(rnd.randint(2, 9))) for _ in range(200)), "en", "s", 0) for i in range(1)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = docs.union(spark.createDataFrame(noise, docs.schema))
    got = {r.doc_id: r for r in quality.judge(both).collect()}
    assert all(not got[i].base_failed and not got[i].kept for i, *_ in noise)
    assert sum(r.kept for r in got.values()) >= 0.99 * sum(not r.base_failed for r in got.values()) - 1
    assert {r.doc_id for r in quality.accepted(both).collect()} == {i for i, r in got.items() if r.kept}


def test_both_bands_decide_and_mixed_languages_stay(spark):
    rnd = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prose = {}
    for r in docs.select("text", "lang").orderBy("doc_id").collect():
        words = (r.text or "").split()[:100]
        if len(words) == 100 and brute_facts(" ".join(words))[4] < 10 and not set(r.text) & set("|#*$%&"):
            prose.setdefault(r.lang, []).append(" ".join(words))
    made = lambda n, lo, hi, letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(lo, hi))) for _ in range(n))
    noise = [" ".join(rnd.choice("the of and in to is a that it for".split()) for _ in range(200)), made(150, 2, 8, [chr(c) for c in range(0x430, 0x450)]), made(150, 2, 5, [chr(c) for c in range(0x4E00, 0x9FA0)])]
    noise += [made(200, 2, 9, "abcdefghijklmnopqrstuvwxyz"), made(200, 2, 7, "aeio")]
    mixed = [(prose[a][i] + "\n" + prose[b][i], b) for a, b in (("en", "fr"), ("en", "de"), ("de", "es"), ("fr", "de")) for i in range(3)]
    mixed += [(prose["en"][4] + "\n" + prose["de"][4] + "\n" + prose["es"][4], "fr"), (prose["en"][5], "de")]
    texts = [(t, "en") for t in noise] + mixed
    both = docs.union(spark.createDataFrame([(10**6 + i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(texts)], docs.schema))
    got = {r.doc_id - 10**6: r for r in quality.judge(both).where("doc_id >= 1000000").collect()}
    usual = {r.lang: r.q for r in quality.judge(docs).join(docs.select("doc_id", "lang"), "doc_id").where("kept").groupBy("lang").agg(F.expr("percentile(bits, 0.5)").alias("q")).collect()}
    assert not any(got[i].base_failed for i in got)
    assert not any(got[i].kept for i in range(5)) and got[0].bits < usual["en"] < min(got[3].bits, got[4].bits)
    assert all(got[i].kept for i in range(5, len(texts)))


def plain_notices(text, phrases=licenses.PHRASES, notices=licenses.NOTICES):
    """Labels and best coverage by the rule of the scan, with plain loops over the diagonals that a pair votes for."""
    w = [x for x in re.split(licenses.SEPARATORS, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if x]
    labels, best = {label for phrase, label in phrases for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()}, 0.0
    best = 1.0 if labels else 0.0
    for notice, label, needed in notices:
        t = notice.split()
        for diagonal in sorted({p - i for p in range(len(w) - 1) for i in range(len(t) - 1) if w[p:p + 2] == t[i:i + 2]}):
            at, covered = -1, {}
            for i in range(len(t) - 1):
                places = [p for p in range(i + diagonal - 2, i + diagonal + 3) if 0 <= p < len(w) - 1 and w[p:p + 2] == t[i:i + 2] and p > at]
                if places:
                    at = places[0]
                    covered |= {i: t[i], i + 1: t[i + 1]}
                    covered[("pair", i)] = f"{t[i]} {t[i + 1]}"
            n, pairs = sum(isinstance(k, int) for k in covered), [v for k, v in covered.items() if not isinstance(k, int)]
            if n / len(t) >= licenses.LEAST_COVERAGE and set(needed) <= set(pairs):
                labels.add(label)
                best = max(best, n / len(t))
    return ",".join(sorted(labels)), best


NEAR_MISSES = [
    ("This text is licensed under CC BY 4.0.", "cc-by,cc-by-4.0"), ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), ("licensed under CC BY-SA 4.0", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ""),
    ("This work is licensed under the GNU General Public License version 2", "gpl,gpl-2.0"), ("This work is licensed under the GNU General Public License version 3", "gpl,gpl-3.0"),
    ("This work is licensed under the GNU Lesser General Public License version 3", ""), ("Licensed under the Apache License, Version 1.1", "apache"),
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("released under the BSD license", ""), ("subject to the terms of the Mozilla Public License, v. 1.1", ""),
    ("license mit the under released", ""), ("of the of the of the of the " * 50, ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("redistribution and use in the source and binary forms, with or without any modification are permitted provided that the following conditions are met", "bsd")]


def test_near_misses_carry_no_false_label(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(odd_rows(spark, [(i, t) for i, (t, _) in enumerate(NEAR_MISSES)]))[0].collect()}
    for i, (text, labels) in enumerate(NEAR_MISSES):
        assert got[i].labels == labels, text
        assert (got[i].labels, round(got[i].score, 9)) == (plain_notices(text)[0], round(plain_notices(text)[1], 9))


def test_notices_match_plain_loops_on_damaged_texts(spark):
    rng = random.Random(11)
    vocabulary = sorted({w for t, *_ in (*licenses.PHRASES, *licenses.NOTICES) for w in t.split()})
    texts = []
    for _ in range(250):
        words = []
        for _ in range(rng.randint(1, 3)):
            notice = rng.choice(licenses.NOTICES)[0].split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(notice))
                notice = rng.choice([notice[:k] + notice[k + 1:], notice[:k] + [rng.choice(vocabulary)] + notice[k:], notice[:k] + [rng.choice(vocabulary)] + notice[k + 1:], notice[k:] + notice[:k]]) or ["x"]
            words += notice + rng.choices(vocabulary, k=rng.randint(0, 3))
        texts.append(" ".join(words))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan_licenses(odd_rows(spark, list(enumerate(texts))))[0].collect()}
    for i, text in enumerate(texts):
        labels, score = plain_notices(text)
        assert got[i] == (labels, round(score, 9)), text


def test_license_spans_stand_where_the_notice_stands(spark):
    notice = licenses.NOTICES[2][0]
    text = "One two three. " + notice + " and more. " * 3 + notice.replace("redistribute", "copy")
    spans = sorted((r.first_word, r.last_word, r.label, r.coverage) for r in licenses.scan_licenses(odd_rows(spark, [(1, text)]))[1].where("NOT is_phrase").collect())
    n = len(notice.split())
    assert [s[:3] for s in spans] == [(3, n + 2, "gpl"), (n + 9, 2 * n + 8, "gpl")] and spans[0][3] == 1.0 and 0.9 < spans[1][3] < 1.0


def test_shuffled_words_are_rejected_and_the_bands_follow_from_the_scores(spark):
    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shuffled = []
    for r in docs.where("doc_id % 200 = 0 AND text IS NOT NULL").collect():
        words = r.text.split()
        if len(words) >= 80:
            rng.shuffle(words)
            shuffled.append((10**7 + r.doc_id, " ".join(words), r.lang, r.source, r.n_chars))
    both = docs.union(spark.createDataFrame(shuffled, docs.schema))
    got = quality.judge(both).join(both.select("doc_id", "lang"), "doc_id").collect()
    fair = [r for r in got if not r.base_failed]
    bad = [r for r in fair if r.doc_id >= 10**7]
    assert len(bad) > 35 and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    clean = [r for r in fair if r.doc_id in good]
    assert len(clean) > 500 and sum(r.kept for r in clean) >= 0.97 * len(clean)
    for lang in {r.lang for r in fair}:
        own = np.sort([r.bits for r in fair if r.lang == lang])
        q = [own[max(0, int(np.ceil(p * len(own))) - 1)] for p in (0.16, 0.5, 0.84)]
        slack = quality.FEW_BITS / len(own)
        low, high = q[1] - max(quality.LEAST_BITS, quality.LOWER * (q[1] - q[0])) - slack, q[1] + max(quality.LEAST_BITS, quality.UPPER * (q[2] - q[1])) + slack
        edge = 2e-3 * (high - low)  # the marks are found to one part in 10,000
        for r in fair:
            if r.lang == lang and min(abs(r.bits - low), abs(r.bits - high)) > edge:
                assert r.kept == (low <= r.bits <= high)
    assert not any(r.kept for r in got if r.base_failed)


def test_ngrams_are_of_the_texts_as_they_are(spark):
    """Each 5-gram of UTF-16 units is itself: capitals, digits and letters of any script stay apart, and all of them are in the model."""
    texts = ["Aa 19", "aa 28", "жи ши", "是不是", "x\U0001F600y", "", None]
    pad = [f"    {t}".encode("utf-16-le") for t in texts if t]
    wanted = {(t[i:i + 10]) for t in pad for i in range(0, len(t) - 8, 2)}
    heads, codes, ends = quality.codes_of(*quality.utf8(pa.array(texts)))
    read = lambda h, c: int(h).to_bytes(2, "little") + b"".join(((int(c) >> (16 * k)) & 0xFFFF).to_bytes(2, "little") for k in (3, 2, 1, 0))
    assert {read(h, c) for h, c in zip(heads, codes)} == wanted and np.diff(ends).tolist() == [5, 5, 5, 3, 4, 0, 0]
    model = quality.train(odd_rows(spark, list(enumerate(texts))))
    assert {read(h, c) for arrays in model.arrays.values() for h, c in zip(*arrays[:2])} == wanted
    table = quality.Table(heads, codes, np.ones(len(codes)))
    assert np.isclose(table.probability(np.arange(1 << 16, dtype=np.uint64) | (codes[1] >> np.uint64(16) << np.uint64(16)), np.repeat(heads[1], 1 << 16)).sum(), 1, atol=1e-3)


def test_an_ngram_is_looked_up_once_a_task(spark, monkeypatch):
    """Later texts of a task find the bits that a model gave before, and they are those of a new lookup."""
    model = quality.train(odd_rows(spark, [(i, f"{w} the quick brown fox {i} jumps\nover the lazy dog {w}") for i, w in enumerate(("ab", "cd", "ef", "gh") * 5)]))
    looked, plain = [], quality.Model.bits
    monkeypatch.setattr(quality.Model, "bits", lambda self, lang, heads, codes: (looked.append(len(codes)), plain(self, lang, heads, codes))[1])
    batch = pa.array(["the lazy fox 7 jumps", None, "over the dog", ""] * 3), pa.array(["a:en", "b:en", "b:en", "a:xx"] * 3)
    first, again = quality.scored_facts(model, iter([batch, batch]))
    assert first == again and sum(looked) == len({(s, t[i:i + 5]) for t, s in (("    the lazy fox 7 jumps", "a"), ("    over the dog", "b")) for i in range(len(t) - 4)}) * len({m[2:] for m in model.typical})
    monkeypatch.setattr(quality, "TOLD_GRAMS", 0)
    assert list(quality.scored_facts(model, iter([batch]))) == [first]
    assert first.field("n_words").to_pylist()[:4] == [5, 0, 3, 0] and first.field("bits").is_null().to_pylist()[:4] == [False, True, False, True]
    model.drop()


def test_the_driver_takes_one_language_at_a_time(spark, monkeypatch):
    """No result on the driver has the n-grams of more than one language's half, and what goes to the tasks are broadcasts."""
    taken, plain = [], type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: (taken.append(plain(self)), taken[-1])[1])
    rows = [(i, f"text {i} of {lang} " * 3, lang, "s", 0) for i in range(12) for lang in ("en", "de", None)]
    docs = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    model = quality.train(docs)
    sizes = {name: len(codes) for name, (_, codes, _) in model.arrays.items()}
    assert set(sizes) == {s + x for s in ("a:", "b:") for x in ("en", "de", "und")} and max(t.num_rows for t in taken) == max(sizes.values())
    state = model.__getstate__()
    assert state["counts"] is None and all(isinstance(t, Broadcast) for t in state["tables"].values())
    assert all(len(t.value.top[0]) == sizes[name] for name, t in state["tables"].items())
    model.drop()
