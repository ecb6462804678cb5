import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, line_dedup, minhash, queries, substring_dedup

# --- exact ---


def test_exact(docs, texts):
    found = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    for i, t in texts.items():
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[t]), len(groups[t]), i == max(groups[t]))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("counters", [1, 3, 1000])
def test_heavy_split_does_not_change_results(spark, counters):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}" if i % 3 == 1 else f"u{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df, counters=counters).collect()}
    largest, counts = {}, Counter(t for _, t in rows)
    for i, t in rows:
        largest[t] = max(i, largest.get(t, -1))
    assert found == {i: (largest[t], counts[t]) for i, t in rows}
    assert exact_dedup.drop_copies(df, counters=counters).count() == len(counts)


def test_misra_gries_keeps_heavy_keys():
    rng = np.random.default_rng(1)
    parts = [Counter(rng.choice(["hot"] * 30 + [str(k) for k in range(70)], 500).tolist()) for _ in range(20)]
    total, counts = sum(parts, Counter()), {}
    for p in parts:
        counts = exact_dedup.merge_summaries(counts, p, 5)
        assert len(counts) <= 5
    assert total["hot"] - sum(total.values()) / 6 <= counts["hot"] <= total["hot"]


def test_exact_odd(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == 10
    plain = [r for r in rows if r["group_size"] == 3]
    assert {r["keep_id"] for r in plain} == {5} and sum(r["kept"] for r in plain) == 1
    blank = [r for r in rows if r["doc_id"] in (2, 3)]
    assert {r["keep_id"] for r in blank} == {3} and {r["group_size"] for r in blank} == {2}
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


# --- near ---


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return set() if not words else {tuple(words)} if len(words) < 5 else set(zip(*(words[k:] for k in range(5)), strict=False))


def components(rows):
    """Brute force over all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent, index = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in index[s]).items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near(docs, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == components(texts.items())


def test_near_groups_of_edited_copies(spark):
    """Copies with none to many edits: chains of links, isolated variants, and pairs just below the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for k in rng.choice(150, rng.integers(0, 9), replace=False):
            words[k] = f"x{rng.integers(0, 400)}"
        rows.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = components(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert found == expected
    kept = {r["doc_id"] for r in minhash.drop_near_duplicates(df).collect()}
    assert kept == {i for i, x in expected.items() if x[2]}


def test_crowded_buckets_meet_by_prefixes(spark, monkeypatch):
    """Without pivots and with every bucket crowded, prefixes find the same links."""
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(minhash, "PAIRS_PER_ROW", 0)
    rng = np.random.default_rng(8)
    rows = []
    for family in range(6):
        base = [f"w{family}_{k}" for k in range(90)]
        for i in range(30):
            words = list(base)
            for k in rng.choice(90, rng.integers(0, 6), replace=False):
                words[k] = f"x{rng.integers(0, 300)}"
            rows.append((10 * i + family, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()} == components(rows)


def test_near_copies_without_an_id(spark):
    words = [f"w{k}" for k in range(80)]
    rows = [(None, " ".join(words)), (7, " ".join([*words[:-1], "x"])), (9, " ".join(words)), (None, "another text without an id"), (3, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (0, 7, False), (3, 3, True), (7, 7, True), (9, 7, False)]
    assert minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_long_texts_are_split_at_white_space():
    text = b" ".join(b"w%d" % k for k in range(3000)) + b"\n\t" + b"x" * 500
    assert [w for p in minhash.pieces(text, 64) for w in p.split()] == text.split()
    known = minhash.WordHashes()
    whole = minhash.shingles([text], known)
    minhash.PIECE, kept = 64, minhash.PIECE
    try:
        assert (minhash.shingles([text], known)[0] == whole[0]).all()
    finally:
        minhash.PIECE = kept


def test_connect_chains(spark):
    rng = np.random.default_rng(2)
    path = rng.permutation(300).tolist()
    edges = list(zip(path[:-1], path[1:], strict=True)) + [(1000, 1001), (1001, 1002)]
    found = {r["node"]: r["root"] for r in minhash.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(300)) and found[1002] == 1000


def test_signatures_estimate_similarity():
    values = minhash.mix(np.arange(2000, dtype=np.uint64))
    a, b = np.sort(values[:1500]), np.sort(values[300:1800])  # 1200 of 1800 shared
    s = minhash.signatures(np.r_[a, b], np.array([1500, 1500]), 400)
    assert abs((s[0] == s[1]).mean() - 1200 / 1800) < 0.06


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for n in (3, 50, 400):
        a, b = (np.unique(rng.integers(0, 3 * n, n).astype(np.uint64) * np.uint64(2654435761)) for _ in range(2))
        p = minhash.parities(np.r_[a, b], np.array([len(a), len(b)]))
        bits = sum(int(x).bit_count() for x in (p[0] ^ p[1]).view(np.uint64).tolist())
        assert bits <= len(np.setxor1d(a, b))


def test_near_odd(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[6]["n_shingles"] == 0
    assert by_id[2]["component_id"] == 2 and by_id[3]["kept"]
    assert by_id[5]["component_id"] == 1 and sum(r["kept"] for r in rows if r["component_id"] == 1) == 1
    assert by_id[7]["n_shingles"] == 1
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


# --- substrings ---


def gear_loop(text):
    reach, cuts, now, ends, h = substring_dedup.REACH, [], 0, [], 0
    for k, b in enumerate(bytes(reach) + text):
        h = (h << 1) + int(substring_dedup.GEAR[b]) & (1 << reach) - 1
        if h >> reach - substring_dedup.BITS == 0 and reach <= k < len(text) + reach - 1:
            cuts.append(k + 1 - reach)
    for cut in [*cuts, len(text)]:
        while cut - now > substring_dedup.MOST:
            now += substring_dedup.MOST
            ends.append(now)
        if cut == len(text):
            if cut > now:
                ends.append(cut)
        elif cut - now >= substring_dedup.LEAST:
            ends.append(cut)
            now = cut
    return ends


def test_chunks_equal_a_rolling_loop(texts):
    some = [t.encode() for t in list(texts.values())[:40]] + [b"", b"a", b"a" * 1000]
    assert substring_dedup.chunk_ends(some) == [gear_loop(t) for t in some]
    assert substring_dedup.chunk_ends([]) == []


def test_chunks_resist_shifts():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 123, 20000).astype(np.uint8))
    parts = lambda t: {t[a:b] for e in substring_dedup.chunk_ends([t]) for a, b in zip([0, *e[:-1]], e, strict=True)}
    assert len(parts(text) - parts(b"inserted" + text)) <= 3


def test_substrings_equal_brute_force(docs, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    cut = {i: gear_loop(t) for i, t in raw.items()}
    owners = defaultdict(set)
    for i, ends in cut.items():
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            owners[raw[i][a:b]].add(i)
    for r in substring_dedup.substring_dedup(docs).collect():
        i, spans, gone = r["doc_id"], [], []
        for a, b in zip([0, *cut[i][:-1]], cut[i], strict=True):
            mine = owners[raw[i][a:b]]
            if len(mine) > 1:
                spans = [*spans[:-1], (spans[-1][0], b)] if spans and spans[-1][1] == a else [*spans, (a, b)]
                gone += [(a, b)] if i != min(mine) else []
        spans = [s for s in spans if s[1] - s[0] >= substring_dedup.MIN_RUN]
        gone = [g for g in gone if any(a <= g[0] < b for a, b in spans)]
        assert [(s["start"], s["end"]) for s in r["repeats"]] == spans
        left, at = b"", 0
        merged = []
        for a, b in gone:
            merged = [*merged[:-1], (merged[-1][0], b)] if merged and merged[-1][1] == a else [*merged, (a, b)]
        for a, b in (substring_dedup.whole_characters(raw[i], *g) for g in merged):
            left, at = left + raw[i][at:a], b
        assert r["clean_text"].encode() == left + raw[i][at:]


def test_planted_passages_go(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(100)) + " " + (passage if i < 10 else "") + " " + " ".join(word() for _ in range(80))) for i in range(40)]
    found = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in found.items() if r["has_repeats"]} == set(range(10))
    assert found[0]["removed_bytes"] == 0 and all(found[i]["removed_bytes"] > 128 for i in range(1, 10))
    assert all(found[i]["clean_text"] == rows[i][1] for i in range(10, 40))


@pytest.mark.parametrize("n", [51, 55, 60])
def test_short_passages_are_found(spark, n):
    """Passages of just over 50 words between different neighbours, each in two documents."""
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 9)))
    some = lambda least, most: " ".join(word() for _ in range(rng.integers(least, most)))
    rows = []
    for k in range(200):
        passage = " ".join(word() for _ in range(n))
        rows += [(i, f"{some(5, 90)} {passage} {some(5, 90)}") for i in (k, 1000 + k)]
    rows += [(5000 + k, some(60, 200)) for k in range(200)]
    found = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i]["has_repeats"] for i in range(200)) >= 199
    assert sum(found[1000 + i]["removed_bytes"] > 0 for i in range(200)) >= 199
    assert not any(r["has_repeats"] for i, r in found.items() if i >= 5000)


@pytest.mark.parametrize("counters", [1, 20, 5000])
def test_heavy_chunks_do_not_change_results(spark, docs, counters):
    columns = ["doc_id", "repeat_bytes", "removed_bytes", "clean_text"]
    some = docs.select("doc_id", "text").repartition(5)
    found = substring_dedup.substring_dedup(some, counters=counters).select(*columns).collect()
    assert sorted(found) == sorted(substring_dedup.substring_dedup(docs, counters=1 << 30).select(*columns).collect())


def test_misra_gries_over_arrays():
    rng = np.random.default_rng(9)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    everything = np.where(rng.random(20000) < 0.3, 7, rng.integers(0, 5000, 20000))
    for part in np.split(everything, 20):
        keys, counts = substring_dedup.merge_counts(np.r_[keys, part], np.r_[counts, np.ones(len(part), np.int64)], 9)
        assert len(keys) <= 9
    true = int((everything == 7).sum())
    assert true - 20000 / 10 <= counts[keys == 7][0] <= true


def test_substrings_odd(spark, odd, empty):
    rows = substring_dedup.substring_dedup(odd).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] != 5}
    assert len(rows) == 10 and all(by_id[i]["n_bytes"] == by_id[i]["n_chunks"] == 0 and by_id[i]["clean_text"] == "" for i in (2, 3))
    assert not by_id[4]["has_repeats"] and by_id[4]["clean_text"].startswith("word and other")  # repeats itself only
    assert by_id[None]["clean_text"] == "without an id" and by_id[8]["clean_text"].startswith("ünïcödé")
    assert substring_dedup.substring_dedup(empty).count() == 0
    text = "é".encode()
    assert substring_dedup.whole_characters(text * 2, 1, 3) == (2, 2)
    # Repeated rows with and without an id: the first of them stays whole.
    same = " ".join(f"word{k}" for k in range(60))
    found = substring_dedup.substring_dedup(spark.createDataFrame([(3, same), (3, same), (None, same)], "doc_id long, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["removed_bytes"]) for r in found if not r["removed_bytes"]] == [(3, 0)]
    assert sorted(r["removed_bytes"] for r in found) == [0, len(same), len(same)]


# --- lines ---


def test_lines_equal_brute_force(docs, texts):
    places = defaultdict(list)
    for i, t in texts.items():
        for a, _, c in line_dedup.candidates(t.encode().split(b"\n")):
            places[c].append((i, a))
    gone = {p for found in places.values() for p in sorted(found)[1:]}
    for r in line_dedup.line_dedup(docs).collect():
        i = r["doc_id"]
        lines = texts[i].split("\n")
        spans = [(a, b) for a, b in line_dedup.line_chunks(texts[i].encode().split(b"\n")) if (i, a) in gone]
        assert [(s["start"], s["end"]) for s in r["removed"]] == spans
        assert r["clean_text"] == "\n".join(x for k, x in enumerate(lines) if not any(a <= k < b for a, b in spans))


def test_line_chunks_resist_shifts():
    lines = [f"line {k}".encode() for k in range(300)]
    cut = lambda x: {b"\n".join(x[a:b]) for a, b in line_dedup.line_chunks(x)}
    assert len(cut(lines) - cut([b"new", *lines])) <= 3
    assert all(b - a <= line_dedup.MOST for a, b in line_dedup.line_chunks([b"same"] * 100))


def repeated_runs(rows):
    """Places of lines in pairs of adjacent lines that stand at an earlier place, by brute force."""
    first, gone = {}, set()
    for i, t in sorted(rows):
        lines = t.split("\n")
        for k in range(len(lines) - 1):
            if first.setdefault((lines[k], lines[k + 1]), (i, k)) != (i, k):
                gone |= {(i, k), (i, k + 1)}
    return gone


def test_planted_line_runs_go(spark):
    """Runs of 2 to 9 lines in unrelated documents: all lines of the later copy go, no others."""
    rng = np.random.default_rng(11)
    line = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(7))
    rows, expected = [], {}
    for n in range(200):
        run = [line() for _ in range(2 + n % 8)]
        for i in (n, 1000 + n):
            before, after = ([line() for _ in range(rng.integers(0, 6))] for _ in "ab")
            rows.append((i, "\n".join([*before, *run, *after])))
            expected[i] = "\n".join([*before, *run, *after] if i < 1000 else [*before, *after])
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["clean_text"] for i, r in found.items()} == expected
    assert all(found[1000 + n]["removed_lines"] == 2 + n % 8 for n in range(200))


def test_all_repeated_line_runs_go(docs, texts):
    assert not any("\n\n" in t or t.endswith("\n") for t in texts.values())  # or blank lines count
    found = line_dedup.line_dedup(docs).select("doc_id", "removed").collect()
    assert {(r["doc_id"], k) for r in found for s in r["removed"] for k in range(s["start"], s["end"])} == repeated_runs(texts.items())


def test_frequent_line_chunks_do_not_change_results(docs):
    plain, salted = (sorted(line_dedup.line_dedup(docs, hot=n).select("doc_id", "removed_lines", "clean_text").collect()) for n in (1, 1 << 30))
    assert plain == salted


def test_blank_lines_in_runs(spark):
    rows = [(1, "a b\n\nc d\nx"), (2, "y\na b\n\nc d\n"), (3, "z\n\nc d\n"), (4, "same\nsame\nsame")]
    found = {r["doc_id"]: r["clean_text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: rows[0][1], 2: "y\n", 3: rows[2][1], 4: "same"}


def test_lines_odd(odd, empty):
    rows = {r["doc_id"]: r for r in line_dedup.line_dedup(odd).collect()}
    assert rows[2]["clean_text"] == "" and rows[4]["removed_chunks"] == 0
    assert line_dedup.line_dedup(odd).count() == 10 and line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.line_dedup(odd).agg(F.sum("removed_chunks")).first()[0] == 2


def test_queries(spark, sf):
    assert queries.op3_minhash(spark, sf).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert set(queries.op9_exact_dedup(spark, sf).columns) == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
