"""Substring dedup, near-dedup, quality rules, decontamination: against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortgauge.llm import fences, qgrams, recompression, simhash, simhash_texts, tables

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORDS.findall((text or "").encode())


def docs(spark, texts, extra="lang string, source string, n_chars long"):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


# ---------------------------------------------------------------- substring dedup


def expected_cut(texts, window):
    lists = [split(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def planted():
    passage, long = prose(1, 60), prose(2, 300)
    texts = [" ".join(prose(10 + i, 40 + 7 * i)) for i in range(12)]
    texts += [" ".join(prose(30 + i, 20) + passage + prose(60 + i, 25)) for i in range(6)]
    texts += [" ".join(long)] * 3 + [" ".join(long[:150] + ["x"] + long[151:])]
    texts += ["der " * 36, "der " * 35, "a b " * 40, " ".join(passage[:36]), " ".join(passage[:35]), " ".join(passage[:34])]
    for k in range(8):  # near copies with changes in different places
        copy = list(long)
        for j in range(k, 300, 31 + k):
            copy[j] = f"new{k}"
        texts.append("\n".join(copy))
    return [*texts, "", None, "one", "é ü " * 50, "é ü " * 50]


def test_repeated_windows_are_removed_as_brute_force_does(spark):
    texts = planted()
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected_cut(texts, recompression.WINDOW)


def test_short_windows_and_random_repetitive_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") if k % 2 else rng.choice("abcdef") for _ in range(rng.randint(0, 120))) for k in range(40)]
    for window in (3, 8):
        got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.remove_repeats(docs(spark, texts), window).collect()}
        assert [got[i] for i in range(len(texts))] == expected_cut(texts, window)


def test_equal_windows_have_equal_anchors_whatever_surrounds_them():
    core = [w.encode() for w in prose(3, 35)]
    found = set()
    for k in range(20):
        left, right = ([w.encode() for w in prose(100 + k + s, 40)] for s in (0, 50))
        names = recompression.word_names(left + core + right)
        name, start, stop, _ = recompression.anchors(names, np.array([0, len(names)]), 35)
        found.add(frozenset(name[(start <= 40) & (stop >= 75)].tolist()))
    assert frozenset.intersection(*found)


def test_repeated_ids_null_ids_and_empty_tables(spark):
    long = " ".join(prose(4, 80))
    rows = [(1, long), (1, long), (1, "other text"), (None, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("mark", F.lit(1))
    got = sorted((r["id"] or -1, r["n_words"], r["n_removed"]) for r in recompression.remove_repeats(df).collect())
    assert got == [(-1, 0, 0), (-1, 80, 80), (1, 2, 0), (1, 80, 80), (1, 80, 80)]
    assert recompression.remove_repeats(df.limit(0)).count() == 0
    cut = recompression.cut_repeats(df.withColumn("n_chars", F.length("text")))
    assert cut.columns == [*df.columns, "n_chars"] and cut.count() == 5
    assert sorted(-1 if r["n_chars"] is None else r["n_chars"] for r in cut.collect()) == [-1, 0, 0, 0, 10]


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = WORDS.findall((text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(values, radius):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_fingerprints_and_classes_as_brute_force_does(spark):
    long = prose(7, 400)
    texts = [" ".join(prose(200 + i, 5 + 9 * i)) for i in range(20)] + ["", None, "   ", "One", "one", "One two", "ÄÖ äö"]
    texts += [" ".join(long[:399] + [f"v{k}"]) for k in range(15)] + [" ".join(long).upper()]
    got = {r["id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    values = [plain_fingerprint(t) for t in texts]
    assert [got[i] for i in range(len(texts))] == [(f"{v:016x}", c) for v, c in zip(values, components(values, 3), strict=True)]


@pytest.mark.parametrize("tree", [1, 5, 4096])
def test_shards_lose_no_link_however_small_trees_are(spark, tree):
    rng = random.Random(tree)
    values = []
    for _ in range(25):
        base = rng.getrandbits(64)
        values += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(12)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "value long")
    labels = {r["node"]: r["label"] for r in simhash.classes(simhash.shard_links(nodes, 3, tree)).collect()}
    groups = components(values, 3)
    for i, a in enumerate(signed):
        for j, b in enumerate(signed[:i]):
            assert (labels.get(a, a) == labels.get(b, b)) == (groups[i] == groups[j])


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(0)
    values = list({rng.getrandbits(16) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in (rng.getrandbits(16) for _ in range(50)):
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def test_long_chains_become_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 70) if i != 40] + [(5, 5)], "value long, root long")
    labels = {r["node"]: r["label"] for r in simhash.classes(links).collect()}
    assert all(labels[i] == (0 if i <= 40 else 41) for i in range(71))
    assert simhash.classes(links.limit(0)).count() == 0


def test_simhash_of_null_ids_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (4, None)], "doc_id long, text string").withColumn("value", F.lit("clash"))
    got = sorted((r["id"] or -1, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (4, 4)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def jaccard_classes(texts, similarity):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").encode().lower())
        sets.append({b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set()))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and len(a & b) >= similarity * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if top(i) == i}


def near_copies():
    texts = []
    for g in range(8):
        base = prose(300 + g, 60 + 40 * g)
        for k in range(6):
            copy = list(base)
            for _ in range(k):
                copy[random.Random(g * 10 + k).randrange(len(copy))] = f"c{k}"
            texts.append(" ".join(copy))
    return [*texts, texts[0].upper(), "", None, "  ", "short one", "Short ONE"]


@pytest.mark.parametrize("block", [50, simhash_texts.BLOCK])
def test_one_of_each_class_of_near_copies_stays(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_texts, "BLOCK", block)
    texts = near_copies()
    kept = simhash_texts.keep_one(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == jaccard_classes(texts, 0.8)


def test_repeats_inside_a_text_do_not_hide_a_copy(spark):
    texts = []
    for g in range(6):
        base = " ".join(f"w{g}x{i}" for i in range(40 + 30 * g))
        texts += [base, " ".join([base] * 2), " ".join([base] * 3)]
        line = " ".join(f"l{g}y{i}" for i in range(20))  # the line is repeated once, and then nine times
        texts += [f"{line} {line} a{g} {base}z", " ".join([line] * 9) + f" a{g} {base}z"]
    want = jaccard_classes(texts, 0.8)
    assert len(want) <= 12
    assert {r["doc_id"] for r in simhash_texts.keep_one(docs(spark, texts)).collect()} == want


def missed_by_keys():
    """Pairs at 90/112 whose smallest digests differ under all keys."""
    texts = []
    for seed in (124, 824, 1650):
        rng = random.Random(seed)
        one = [f"m{rng.randrange(10**6)}" for _ in range(104)]
        other = [*one, "q0", "q1"]
        other[20] = other[60] = "n"
        texts += [" ".join(one), " ".join(other)]
    return texts


def test_no_copy_is_lost_where_all_keys_differ(spark):
    texts = missed_by_keys()
    _, _, shards = simhash_texts._sketch([t.encode() for t in texts], 5, 0.8)
    named = [set(first) | set(rest) for first, rest in shards]
    assert not any(a & b for a, b in zip(named[::2], named[1::2], strict=True))
    assert {r["doc_id"] for r in simhash_texts.keep_one(docs(spark, texts)).collect()} == jaccard_classes(texts, 0.8) == {0, 2, 4}


@pytest.mark.parametrize("block", [500, simhash_texts.BLOCK])
def test_exact_turn_alone_finds_all_classes(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_texts, "BLOCK", block)
    monkeypatch.setattr(simhash_texts, "REACH", -1)  # the turns before find nothing
    texts = near_copies() + missed_by_keys() + [" ".join(prose(300, 60)) * k for k in (2, 3)]
    assert {r["doc_id"] for r in simhash_texts.keep_one(docs(spark, texts)).collect()} == jaccard_classes(texts, 0.8)


def test_stored_tables_have_files_by_their_bytes_not_by_partitions(spark, monkeypatch):
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, written = {k: spark.conf.get(k, None) for k in keys}, {}

    def noted(df, name, *bounds):
        table = tables.stored(df, name, *bounds)
        written[name] = max(written.get(name, 0), len(table.inputFiles()))
        return table

    for module in (simhash, simhash_texts):
        monkeypatch.setattr(module, "stored", noted)
    texts = near_copies() + missed_by_keys()
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert {r["doc_id"] for r in simhash_texts.keep_one(docs(spark, texts)).collect()} == jaccard_classes(texts, 0.8)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    least = tables.FILES_A_CORE * spark.sparkContext.defaultParallelism
    few = {"nodes", "shards", "members", "links", "labels", "shared", "open", "rarest", "kept"}
    assert few <= set(written) and max(written[n] for n in few) <= least < 40
    monkeypatch.setattr(tables, "FILE_BYTES", 100)
    large = tables.stored(spark.range(10_000), "numbers")
    assert tables.file_count(large) > least, "larger tables have more files"


def test_equal_rows_and_null_ids_keep_one(spark):
    text = " ".join(prose(9, 50))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (None, "only this"), (None, "only this")], "doc_id long, text string")
    df = df.withColumn("shard", F.lit(1)).withColumn("id", F.lit(2))
    assert sorted((r["doc_id"] or -1) for r in simhash_texts.keep_one(df).collect()) == [-1, 7]
    assert simhash_texts.keep_one(df.limit(0)).count() == 0


# ---------------------------------------------------------------- quality rules


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_and_base_rules(spark):
    texts = ["", None, "a", "a b c a b c", "x\nx\n \n\nx\n x", "é* <b>|#", "tab\tsep\x0bv\x0cf\rr", " ".join(prose(1, 200)), "a b " * 100, "w " * 49, "w x " * 25]
    got = {r["id"]: r for r in fences.apply_rules(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = plain_counts(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 2 * want[4] > want[0]) and not (r["base_failed"] and r["kept"])


def test_repeated_words_with_a_large_vocabulary():
    rng = random.Random(3)
    lists = [[b"%d" % rng.randrange(10**9) for _ in range(3000)] for _ in range(3)]
    lists[1][50:60] = lists[1][500:510]
    assert fences.repeated_words(lists) == [0, 20, 0]
    assert fences.repeated_words([]) == [] and fences.repeated_words([[b"a"], []]) == [0, 0]


def test_limits_follow_each_language_and_source(spark):
    def prose(seed, n):
        rng = random.Random(seed)
        return [f"w{rng.randrange(500)}" for _ in range(n)]

    clean = [(f"{g}{i}", " ".join(prose(1000 + i, 120)), g, "s") for g in ("en", "fr") for i in range(60)]
    noisy = [(f"x{i}", " ".join(w + "**" for w in prose(2000 + i, 120)), "en", "noisy") for i in range(60)]
    odd = [("odd", " ".join(w + "**" for w in prose(1, 120)), "fr", "s"), ("few", " ".join(prose(2, 120)), None, None)]
    df = spark.createDataFrame(clean + noisy + odd, "doc_id string, text string, lang string, source string")
    kept = {r["id"]: r["kept"] for r in fences.apply_rules(df).collect()}
    assert not kept["odd"] and kept["few"] and all(kept[i] for i, *_ in clean) and all(kept[i] for i, *_ in noisy)


def test_merged_sketches_give_the_quartiles_of_all_rows(spark):
    df = docs(spark, [" ".join(prose(i, 60 + i)) for i in range(90)])
    counted = fences.measures(df)
    bound = fences.limits(counted).where("source = 's1'").first()
    length = sorted(r["word_chars"] / r["n_words"] for r in counted.collect())
    low, high = length[int(0.25 * len(length)) - 1:][0], length[int(0.75 * len(length)) - 1:][0]
    reach = fences.REACH * max(high - low, 0.5)
    assert abs(bound["length_to"] - (high + reach)) < 0.1 and abs(bound["length_from"] - (low - reach)) < 0.1
    assert fences.apply_rules(df.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def edit_distance_inside(passage, text):
    """Fewest edits of ``passage`` against any stretch of ``text``, by the full table."""
    row = np.zeros(len(text) + 1, int)
    for i, p in enumerate(passage, 1):
        new = np.empty_like(row)
        new[0] = i
        best = np.minimum(row[1:] + 1, row[:-1] + np.array([p != t for t in text], int))
        for j, b in enumerate(best, 1):
            new[j] = min(b, new[j - 1] + 1)
        row = new
    return int(row.min())


def test_passages_are_found_within_the_edit_budget_and_not_beyond(spark):
    rng = random.Random(11)
    items = [" ".join(rng.choice(["the", "of", "and", "alpha", "bravo", "tango", "zulu", "kilo"]) + rng.choice(["", "ing", "s", "er"]) for _ in range(30)) for _ in range(12)]
    texts, near = [], []
    for k in range(60):
        item = rng.randrange(len(items))
        copy = list(items[item])
        for _ in range(k % 14):
            at = rng.randrange(len(copy))
            copy[at] = rng.choice("qxyz")
        texts.append(" ".join(prose(k, 30)) + " " + "".join(copy) + " " + " ".join(prose(k + 90, 20)))
    df = docs(spark, [*texts, None, "", "short"])
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, "tiny")], "item_id long, text string")
    found = {r["doc_id"]: {x["item"]: x["edits"] for x in r["leaks"]} for r in qgrams.with_leaks(df, bench).collect()}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            m, t = item.lower(), " ".join(text.lower().split())
            distance, budget = edit_distance_inside(m, t), int(qgrams.EDITS * len(m))
            assert (j in found[i]) == (distance <= budget), (i, j, distance, budget)
            if j in found[i]:
                assert found[i][j] == distance
                near.append(distance)
    assert len(set(near)) > 3 and found[60] == {} == found[61] == found[62]


def test_items_shorter_than_a_gram_are_found(spark):
    items = ["Tiny", "two  Wd", "é", "ninechars", "ten chars!", "absent", " ", ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["a tiny one, not TINY", "here two\nwd end", "caf\u00e9", "xninecharsx ten chars!", "ninechar", "", None]
    for edits in (0.05, 0.2):
        found = {r["doc_id"]: {(x["item"], x["edits"]) for x in r["leaks"]} for r in qgrams.with_leaks(docs(spark, texts), bench, edits=edits).collect()}
        for i, text in enumerate(texts):
            t = " ".join((text or "").lower().split())
            plain = {(j, edit_distance_inside(m, t)) for j, m in enumerate(" ".join(x.lower().split()) for x in items) if m and t}
            assert found[i] == {(j, d) for j, d in plain if d <= int(edits * len(" ".join(items[j].lower().split())))}, (i, edits)


def test_blocks_case_ties_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(qgrams, "BLOCK", 100)
    item = "An ÉCOLE passage that Is long enough to be told apart from others"
    bench = spark.createDataFrame([(1, item), (2, item), (3, "something else entirely, which nobody wrote down"), (None, item)], "item_id long, text string")
    df = docs(spark, [f"x {item.upper()} y {item}", item.replace(" ", "\n\n  "), "nothing here"]).withColumn("leaks", F.lit(5)).withColumn("item", F.lit(1))
    got = {r["doc_id"]: sorted((x["item"] or -1, x["edits"]) for x in r["leaks"]) for r in qgrams.with_leaks(df, bench).collect()}
    assert got == {0: [(-1, 0), (1, 0), (2, 0)], 1: [(-1, 0), (1, 0), (2, 0)], 2: []}
    assert qgrams.with_leaks(df.limit(0), bench).count() == 0
    assert qgrams.with_leaks(df, bench.limit(0)).where("size(leaks) > 0").isEmpty()
