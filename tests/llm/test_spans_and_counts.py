"""Toxic spans, centroid clustering and the filter audit: against brute force, with odd rows."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from cohortgauge.llm import bitplanes, centroids, lehmer, queries, recompression, simhash, simhash_texts, tables, toxicspans, warczip

SMALL = "/root/testdata/sf0.001"
INSULTS = ["brute", "villain", "scoundrel", "rogue"]


# ---------------------------------------------------------------- filter audit


def expected_audit(rows, labels):
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    judged = []
    for i, text, part in rows:
        t = text or ""
        words = t.encode().split()
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": copy,
        }
        judged.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        mine = [x for x in judged if x[0] == part]
        removed_at = {}
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                removed_at[order, step] = len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in x[1] for x in mine) - len(gone), sum(x[1] == {letter} for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(sum(n for (o, s), n in removed_at.items() if o[s - 1] == order[step - 1]))
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("own")).withColumn("name", F.lit(1)).withColumn("n", F.lit(9))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("x"))
    got = lehmer.audit(lehmer.mask_counts(docs, marks))
    return {
        (r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
        for r in got.collect()
    }


def test_audit_equals_judging_every_order(spark):
    rng = random.Random(3)
    prose = lambda n, m: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    texts = [prose(260, 9000), prose(260, 20), prose(40, 900), prose(220, 900).upper(), prose(230, 900) + " $", "", None, "é " * 300, "# A", prose(500, 5000)]
    rows = [(i, texts[rng.randrange(len(texts))], ["a", "b", None][rng.randrange(3)]) for i in range(60)]
    rows += [(7, texts[0], "a"), (7, texts[0], "b"), (7, texts[0], "a"), (None, texts[0], "a"), (None, texts[0], "a"), (-5, texts[3], "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    got = audited(spark, rows, labels)
    want = expected_audit(rows, labels)
    assert len(got) == 4 * 120 * 5
    assert got == want


def test_audit_without_rows(spark):
    assert audited(spark, [], []) == {}


def test_ranks_and_intervals_cover_every_removal_once():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [lehmer.lehmer_rank(o) for o in orders] == list(range(120))
    found = {}
    for mask, step, first, after in lehmer.removal_intervals():
        for rank in range(first, after):
            assert found.setdefault((mask, rank), step) == step
    for mask in range(1, 32):
        for rank, order in enumerate(orders):
            assert found[mask, rank] == 1 + min(k for k, x in enumerate(order) if mask >> "ABCDE".index(x) & 1)
    assert len(found) == 31 * 120


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "bb", "c\n", "dé", "x" * 50]) + str(rng.randrange(99)) for _ in range(3000)).encode()
    whole = lehmer.own_mask(text), lehmer._distinct_words(text)
    monkeypatch.setattr(lehmer, "PIECE", 64)
    assert (lehmer.own_mask(text), lehmer._distinct_words(text)) == whole
    assert whole[1] == (len(text.split()), len(set(text.split())))


# ---------------------------------------------------------------- centroid clustering


def expected_clusters(rows, k, rounds, seed, dimension):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(x)) for x in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), -1 if r[0] is None else r[0], r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in placed:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((-1 if i is None else i), j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in placed)


def clustered(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumn("v", F.lit("own")).withColumn("cluster", F.lit(1)).withColumn("id", F.lit(2)).withColumn("near", F.lit(3))
    got = centroids.cluster_vectors(df, **options)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect())


def test_clusters_equal_plain_rounds_with_ties_and_odd_vectors(spark):
    rng = np.random.RandomState(4)
    vectors = rng.randn(80, 4).round(1).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(5, vectors[5])] * 3 + [(5, vectors[9]), (None, vectors[3]), (None, vectors[4])] + [(200 + i, [0.5, -0.5, 0.0, 1.0]) for i in range(40)]
    rows += [(90, None), (91, []), (92, [1.0] * 3), (93, [1.0, None, 1.0, 1.0]), (94, [1.0, float("nan"), 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0, 0.0])]
    assert clustered(spark, rows, k=7, rounds=3, dimension=4) == expected_clusters(rows, 7, 3, 2, 4)
    few = rows[:3]
    assert clustered(spark, few, k=7, rounds=2, dimension=4) == expected_clusters(few, 7, 2, 2, 4)


def test_clusters_without_vectors_and_beyond_the_range(spark):
    assert clustered(spark, [], k=7, dimension=4) == [] == clustered(spark, [(1, None)], k=7, dimension=4)
    with pytest.raises(PySparkException, match="beyond"):
        clustered(spark, [(1, [1e9, 0.0, 0.0, 0.0])], k=2, dimension=4)


# ---------------------------------------------------------------- toxic spans


def labelled(n, seed=1):
    """Prose with an insult in every fifth document."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.6)) % 800}" for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        for k in range(9, len(words), 11):
            words[k] += "."
        out.append((i, " ".join(words), toxic))
    return out


def exact_marginals(scores, pairs):
    n, total, ones = len(scores), 0.0, np.zeros(len(scores))
    for bits in range(1 << n):
        tags = [bits >> t & 1 for t in range(n)]
        weight = math.exp(sum(s for s, t in zip(scores, tags, strict=True) if t) + sum(pairs[a][b] for a, b in zip(tags, tags[1:])))
        total += weight
        ones += weight * np.array(tags)
    return ones / total


def test_marginals_equal_the_sum_over_all_taggings():
    rng = np.random.RandomState(2)
    length = np.array([1, 7, 4, 9])
    head = np.cumsum(length) - length
    scores, pairs = rng.randn(length.sum()) * 2, rng.randn(2, 2)
    p = toxicspans._forward_backward(scores, pairs, toxicspans._chains(head, length))[2]
    for h, n in zip(head, length, strict=True):
        assert np.allclose(p[h:h + n], exact_marginals(scores[h:h + n], pairs), atol=1e-12)


def test_field_learns_from_labelled_words():
    words = toxicspans.Words(["you brute. a fine day".encode(), "a brute force. fine".encode()] * 20)
    tags = np.array([False, True, False, False, False, False, False, False, False] * 20)
    field = toxicspans.ChainField.fit(words.features, words.head, words.length, tags, epochs=40)
    p = field.marginals(words)
    assert (p[tags] > 0.5).all() and (p[~tags] < 0.5).all()  # told apart by the neighbour


def test_documents_teach_spans_and_copies_prove_nothing():
    rows = labelled(600)
    copied = ("a text full of oddities that only this document holds, many times over", True)
    texts = [t.encode() for _, t, _ in rows] + [copied[0].encode()] * 30
    field = toxicspans.fit_texts(texts, np.array([x for *_, x in rows] + [True] * 30))
    fresh = labelled(300, seed=9)
    score, spans = toxicspans.tag_texts(field, [t.encode() for _, t, _ in fresh])
    toxic = np.array([x for *_, x in fresh])
    assert (score[toxic] >= 0.5).all() and (score[~toxic] < 0.5).all()
    found = {t[s["start"]:s["stop"]] for (_, t, _), ss in zip(fresh, spans, strict=True) for s in ss}
    assert {w for f in found for w in f.split()} <= set(INSULTS)
    assert toxicspans.tag_texts(field, [copied[0].encode()])[1] == [[]]


def test_spans_count_characters_and_long_texts_are_read_in_pieces(monkeypatch):
    field = toxicspans.fit_texts([t.encode() for _, t, _ in labelled(600)], np.array([x for *_, x in labelled(600)]))
    text = "Größe über alles é. " * 40 + "Du Brute! " + "ünd w1 w2. " * 60 + "VILLAIN brute und Ärger"
    one = toxicspans.tag_texts(field, [text.encode(), b"", b"w1 w2"])
    found = [text[s["start"]:s["stop"]] for s in one[1][0]]
    assert found == ["Brute", "VILLAIN brute"] and one[1][1] == one[1][2] == [] and one[0][0] > 0.5 > one[0][1]
    monkeypatch.setattr(toxicspans, "PIECE", 100)
    pieces = toxicspans.cut(text.encode(), 100)
    assert b"".join(pieces) == text.encode() and max(map(len, pieces)) < 140
    assert [text[s["start"]:s["stop"]] for s in toxicspans.tag_texts(field, [text.encode()])[1][0]] == found
    assert b"".join(toxicspans.cut("é".encode() * 300, 101, 7)).decode() == "é" * 300


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled(120)] + [(500, ""), (501, None), (None, "you brute"), (3, "repeated id")], "doc_id long, text string")
    docs = docs.withColumn("label", F.lit("own")).withColumn("digest", F.lit(1)).withColumn("id", F.lit(2))
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in labelled(120)] + [(None, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    scored = toxicspans.score_rows(docs, toxicspans.fit(docs, labels)).collect()
    assert len(scored) == 124 and all(0 <= r["score"] <= 1 for r in scored)
    empty = {r["id"]: r["score"] for r in scored if r["id"] in (500, 501)}
    assert empty[500] == empty[501] < 0.5
    for none in (labels.limit(0), labels.where("toxic = 1")):
        flat = toxicspans.score_rows(docs, toxicspans.fit(docs, none)).select("score").distinct().collect()
        assert len(flat) == 1
    assert toxicspans.score_rows(docs.limit(0), toxicspans.fit(docs.limit(0), labels)).collect() == []
    kept = toxicspans.drop_toxic(docs, toxicspans.fit(docs, labels))
    assert kept.schema == docs.schema and kept.count() <= 124


def test_held_out_toxicity_of_the_given_documents(spark):
    """Labels that no word explains are noise of the given table: some 7 of 97 toxic documents."""
    folder = SMALL.replace("0.001", "0.1")
    got = queries.op11_chainfield(spark, folder).where("held_out")
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in rows)
    wrong = sum(r["predicted"] for r in rows if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in rows)
    assert caught >= 0.88 and wrong <= 0.02


# ---------------------------------------------------------------- other columns, equal values, reading back


def test_a_tree_finds_equal_values_below_many_children():
    rng = random.Random(8)
    tree, values = simhash.BKTree(), []
    for d in range(1, 61):
        value = sum(1 << b for b in rng.sample(range(64), d))
        tree.insert(value)
        values.append(value)
    for value in [0, values[0], values[0], *values[:30]]:
        tree.insert(value)
        values.append(value)
    for value in {*values, 0, (1 << 64) - 1}:
        want = [i for i, v in enumerate(values) if (v ^ value).bit_count() <= 22]
        assert sorted(tree.within(value, 22)) == want


def test_stages_leave_columns_of_any_name_alone(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    own = lambda k: " ".join(f"k{k}x{i}" for i in range(80))
    texts = [own(1), own(1), own(2) + " " + shared, own(3) + " " + shared, None, "", own(4)]
    rows = [(i, t, f"mine{i}", f"mark{i}", f"span{i}", f"leak{i}", float(i), len(t or "")) for i, t in enumerate(texts)]
    names = ["doc_id", "text", "_id", "_mark", "_spans", "_leaks", "a b", "n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_id` string, `_mark` string, `_spans` string, `_leaks` string, `a b` double, n_chars long")
    docs = docs.withColumn("id", F.lit("i")).withColumn("key", F.lit("k")).withColumn("row", F.lit("r"))
    one = simhash_texts.keep_one(docs)
    cut = recompression.cut_repeats(docs)
    clean = corpus_pipeline.decontamination(spark, docs, SMALL)
    for made, kept in ((one, {0, 2, 3, 4, 6}), (cut, set(range(7))), (clean, set(range(7)))):
        assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        got = {r["doc_id"]: r for r in made.collect()}
        assert set(got) == kept
        for i, r in got.items():
            assert [r[c] for c in ("_id", "_mark", "_spans", "_leaks", "a b", "id", "key", "row")] == [f"mine{i}", f"mark{i}", f"span{i}", f"leak{i}", float(i), "i", "k", "r"]
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[2] == own(2)
    assert names == docs.columns[:8]


def test_packages_and_id_files_are_read_by_many_tasks(spark):
    pages = spark.range(64).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(md5(cast(id as string)), 20) AS html").repartition(8)
    packages = warczip.write_packages(pages)
    eight = packages.unionByName(packages) if packages.count() < 8 else packages
    assert warczip.read_packages(eight).rdd.getNumPartitions() >= min(eight.count(), tables.task_count(spark))
    docs = spark.range(400).selectExpr("id AS doc_id", "md5(cast(id as string)) AS text")
    files = bitplanes.write_ids(docs, queries.word_tokenizer(), 2)
    assert bitplanes.read_ids(files).rdd.getNumPartitions() == files.count()
