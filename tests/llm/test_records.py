"""Archives, shards, id files, encoding, URL rules, the classifier, the queries and the pipeline."""

import base64
import glob
import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortgauge.llm import attention, bitplanes, feistel, linkrank, mergequeue, queries, tables, warczip

SMALL = "/root/testdata/sf0.001"
TOKENIZER = queries.word_tokenizer()


def opened(data: bytes):
    class File(io.BytesIO):
        def size(self):
            return len(data)

    return File(data)


# ---------------------------------------------------------------- WARC in ZIP


def test_pages_come_back_from_packages_as_brute_force_says(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "ü" * 5000, "<p>a</p>", "x\r\n\r\ny", ""]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    packages = warczip.write_packages(pages.withColumn("key", F.lit(1)).withColumn("least", F.lit(2)))
    got = {r["page_id"]: r for r in warczip.read_packages(packages, payloads=True).collect()}
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        at = first.setdefault(raw, i)
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if at == i else "revisit", None if at == i else at)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
        assert got[i]["payload"] == (raw if at == i else None)
    paths = [r["path"].removeprefix("file://") for r in packages.collect()]
    records = 0
    for path in paths:
        with zipfile.ZipFile(path) as package:
            assert package.testzip() is None and {x.compress_type for x in package.infolist()} == {zipfile.ZIP_STORED}
            records += len(package.read(warczip.INDEX).splitlines())
    assert records == len(html)


def test_small_payloads_ties_nulls_and_no_pages(spark):
    pages = spark.createDataFrame([(2, "u", "same"), (1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (5, "u", "tiny"), (4, "u", "tiny")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warczip.read_packages(warczip.write_packages(pages)).collect())
    assert got == [(-1, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (4, "response", None), (5, "revisit", 4)]
    assert {r["record_type"] for r in warczip.read_packages(warczip.write_packages(pages, least_bytes=5)).collect()} == {"response"}
    assert warczip.read_packages(warczip.write_packages(pages.limit(0))).count() == 0


def test_directory_reads_other_writers_and_refuses_what_has_no_ranges():
    for comment in (b"", b"a comment PK\5\6 inside"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            package.comment = comment
            package.writestr("é.txt", b"one")
            with package.open("big", "w", force_zip64=True) as member:
                member.write(b"two")
        data = out.getvalue()
        found = warczip.directory(opened(data))
        assert {k: data[a:a + n] for k, (a, n) in found.items()} == {"é.txt": b"one", "big": b"two"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("x", b"z" * 100)
    with pytest.raises(ValueError, match="compressed"):
        warczip.directory(opened(out.getvalue()))
    for junk in (b"", b"no archive at all" * 9):
        with pytest.raises(ValueError):
            warczip.directory(opened(junk))
    out = io.BytesIO()
    writer = warczip.PackageWriter(out)
    writer.begin("m")
    writer.put(b"ab")
    writer.put(b"c")
    writer.end()
    writer.close()
    (at, size), = warczip.directory(opened(out.getvalue())).values()
    assert out.getvalue()[at:at + size] == b"abc"


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 16, 17, 99, 1000])
def test_permutation_is_one_to_one_and_depends_on_the_seed(spark, count):
    rows = spark.range(count).select(feistel.permuted(F.col("id"), count).alias("a"), feistel.permuted(F.col("id"), count, "other").alias("b")).collect()
    assert sorted(r["a"] for r in rows) == list(range(count)) == sorted(r["b"] for r in rows)
    if count == 1000:
        assert sum(r["a"] == r["b"] for r in rows) < 20 and abs(np.corrcoef(range(count), [r["a"] for r in rows])[0, 1]) < 0.1


def test_shards_are_even_gapless_and_reproducible(spark):
    texts = ["", None, "é", "x" * 1000] + [f"t{i % 7}" for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    made = [sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in feistel.assign_shards(d).collect()) for d in (df, df.repartition(3))]
    assert made[0] == made[1]
    slots = defaultdict(list)
    for doc_id, size, crc, shard, slot in made[0]:
        raw = (texts[doc_id] or "").encode()
        assert (size, crc) == (len(raw) + 1, zlib.crc32(raw))
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    tied = spark.createDataFrame([(1, "a")] * 40 + [(None, None)] * 3, "doc_id long, text string")
    assert sorted(Counter(r["shard"] for r in feistel.assign_shards(tied, 4).collect()).values()) == [10, 11, 11, 11]
    assert feistel.assign_shards(df.limit(0)).count() == 0


# ---------------------------------------------------------------- URL rules


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("http://Sub.Example.NET/en/x?q", "sub.example.net", "/en/x", "example.net/en/", "allow"), 2: ("https://a.net/", "a.net", "/", "net/", "block"),
        3: ("https://a.net", "a.net", "", None, "block"), 4: ("https://example.com/de/1#f", "example.com", "/de/1", "example.com/de/", "block"),
        5: ("//no.scheme/", "", "", None, "allow"), 6: (None, "", "", None, "allow"), 7: ("x://y.org/fr/?://z.net/", "y.org", "/fr/", "org/fr/", "allow"),
        8: ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"), 9: ("http://h?x", "h", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, v[0], None) for k, v in urls.items()], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in linkrank.judge_pages(pages).collect()}
    assert got == {k: v[1:] for k, v in urls.items()}
    assert linkrank.judge_pages(pages.limit(0)).count() == 0


def plain_ranks(edges, seeds, passes):
    """Trust along links and distrust against them, over dictionaries."""
    out = {}
    for name, flip in (("trust", False), ("distrust", True)):
        turned = {((b, a) if flip else (a, b)): n for (a, b), n in edges.items()}
        whole = Counter()
        for (a, _), n in turned.items():
            whole[a] += n
        rank = {h: (1 - linkrank.DAMPING) * s[name] for h, s in seeds.items()}
        for _ in range(passes):
            new = Counter({h: (1 - linkrank.DAMPING) * s[name] for h, s in seeds.items()})
            for (a, b), n in turned.items():
                new[b] += linkrank.DAMPING * rank.get(a, 0) * n / whole[a]
            rank = new
        out[name] = rank
    return out


def test_trust_and_distrust_spread_over_links(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.com" for i in range(8)] + ["bad.net", "good.org"]
    rows, edges, seeds = [], Counter(), {}
    for i in range(60):
        host = hosts[i % 10]
        path = "/fr/" if host.endswith(".org") else "/x/"
        targets = {rng.choice(hosts) for _ in range(3)} | ({"bad.net"} if host == "h1.com" else set())
        html = "".join(f"<a class=x href={q}http://{t.upper()}/p{q}>l</a>" for t in targets for q in ['"'])
        rows.append((i, f"http://{host}{path}{i}", html))
        edges.update((host, t) for t in targets if t != host)
    for h in hosts:
        seeds[h] = {"trust": float(h == "good.org"), "distrust": float(h == "bad.net")}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r for r in linkrank.judge_pages(pages).collect()}
    want = plain_ranks(edges, seeds, 400)
    for h in hosts:
        assert abs(got[h]["trust"] - want["trust"][h]) < 1e-2 and abs(got[h]["distrust"] - want["distrust"][h]) < 1e-2
    assert got["h1.com"]["verdict"] == "block" and got["h1.com"]["rule"] is None


def test_ranks_of_cycles_meet_the_tolerance(spark):
    edges = {("a", "b"): 1, ("b", "c"): 2, ("c", "a"): 1, ("b", "a"): 1}
    seeds = {h: {"trust": float(h == "a"), "distrust": float(h == "c")} for h in "abc"}
    links = spark.createDataFrame([(*e, n) for e, n in edges.items()], "source string, target string, pages long")
    given = spark.createDataFrame([(h, s["trust"], s["distrust"]) for h, s in seeds.items()], "host string, trust double, distrust double")
    got = {r["host"]: r for r in linkrank.propagate(links, given).collect()}
    want = plain_ranks(Counter(edges), seeds, 400)
    for h in "abc":
        assert abs(got[h]["trust"] - want["trust"][h]) < 1e-5 and abs(got[h]["distrust"] - want["distrust"][h]) < 1e-5
    with pytest.raises(RuntimeError, match="after 10 passes"):
        linkrank.propagate(links, given, passes=10)


# ---------------------------------------------------------------- encoding and id files


HARD = ["", " ", "Hello   World's café é 12345 <|endoftext|>x 中文\n\n!!!", "a<|endoftext|><|startoftext|>b", "ΑΣ ΣΑΣ İstanbul ẞ ǅ \u00a0x\u2003y\u0085z", "x" * 3000, "\x1c a\x1fb \x00", "é e\u0301 q\u0323\u0307"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_queue_encodes_and_decodes_as_the_library_does(library):
    rng = random.Random(4)
    pool = ["a", "B", "'", "s", " ", "\n", "é", "e", "\u0301", "9", "½", "*", "中", "Σ", "İ", "<|endoftext|>", "<|", "\u00a0", "\x1c", "ﬁ", "K", "the", "ing"]
    texts = HARD + ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(2000)]
    queue = mergequeue.MergeQueue(open(TOKENIZER, encoding="utf-8").read())
    cache = mergequeue.WordCache(queue)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert queue.encode(text) == ids
        count, decimal, decoded, packed = cache.encode(text.encode())
        assert (count, decimal, decoded) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert np.frombuffer(packed, "<i4").tolist() == ids


def test_texts_encode_in_spark_and_odd_files_are_refused(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(None, None), (0, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = mergequeue.encode_and_decode(df, TOKENIZER, ids=True).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        text = "" if r["id"] is None else HARD[r["id"]]
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert mergequeue.encode_and_decode(df.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        mergequeue.MergeQueue('{"model": {"type": "Unigram"}, "added_tokens": []}')


@pytest.mark.parametrize("unit", ["bit", "byte"])
@pytest.mark.parametrize("count", [0, 1, 7, 64, 65, 1000])
def test_planes_round_trip(unit, count):
    rng = np.random.default_rng(count)
    lengths = [0] * 3 if not count else [0, count // 3, count - count // 3, 0]
    ids = rng.integers(0, 2**32 if count == 7 else 50_000, count, dtype=np.uint32)
    out = io.BytesIO()
    writer = bitplanes.PlaneWriter(out, unit, block=64)
    writer.add(ids[:count // 2], lengths[:1])
    writer.add(ids[count // 2:], lengths[1:])
    writer.close()
    reader = bitplanes.PlaneReader(opened(out.getvalue()))
    docs = list(reader.documents())
    assert [len(d) for d in docs] == lengths and np.array_equal(np.concatenate(docs), ids)
    if count == 1000:
        assert np.array_equal(reader.read_block(3), ids[192:256])
    with pytest.raises(ValueError):
        bitplanes.PlaneReader(opened(b"x" * 100))


def test_pieces_cut_here_are_the_librarys(monkeypatch):
    """Every sign below U+0260 alone and between others, mixed strings, and a worker that forgets its pieces."""
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(bitplanes, "PIECES", 200)
    monkeypatch.setattr(bitplanes, "CACHED", 3000)
    with open(TOKENIZER, encoding="utf-8") as file:
        definition = file.read()
    library, words = Tokenizer.from_str(definition), bitplanes.WordIds(definition)
    signs = [chr(c) for c in range(1, 0x260)]
    pool = [*signs, "<|endoftext|>", "<", "'s", "'LL", "\u0301", "\u03a3", "\u65e5", "\u3000", *"abST12.,' " * 8]
    rng = random.Random(3)
    texts = [t for c in signs for t in (c, f"a{c}b", f".{c}.", f"1{c}2")] + ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(4000)]
    for begin in range(0, len(texts), 500):
        part = texts[begin:begin + 500]
        ids, counts = words.encode([t.encode() for t in part])
        wanted = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [i for w in wanted for i in w]
    assert words.simple("word") and len(words.young) <= 100 + 500 * 13


def test_new_words_are_looked_up_once_and_a_failure_leaves_none_half_known():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        words = bitplanes.WordIds(file.read())
    first, counts = words.encode(["one two \u6f22\u5b57 one".encode(), b"", b"three<s> two"])
    # In the order of the text, words encoded whole among the cut ones: each is numbered by its one look-up.
    assert list(words.numbers) == [b"one", b"two", "\u6f22\u5b57".encode(), b"three<s>"] and len(words.starts) == 5
    with pytest.raises(UnicodeDecodeError):
        words.encode([b"one four \xff"])
    assert not words.numbers
    again, same = words.encode(["one two \u6f22\u5b57 one".encode(), b"", b"three<s> two"])
    assert again.tolist() == first.tolist() and same.tolist() == counts.tolist()


def test_ids_come_back_from_files_in_order(spark, library):
    texts = [*HARD, "same", "same"]
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string").withColumn("part", F.lit(1))
    files = bitplanes.write_ids(df, TOKENIZER, end_id=2, block=128)
    got = {r["id"]: r for r in bitplanes.read_ids(files, with_ids=True).collect()}
    at = 0
    for key in [None, *sorted(100 - i for i in range(len(texts)))]:
        want = library.encode("" if key is None else texts[100 - key], add_special_tokens=False).ids + [2]
        assert got[key]["ids"] == want and got[key]["start"] == at and got[key]["n_tokens"] == len(want)
        assert got[key]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert bitplanes.read_ids(bitplanes.write_ids(df.limit(0), TOKENIZER, end_id=2)).count() == 0


# ---------------------------------------------------------------- classifier


def test_gradient_is_the_slope_of_the_loss():
    random_state = np.random.RandomState(0)
    x, count, label = random_state.randn(9, 5), np.array([4, 1, 4]), np.array([1, 0, 1.0])
    model = attention.GatedAttention(attention.GatedAttention.start(5))
    slope = model.gradient(x, count, label)

    def loss():
        p, _ = model.forward(x, count)
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    for name in ("W", "b", "V", "U", "w", "c", "d"):
        weight = model.weights[name]
        at = (0,) * weight.ndim
        kept = weight[at]
        weight[at] = kept + 1e-6
        up = loss()
        weight[at] = kept - 1e-6
        assert abs((up - loss()) / 2e-6 - slope[name][at]) < 1e-6
        weight[at] = kept


def test_passages_are_those_of_a_plain_split():
    texts = [b"", b"  Hello WORLD!!\n\n x", b"a b c " * 40, b"one\x0btwo", "é|ü é# ".encode() * 60, b"\n"]
    vectors, count = attention.encode_passages(texts)
    assert count.tolist() == [max(1, -(-len(t.split()) // attention.PASSAGE)) for t in texts] and len(vectors) == count.sum()
    at = 0
    for text, n in zip(texts, count.tolist(), strict=True):
        for k in range(n):
            words = text.split()[k * attention.PASSAGE:(k + 1) * attention.PASSAGE]
            v = dict(zip(attention.NAMES, vectors[at], strict=False))
            hashed = vectors[at][len(attention.NAMES):]
            assert vectors.shape[1] == attention.WIDTH and abs(hashed[:attention.WORDS].sum() - bool(words)) < 1e-5
            assert abs(hashed[attention.WORDS:].sum() - any(len(w) > 2 for w in words)) < 1e-5
            assert abs(v["words"] - len(words) / attention.PASSAGE) < 1e-6
            if words:
                assert abs(v["distinct"] - len(set(words)) / len(words)) < 1e-6
                assert abs(v["most"] - max(Counter(words).values()) / len(words)) < 1e-6
                assert abs(v["bars"] - sum(w.count(b"|") for w in words) / len(words)) < 1e-6
            at += 1


def test_held_out_accuracy_and_separate_scoring(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(300):
        good = " ".join(rng.choice(["the", "river", "moves", "slow", "over", "stones", "again"]) for _ in range(120))
        bad = good[:300] + " " + " ".join(w.upper() + "!!" for w in good[300:].split())
        rows.append((i, bad if i % 3 == 0 else good))
        marks.append((i, int(i % 3 != 0)))
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, quality int")
    model = attention.fit(docs, labels)
    scored = attention.score_rows(docs.withColumn("score", F.lit(9)), model).withColumn("held", attention.held_out(F.col("id")))
    got = {r["id"]: r for r in scored.collect()}
    test = [i for i, _ in marks if got[i]["held"]]
    assert all(got[i]["held"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 3 != 0) for i in test]) > 0.97 and len(test) > 30
    assert 0 <= got[None]["score"] <= 1 and got[None]["score"] == got[900]["score"]
    kept = attention.keep_good(docs.withColumn("x", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "x"] and kept.where("doc_id % 3 = 0 AND doc_id < 300").count() < 5
    again = attention.fit(docs.repartition(3), labels)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    assert attention.score_rows(docs.limit(0), model).count() == 0
    nothing = attention.fit(docs, labels.limit(0))
    assert attention.score_rows(docs, nothing).where("score IS NULL").isEmpty()


def test_words_alone_tell_junk_from_prose_in_held_out_documents(monkeypatch):
    """The given documents with the counts taken out: what the hashed words have learnt."""
    import duckdb

    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) ORDER BY 1").fetchall()
    held = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows])
    label = np.array([r[2] for r in rows], float)
    parts = [attention.encode_passages([(t or "").encode() for _, t, _ in rows[i:i + 100]]) for i in range(0, len(rows), 100)]
    bags = np.split(np.concatenate([v for v, _ in parts]).astype(float), np.cumsum(np.concatenate([c for _, c in parts]))[:-1])

    def held_out_auroc(columns, named):
        monkeypatch.setattr(attention, "NAMES", named)
        model = attention.GatedAttention.fit([b[:, columns] for b, h in zip(bags, held, strict=True) if not h], label[~held])
        score = np.array([model.forward(b[:, columns], np.array([len(b)]))[0][0] for b, h in zip(bags, held, strict=True) if h])
        rank, good = np.argsort(np.argsort(score)) + 1, label[held] == 1
        return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())

    n = len(attention.NAMES)
    assert held_out_auroc(np.arange(attention.WIDTH), attention.NAMES) > 0.99
    assert held_out_auroc(np.arange(n, attention.WIDTH), []) > 0.92


def test_fit_sees_all_passages_and_chooses_rows_by_digest(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(attention.GatedAttention, "fit", classmethod(lambda cls, bags, labels: seen.append((bags, labels))))
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:2]
    labels = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id long, quality int")
    long = " ".join("word" if i != 5025 else "!!!" for i in range(10_000))
    attention.fit(spark.createDataFrame([(ids[0], long)], "doc_id long, text string"), labels)
    assert len(seen[0][0][0]) == 200
    again = [(i, f"{'a' * (k + 1)} text") for i in ids for k in range(12)]
    attention.fit(spark.createDataFrame(again, "doc_id long, text string"), labels, sample=3)
    assert len(seen[1][0]) == 6 and set(seen[1][1]) == {0.0, 1.0}
    monkeypatch.setattr(attention, "SENT", 4)
    attention.fit(spark.createDataFrame(again, "doc_id long, text string"), labels)
    assert len(seen[2][0]) == 4


# ---------------------------------------------------------------- shared tables, queries, pipeline


def test_stored_tables_survive_and_can_be_discarded(spark):
    made = tables.stored(spark.range(10), "t")
    folder = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert made.count() == 10 and glob.glob(folder)
    tables.discard(made)
    assert not glob.glob(folder)
    outside = spark.read.parquet(f"{SMALL}/labels.parquet")
    tables.discard(outside)
    assert outside.count() > 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_recompression", "op4_simhash", "op13_lehmer")])
def test_queries_return_a_row_per_input_row(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    source, key = ("pages", "page_id") if name.startswith(("op2_", "op9_")) else ("embeddings", "vec_id") if name.startswith("op12_") else ("documents", "doc_id")
    want = spark.read.parquet(f"{SMALL}/{source}.parquet").select(key)
    ids = sorted(r[0] for r in got.select(key).collect())
    if name.startswith("op7_"):
        low = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
        docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
        whole = {(d["doc_id"], i) for d in docs for i, t in low.items() if t in " ".join(d["text"].lower().split())}
        assert whole <= {(r["doc_id"], r["item_id"]) for r in got.collect()}
    else:
        assert ids == sorted(r[0] for r in want.collect())


def test_audit_query_returns_every_order_and_step_of_every_source(spark):
    got = queries.QUERIES["op13_lehmer"](spark, SMALL)
    sources = {r[0] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("source").distinct().collect()}
    rows = got.select("part", "filter_order", "step").distinct().collect()
    assert len(rows) == got.count() == 600 * len(sources) and {r["part"] for r in rows} == sources


def test_pipeline_stages_keep_the_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "encoding"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    low = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        made = tables.stored(stage(spark, docs, SMALL), name)
        after = {r["doc_id"]: r for r in made.collect()}
        assert set(after) <= set(before) and len(after) == made.count()
        if name != "encoding":
            assert made.columns == docs.columns
        if name == "quality_classifier":
            assert np.mean([(i in after) == bool(q) for i, q in labels.items()]) > 0.95
        elif name == "near_dedup":
            assert len({r["text"] for r in after.values()}) == len(after)
        elif name == "decontamination":
            assert {i for i in before if i not in after} == {i for i, r in before.items() if any(t in " ".join(r["text"].lower().split()) for t in low)}
        elif name != "quality_classifier":
            assert set(after) == set(before)
        docs = made
