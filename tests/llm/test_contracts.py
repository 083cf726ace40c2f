"""Queries against brute force on a whole small table, and defined results of odd input."""

from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    fingerprints,
    html_text,
    quality,
    queries,
    sentencepiece_codec,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
)

ODD = [(1, None), (2, ""), (3, "a b c"), (4, "A b\tc"), (5, "  \n "), (6, "x " * 5000), (6, "x " * 5000), (None, "a b c"), (8, "é▁😀\x00 z"), (9, None)]


@pytest.fixture(scope="module")
def docs(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, i, "s", "e") for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, rule string, extra string")


def test_simhash(spark, data, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, data).collect()}
    assert got == brute.components(docs)


def _linked(fps, bits):
    """Component (least index) of each of a list of fingerprints."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return dict(enumerate(root))


def _signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("bits", range(7))
def test_simhash_links_are_exact(spark, bits):
    """Short lists, lists that are refined, and lists that are tied by values; sound and complete."""
    rng = np.random.default_rng(bits)
    few = [int(rng.integers(0, 1 << 62)) for _ in range(4)]
    fps = set(few)
    while len(fps) < (24 if bits > 4 else 70):
        f = list(fps)[int(rng.integers(len(fps)))]
        # changes within few bytes keep lists of many positions long
        for b in rng.choice(20 if rng.integers(2) else 64, bits + int(rng.integers(0, 2)) or 1, replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    order = sorted(fps)
    classes = spark.createDataFrame([(_signed(f), i) for i, f in enumerate(order)], "_fp long, rep long")
    for local in (4096, 6, 2) if bits < 5 else (4096, 6):
        pairs = [(r.a, r.b) for r in simhash.links(classes, bits, local).collect()]
        assert all((order[a] ^ order[b]).bit_count() <= bits for a, b in pairs)
        assert _groups_of({(min(p), max(p)) for p in pairs}, range(len(order))) == _linked(order, bits)


def test_position_sets_cover():
    from itertools import combinations

    for bits, n in enumerate((1, 2, 6, 8, 20, 12, 28)):
        sets = simhash.position_sets(bits)
        assert len(sets) == n
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 8 - bits))
    with pytest.raises(ValueError):
        simhash.position_sets(7)


def test_doc_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (simhash.near_duplicates, suffix_dedup.dedup_spans, fingerprints.fingerprint_documents):
        with pytest.raises(TypeError):
            f(df)


def test_simhash_odd(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.component_id)
    assert by[1] == by[2] == by[5] == by[9] == {1}
    assert by[3] == by[4] == by[None] == {3}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_sentencepiece_is_the_librarys(spark, data, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_sentencepiece(spark, data).collect()}
    for doc, text in docs:
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        assert got[doc] == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(lib.decode(ids).encode()))


def test_sentencepiece_fuzz():
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    rng = np.random.default_rng(5)
    bits = [" ", "▁", "a", "th", "\n", "é", "😀", "日", "0", "the", "   ", "<s>", "\x00", *own.pieces[300:3000:50]]
    for _ in range(3000):
        text = "".join(bits[int(i)] for i in rng.integers(0, len(bits), int(rng.integers(0, 30))))
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == lib.decode(ids)
    for _ in range(300):  # any ids, not only those that encoding gives
        ids = rng.integers(0, 1000, 12).tolist()
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids)


def test_sentencepiece_odd(spark, odd):
    clash = odd.withColumns({"n_tokens": F.lit("old"), "ids": F.lit("old")})
    out = sentencepiece_codec.encode_documents(clash, public_tokenizers.path("piece_bpe_32k.model"), ids=True)
    rows = out.collect()
    assert out.columns.count("n_tokens") == out.columns.count("ids") == 1
    assert len(rows) == len(ODD) and "extra" in out.columns
    assert {r.n_tokens for r in rows if not r.text} == {2}
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in rows)


def test_sharding(spark, data, docs):
    rows = queries.op4_sharding(spark, data).collect()
    text = dict(docs)
    sizes, home, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        t = text[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 1, brute.crc(t), "bytes", None)
        sizes[r.shard] += r["size"]
        home[t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for t in text.values():
        groups[t] += len((t or "").encode()) + 1
    assert set(sizes) == set(range(16)) and max(sizes.values()) <= sum(sizes.values()) / 16 + 2 * max(groups.values())


def test_sharding_is_minimax(spark):
    rng = np.random.default_rng(1)
    for n, shards, top in ((400, 16, 50), (3000, 7, 2000), (5, 16, 9)):
        sizes = [int(x) for x in rng.integers(1, top, n)]
        keys = sorted(int(x) for x in rng.integers(0, 1 << 60, n))
        df = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long").repartition(3)
        cuts = sharding.cut_keys(df, shards)
        held = Counter()
        for k, s in zip(keys, sizes):
            held[sum(k > c for c in cuts)] += s
        assert max(held.values()) <= sharding.smallest_capacity(sizes, shards)


def test_sharding_odd(spark, odd):
    out = sharding.shard_documents(odd.withColumns({c: F.lit("own") for c in ("key", "cell", "salt", "row", "first", "kept", "_key")}))
    rows = out.collect()
    assert {(r.key, r.cell, r.salt, r.row, r.first, r.kept, r._key) for r in rows} == {("own",) * 7}
    assert len(rows) == len(ODD) and out.columns.count("shard") == 1
    assert {r["size"] for r in rows if r.doc_id in (1, 9)} == {1}
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_url_filter_is_the_sqls(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = sorted(map(repr, con.execute(queries.ORACLE_SQL["op8_url_filter"]).fetchall()))
    got = sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in queries.op8_url_filter(spark, data).collect())
    assert got == want


def test_url_filter_odd(spark):
    urls = [None, "", "x", "http://", "HTTP://A.Example.ORG/en/1?x", "http://example.org/en/1", "s://org", "s://org/", "s://a.com/fr/x#y", "s://com?/fr/", "a://b://org/x", "s://xorg/", "s://example.org/en/1"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, None, "old")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    for i in (0, 1, 2, 3):
        assert got[i] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/en/1", "example.org/en/1", "block") == (got[4][0], *got[5][1:])
    assert got[6] == ("org", "", None, "allow") and got[7][2] == "org/" and got[8][2] == "com/fr/"
    assert got[9] == ("com", "", None, "allow") and got[10] == ("b:", "//org/x", None, "allow") and got[11][2] is None
    assert sorted(map(str, url_filter.filter_urls(df, url_filter.listed(spark, [*queries.URL_RULES, ("block", "noslash"), (None, "a/"), ("allow", None)])).collect())) == sorted(map(str, url_filter.filter_urls(df, queries.URL_RULES).collect()))
    clash = df.withColumns({c: F.lit("own") for c in ("key", "best", "kept", "prefix", "digest", "expr", "full")})
    out = url_filter.filter_urls(clash, queries.URL_RULES)
    assert out.where("key = 'own' and best = 'own' and kept = 'own' and expr = 'own'").count() == len(urls) + 1 and out.columns.count("rule") == 1
    assert url_filter.filter_urls(df, []).where("verdict = 'allow'").count() == len(urls) + 1
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_decontaminate(spark, data, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_decontaminate(spark, data).collect()}
    assert got == brute.hits(docs, items)


def test_decontaminate_odd(spark, odd):
    items = [(1, "a B, c"), (1, "x x x x x x x x x x x x"), (None, "z"), (4, None), (5, ""), (6, "é é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.mark_windows(odd, bench).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = {3: (3, 3, ["1"]), 4: (3, 3, ["1"]), 6: (5000, 5000, ["1"]), 8: (2, 1, [])}.get(r.doc_id, (3, 3, ["1"]) if r.doc_id is None else (0, 0, []))
        assert (r.n_words, r.n_hit, r["items"]) == want and r.contaminated == (want[1] > 0)
    assert decontaminate.mark_windows(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.mark_windows(odd.limit(0), bench).count() == 0
    clash = odd.withColumns({c: F.lit(9) for c in ("n_hit", "_items", "_spans", "_doc", "_s", "_held", "_bucket")})
    out = decontaminate.mark_windows(clash, bench)
    assert out.where("n_hit = 9").count() == 0 and out.where("_items = 9 and _doc = 9 and _held = 9").count() == len(ODD)


@pytest.mark.parametrize("slots", [1 << 25, 1 << 15])
def test_decontaminate_of_repetitive_texts(spark, monkeypatch, slots):
    """Few words, so that windows overlap, share shingles and begin and end at the edges of documents;
    with few slots the filter lets a good deal through."""
    from tidemark.llm import staging

    monkeypatch.setattr(staging, "SLOTS", slots)
    rng = np.random.default_rng(31)
    few, many = [f"w{i}" for i in range(4)], [f"v{i}" for i in range(300)]

    def text(n):
        return " ".join((few if rng.integers(2) else many)[int(rng.integers(4))] for _ in range(n))

    items = [(i, text(int(rng.integers(0, 25)))) for i in range(60)] + [(60, "w1 w2"), (61, "w3"), (62, "v9 v8 v7 v6")]
    docs = []
    for d in range(150):
        parts = [text(int(rng.integers(0, 12)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [items[int(rng.integers(len(items)))][1].upper(), text(int(rng.integers(0, 5)))]
        docs.append((d, ", ".join(parts)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.mark_windows(df, bench, keep=["doc_id"]).drop("items").collect()}
    assert got == brute.hits(docs, items)


def test_suffix_dedup(spark, data, docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_suffix_dedup(spark, data).collect()}
    assert got == brute.removed(docs)


def test_suffix_dedup_repetitive(spark):
    rng = np.random.default_rng(7)
    word = ["ab", "the ", "x" * 30, "é", "lorem ipsum dolor sit amet ", "\n", "q" * 99]
    shared = ["".join(word[int(i)] for i in rng.integers(0, len(word), 30)) for _ in range(6)]
    rows = [(0, "a" * 99), (1, "a" * 250), (2, "b" * 100), (3, "b" * 100), (4, "ab" * 400)]
    for d in range(5, 60):
        rows.append((d * 3, "".join([shared[int(rng.integers(6))] if rng.integers(2) else word[int(rng.integers(len(word)))] * int(rng.integers(9)) for _ in range(int(rng.integers(1, 6)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_spans(df, keep=["doc_id"]).collect()}
    assert got == brute.removed(rows)


def test_suffix_dedup_long_texts(spark, monkeypatch):
    big = "".join(str(i * i) for i in range(400_000))
    rows = [(1, big), (2, big[150_000:400_000] + "-" + big[1_000_000:1_300_000] + "end"), (3, "tail " + big[-200:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_spans(df, keep=["doc_id"]).collect()}
    assert got == brute.removed(rows)


def test_suffix_dedup_odd(spark, odd):
    clash = odd.withColumns({"n_spans": F.lit("old"), "_doc": F.lit("own"), "_runs": F.lit("own"), "_at": F.lit("own"), "doc": F.lit("own")})
    out = suffix_dedup.dedup_spans(clash, kept_text=True)
    rows = out.collect()
    assert {(r._doc, r._runs, r._at, r.doc) for r in rows} == {("own",) * 4}
    assert len(rows) == len(ODD) and {"extra", "shard"} <= set(out.columns)
    six = sorted((r.n_removed, r.text) for r in rows if r.doc_id == 6)
    assert six[1] == (10000, "") and six[0][0] == 9998
    assert all(r.n_removed == 0 and r.text == t for r in rows for d, t in ODD if r.doc_id == d and d not in (6, None))
    assert suffix_dedup.dedup_spans(odd.limit(0)).count() == 0


def _held_out(spark, data, query, label, folds, held):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = query(spark, data).collect()
    for r in rows:
        assert r.held_out == (brute.crc(str(r.doc_id)) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    return [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def _auc(rows):
    one, zero = ([s for y, s, _ in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))


def test_quality_held_out(spark):
    rows = _held_out(spark, "/root/testdata/sf0.1", queries.op7_quality, "quality", 3, 1)
    assert _auc(rows) > 0.98 and sum(y == p for y, _, p in rows) / len(rows) > 0.97


def test_toxicity_held_out(spark):
    rows = _held_out(spark, "/root/testdata/sf0.1", queries.op5_toxicity, "toxic", 5, 0)
    assert _auc(rows) > 0.97 and sum(y == p for y, _, p in rows) / len(rows) > 0.96


def test_held_out_labels_are_not_learned(spark, data, tmp_path):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    for f, label, folds, held in ((quality.score_quality, "quality", 3, 1), (toxicity.score_toxicity, "toxic", 5, 0)):
        turned = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, 1 - F.col(label)).otherwise(F.col(label)))
        assert f(docs, labels).select("doc_id", "score").exceptAll(f(docs, turned).select("doc_id", "score")).isEmpty()


def test_counterfactuals_quiet_group_names():
    texts, label = [], []
    for i in range(300):
        group = ("muslim", "gay", "woman", "immigrant")[i % 4]
        toxic = i % 2
        # group names go with toxic texts here, as they do in skewed data
        texts.append(f"the {group} is scum number {i}" if toxic else (f"the {group} is home number {i}" if i % 6 == 0 else f"a train is late number {i}"))
        label.append(toxic)
    kinds = toxicity.kinds_of(toxicity.IDENTITY)
    score = toxicity.fit_model([toxicity.extracted(t, kinds) for t in texts], np.array(label))
    assert score.__self__.pairs == 400
    assert score("the muslim is home") < 0.5 and score("you are scum") > 0.5
    assert abs(score("the gay is here") - score("the straight is here")) < 0.05


def test_hinge_solver_is_at_the_optimum():
    """The duality gap: what the weights cost at most above any others."""
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 60, 9)) for _ in range(120)]
    values = [rng.normal(size=len(r)) for r in rows]
    label = (rng.random(120) < 0.3).astype(int)
    for cost in (0.05, 1.0, 20.0):
        w, alpha = quality.dual_coordinate_descent(rows, values, label, 60, cost, 4000, 1e-6)
        most = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) * cost
        assert (alpha >= 0).all() and (alpha <= most).all() and (alpha == most).any()
        sign = np.where(label == 1, 1, -1)
        margin = sign * np.array([w[r] @ v + w[60] for r, v in zip(rows, values)])
        primal, dual = w @ w / 2 + most @ np.maximum(0, 1 - margin), alpha.sum() - w @ w / 2
        assert 0 <= primal - dual < 1e-3 * primal
        rebuilt = np.zeros(61)
        for r, v, a, s in zip(rows, values, alpha, sign):
            rebuilt[r] += a * s * v
            rebuilt[60] += a * s
        assert np.allclose(rebuilt, w)


def test_counterfactual_solver_is_at_the_optimum():
    """The gradient is that of the objective, and vanishes at the fitted weights."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join([*rng.choice(words, 5), *(["muslim"] if rng.integers(2) else ["frau"] if rng.integers(2) else [])]) for _ in range(80)]
    label = np.array([int("w1" in t.split() or rng.random() < 0.2) for t in texts])
    kinds = toxicity.kinds_of(toxicity.IDENTITY)
    pairs = [(m, s) for t in texts for m in toxicity.mentions(t, kinds) for s in toxicity.swaps(m, kinds)]
    documents = [sorted(set(toxicity.words_of(t))) for t in texts]
    problem = toxicity.Problem(documents, label, pairs, sorted({f for d in [*documents, *(p for q in pairs for p in q)] for f in toxicity.features(d)}))
    w, b = rng.normal(size=problem.size), 0.3
    slope, sb = problem.gradient(w, b)
    for i in range(problem.size):
        e = np.zeros(problem.size)
        e[i] = 1e-5
        assert abs((problem.value(w + e, b) - problem.value(w - e, b)) / 2e-5 - slope[i]) < 1e-5
    assert abs((problem.value(w, b + 1e-5) - problem.value(w, b - 1e-5)) / 2e-5 - sb) < 1e-5
    model = toxicity.fit_model([toxicity.extracted(t, kinds) for t in texts], label).__self__
    own = toxicity.Problem(documents, label, pairs, toxicity.vocabulary(documents, label))
    fitted = np.array([model.weights.get(x, 0.0) for x in own.number])
    slope, sb = own.gradient(fitted, model.intercept)
    assert abs(slope).max() < 1e-3 and abs(sb) < 1e-3 and model.pairs == len(pairs) > 0


def test_samples_have_bounds(spark):
    """Documents may share a doc_id and be of any length: rows and bytes that are collected have bounds."""
    from tidemark.llm import ngrams

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "x" * 100_000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int")
    sample = ngrams.labelled_sample(labels, "y", F.lit(True), 2)
    read = lambda rows, size: ngrams.sample_features(docs, sample, lambda t: (t or "").encode(), rows, size)
    assert len(read(2, 1 << 20)[1]) == 2 and len(read(600, 1 << 20)[1]) == 501
    for size in (0, 1000, 50_000):
        y, rows = read(600, size)
        assert sum(len(r) + 64 for r in rows) <= size and len(y) == len(rows)
    assert read(600, 50_000)[1] == read(600, 50_000)[1]


def test_classifiers_odd(spark, odd):
    for f, label in ((quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")):
        none = spark.createDataFrame([], f"doc_id long, {label} int")
        out = f(odd.withColumn("score", F.lit("old")), none)
        assert {r.score for r in out.collect()} == {0.5} and "extra" in out.columns and out.count() == len(ODD)
        some = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 0), (1, 1)], f"doc_id long, {label} int")
        assert {r.score for r in f(odd, some).collect()} == {1.0}
        both = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, 0), (8, 1)], f"doc_id long, {label} int")
        assert f(odd, both).count() == len(ODD)
        assert f(odd.limit(0), both).count() == 0


def test_fingerprints(spark, data, docs):
    import unicodedata

    def canon(t):
        for _ in range(3):
            t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
        return " ".join(t.split())

    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, data).collect()}
    order = sorted(docs, reverse=True)
    named = defaultdict(set)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited.encode()))
        assert r.near_edited == float(canon(text) == canon(edited)) == float(r.fingerprint == r.edited_fingerprint)
        assert r.near_next == float(canon(text) == canon(after))
        named[canon(text)].add(r.fingerprint)
        named[canon(edited)].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in named.values()) and len(set.union(*named.values())) == len(named)


def test_fingerprints_canonical(spark):
    same = [["Straße", "STRASSE", "ｓtrasse "], ["a  b\n", " A b", "a b"], ["é", "É"], ["ﬁ", "FI"], ["", " \t", None]]
    rows = [(i * 10 + k, t) for i, g in enumerate(same) for k, t in enumerate(g)]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[i * 10] for i in range(len(same))}) == len(same)
    assert all(got[i * 10] == got[i * 10 + k] for i, g in enumerate(same) for k in range(len(g)))


def test_fingerprints_mixed_buckets_are_told_apart(spark, docs):
    """With a digest of two bits all buckets are mixed; texts and edited texts share their names."""
    rows = [*docs[:150], (None, "az"), (None, "aa"), (7, "again"), (7, "again"), (7, "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda c: F.lower(F.hex(F.pmod(F.xxhash64(c), F.lit(4))))
    names = [Counter(), Counter()]
    for k, out in enumerate((fingerprints.fingerprint_documents(df, digest=weak), fingerprints.fingerprint_documents(df))):
        for r in out.collect():
            names[k][(r.edited_sha256, r.fingerprint, r.edited_fingerprint)] += 1
    pairs = [set(), set()]
    for n in (1, 2):
        weakly, fully = (defaultdict(set), defaultdict(set))
        for r in names[0]:
            weakly[r[0]].add(r[n])
        for r in names[1]:
            fully[r[0]].add(r[n])
        assert weakly.keys() == fully.keys()
        for sha in fully:
            if len(fully[sha]) == len(weakly[sha]) == 1:
                pairs[0].add((*weakly[sha], *fully[sha]))
    assert len({a for a, _ in pairs[0]}) == len({b for _, b in pairs[0]}) == len(pairs[0]) > 200


@pytest.mark.parametrize("block", [1, 2, 3, 512])
def test_fingerprints_next_over_blocks(spark, block):
    """Dense and outlying ids, crowds on one id and without any: the order is that of id, then of
    the texts' hashes, and no block but one of equal rows holds more than it may."""
    rng = np.random.default_rng(block)
    rows = [(i, f"t{i}") for i in (0, 5, 6, 7, 1000, 5000, 5001, 9_000_000, 9_000_001, -4, 1 << 62, -(1 << 63))]
    rows += [(i, f"t{i}") for i in range(20_000, 20_300)] + [(77, f"s{i}") for i in range(200)] + [(None, f"n{i}") for i in range(200)] + [(78, "same")] * 30
    rng.shuffle(rows)
    df = spark.createDataFrame([(None if i is None else int(i), str(t)) for i, t in rows], "id long, text string").repartition(3)
    got = fingerprints.with_next(df, block).select("id", "text", "next").collect()
    tie = {r.text: r.t for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 32).alias("t")).collect()}
    order = sorted(((r.id, r.text) for r in got), key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]], r[1]))
    assert Counter((r.id, r.text, r.next) for r in got) == Counter((*a, b[1]) for a, b in zip(order, order[1:] + order[:1]))
    sizes = fingerprints.blocked(df.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 32)), block).groupBy("block").agg(F.count("*").alias("n"), F.count_distinct("text").alias("k")).collect()
    assert all(r.n <= 4 * block or r.k == 1 for r in sizes)


def test_fingerprints_odd(spark, odd):
    out = fingerprints.fingerprint_documents(odd.withColumns({"n_chars": F.lit("old"), "row": F.lit("own"), "block": F.lit("own"), "_text": F.lit("own")}))
    assert {tuple(r) for r in out.select("row", "block", "_text").collect()} == {("own",) * 3}
    rows = out.collect()
    assert len(rows) == len(ODD) and out.columns.count("n_chars") == 1
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2, 5, 9)}) == 1
    assert fingerprints.fingerprint_documents(odd.limit(0)).count() == 0
    one = fingerprints.fingerprint_documents(odd.where("doc_id = 3")).first()
    assert one.near_next == 1.0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>.x,#y{display:none} p.z{visibility:hidden}</style></head>
<body><h1>Head &amp; tail</h1><p>one <b>two</b>
three<p>four<br>five<div class=x>no</div><div id=y>no</div><p class=z>no</p><div hidden>no</div><div style="DISPLAY : none">no</div>
<script>var a="</p>no"</script><!-- no --><ul><li>a<li>b<ul><li>c</ul><li></ul><ol start=3><li>x<li>y</ol>
<pre>  k
    l</pre><table><caption>cap</caption><tr><th>name<th>n<tr><td>long name<td>1<tr><td colspan=2>both<tr><td>a<br>b<td>2</table>
<details><summary>s</summary>no</details><textarea>
field</textarea><img alt=pic src=q><hr>end"""


def test_html_layout():
    want = "Head & tail\n\none two three\n\nfour\nfive\n\n- a\n- b\n  - c\n\n3. x\n4. y\n\n  k\n    l\n\ncap\nname       n\nlong name  1\nboth\na          2\nb\n\ns\nfield pic\n\n----\n\nend"
    assert html_text.html_to_text(PAGE) == want


def test_html_broken_and_deep():
    for page, want in (("", ""), (None, None), ("a < b", "a < b"), ("<p", ""), ("<!--", ""), ("x<b>y", "xy"), ("</p>", ""), ("<td>c", "c"), ("<table><td>c", "c"), ("&lt;b&gt; &nbsp;", "<b>  "), ("<li>q", "- q"), ("<p>a<!--b-->c", "ac")):
        assert html_text.html_to_text(page) == want
    deep = "<div>" * 20000 + "z" + "</div>" * 20000
    assert html_text.html_to_text(deep) == "z"
    rng = np.random.default_rng(2)
    bits = ["<table>", "</table>", "<tr>", "<td>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "x", " ", "\n", "<", ">", "<a href='", "&am", "<pre>", "</", "<!--", "-->", "<b ", "<details>", "</div>"]
    for _ in range(2000):
        html_text.html_to_text("".join(bits[int(i)] for i in rng.integers(0, len(bits), 25)))


def test_html_quotes_and_short_comments():
    for page, want in (
        ("<p title=don't>Visible text here</p><p>more that's shown</p>", "Visible text here\n\nmore that's shown"),
        ('<p don\'t title = 5">a</p><p>b"c</p>', 'a\n\nb"c'),
        ("<p title='a>b' class = \"c>d\">e</p>", "e"),
        ("<p x'hidden>a</p>", "a"),
        ("<!-->a<!-- b -->c", "ac"),
        ("<!--->a<!-- b -->c", "ac"),
        ("<!----><p>a", "a"),
    ):
        assert html_text.html_to_text(page) == want


def test_html_shows_svg_math_options_and_buttons():
    for page, want in (
        ("a<svg><title>no</title><defs><text>no</text></defs>no<g/><text>b <tspan>c</tspan></text><text hidden>no</text><text>d</text></svg>e", "a b c d e"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<select><option>no<option selected>b</select>c", "b c"),
        ("<select><option disabled>no<optgroup><option>b<option>no</select>", "b"),
        ("<select multiple><option>a<option label=b>no</select>", "a b"),
        ("a<input type=submit value=Go><input value=in><input type=hidden value=no>b", "a Go in b"),
    ):
        assert html_text.html_to_text(page) == want


def test_html_query(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op6_html_text(spark, data).collect()}
    assert got == {k: html_text.html_to_text(h) for k, h in pages.items()} and all("<p>" not in t and "track(" not in t for t in got.values())


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (2, "", "old"), (None, "<p>a", "old")], "page_id long, html string, text string")
    assert sorted(repr(r.text) for r in html_text.extract_text(df).collect()) == ["''", "'a'", "None", "None"]
    assert html_text.extract_text(df.limit(0)).count() == 0


def _similar(texts):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d: grams(t) for d, t in texts}
    return {(a, b) for a in sets for b in sets if a < b and (sets[a] | sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def _groups_of(pairs, ids):
    root = {d: d for d in ids}
    for a, b in sorted(pairs):
        x, y = sorted((root[a], root[b]))
        root = {d: x if r == y else r for d, r in root.items()}
    return root


@pytest.mark.parametrize("local", [8192, 12])
def test_similar_groups(spark, local):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(25):
        base = [words[int(i)] for i in rng.integers(0, len(words), 150)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(int(rng.integers(0, 8))):  # copies with at most a word changed: 0.93 and up
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 2))):
                copy[int(at)] = "x%d" % rng.integers(1000)
            rows.append((len(rows), " ".join(copy)))
        far = list(base)
        for at in range(0, len(far), 10):  # every tenth word changed: about 0.35
            far[at] = "y%d" % at
        rows.append((len(rows), " ".join(far)))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), local=local).collect()}
    assert got == _groups_of(_similar(rows), [d for d, _ in rows])


def test_similar_groups_of_the_table(spark, data, docs):
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    pairs = _similar(docs)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    want = _groups_of(pairs, [d for d, _ in docs])
    assert all(want[d] == want[c] for d, c in got.items())  # nothing is grouped that is not similar


@pytest.mark.parametrize("crowd", [300, 700])
def test_similar_groups_verify_before_thinning(spark, crowd):
    """Pairs at 0.81, each text of which is at 0.799 to all of a crowd: some of the crowd look closer
    by their bits, fail when verified, and must not have stood in for the pair."""
    rng = np.random.default_rng(21)
    base = [f"w{i}" for i in range(138)]

    def text(name, *places):
        return " ".join(f"{name}at{i}" if i in places else w for i, w in enumerate(base))

    rows = [(i, text(f"c{i}", int(rng.integers(5, 60)))) for i in range(crowd)]
    pairs = []
    for i in range(20):
        p, q = int(rng.integers(65, 95)), int(rng.integers(102, 128))
        pairs += [(crowd + 2 * i, text(f"a{i}", p, q)), (crowd + 2 * i + 1, text(f"b{i}", p + 2, q + 2))]
    want = {d: 0 for d, _ in rows} | _groups_of(_similar(pairs), [d for d, _ in pairs])
    assert all(want[crowd + 2 * i] == want[crowd + 2 * i + 1] for i in range(20))
    assert not any(0 in pair for pair in _similar([rows[0], *pairs]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows + pairs, "doc_id long, text string")).collect()}
    assert got == want


def test_similar_groups_find_short_pairs(spark):
    """Texts of few shingles have biased bits, and 96 of 512 differ on average in such a pair."""
    rows = []
    for n, more in ((4, 0), (8, 1), (12, 2), (16, 3), (19, 3), (20, 4), (24, 5), (64, 15)):  # (n - 4) of (n - 4 + more) shingles
        for g in range(12):
            text = " ".join(f"n{n}g{g}w{i}" for i in range(n))
            rows += [(len(rows), text), (len(rows) + 1, text + "".join(f" m{g}x{i}" for i in range(more)))]
    pairs = _similar(rows)
    assert len(pairs) == 12 * 8
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _groups_of(pairs, [d for d, _ in rows])


@pytest.mark.parametrize("local", [8192, 3])
def test_similar_groups_with_common_shingles(spark, local):
    rng = np.random.default_rng(23)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = []
    for g in range(60):
        own = [f"g{g}w{i}" for i in range(int(rng.integers(4, 60)))]
        rows.append((len(rows), " ".join(own) + " " + shared))
        rows.append((len(rows), " ".join(own[: int(rng.integers(0, len(own)))]) + " " + shared))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), local=local).collect()}
    assert got == _groups_of(_similar(rows), [d for d, _ in rows])


def test_similar_groups_of_many_near_copies(spark, monkeypatch):
    """Copies of one text with a word changed, none of which SimHash ties here: candidates are in
    proportion to the copies, not to their pairs, and the groups are still those of all pairs."""
    rng = np.random.default_rng(25)
    base, seen, plain = [f"w{i}" for i in range(150)], [], simhash.staged

    def staged(df, name, **how):
        out = plain(df, name, **how)
        seen.extend([out.count()] if name == "apart" else [])
        return out

    monkeypatch.setattr(simhash, "staged", staged)
    monkeypatch.setattr(simhash, "links", lambda classes, **how: spark.createDataFrame([], "a bigint, b bigint"))
    rows = []
    for i in range(400):
        copy = list(base)
        for at in rng.choice(150, 1, replace=False):
            copy[at] = f"c{i}x{at}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _groups_of(_similar(rows), [d for d, _ in rows])
    assert sum(seen) < 80 * len(rows), seen


def test_similar_groups_of_the_table_are_exact(spark, data, docs):
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    want = _groups_of(_similar(docs), [d for d, _ in docs])
    empty = [d for d, t in docs if not (t or "").split()]
    assert got == want | {d: min(empty) for d in empty}
