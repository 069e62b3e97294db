"""The ten operators against brute force, and their edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle_check import assert_same, database
from tidebar.llm import decontaminate, linededup, mixing, neardup, neighbours, textgrams
from tidebar.llm.components import connected_components
from tidebar.llm.decontaminate import contamination, drop_contaminated
from tidebar.llm.labelled import held_out_fold, labelled_sample
from tidebar.llm.language import identify_language
from tidebar.llm.licenses import MIN_COVERAGE, NOTICES, TEMPLATES, build_index, scan_batch, scan_licenses
from tidebar.llm.linededup import drop_repeated_lines
from tidebar.llm.mixing import mix_sources
from tidebar.llm.neardup import drop_near_duplicates, estimate_jaccard, keep_one_of_each, near_duplicates, registers_of
from tidebar.llm.neighbours import nearest
from tidebar.llm.quality import score_quality
from tidebar.llm.queries import ORACLE_SQL, QUERIES
from tidebar.llm.store import Workspace
from tidebar.llm.tokencount import count_tokens
from tidebar.llm.toxicity import score_toxicity

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet " * 20_000


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "one two three"), (5, "Ünï çödé ÉTÉ 12"), (6, "!!! ???"), (7, LONG), (8, "one two")]


def crowded(spark, rows):
    """With columns whose names clash with outputs."""
    clash = ["score", "predicted", "lang_pred", "n_tokens", "n_bytes", "n_lines", "n_removed", "licenses", "licensed", "epoch", "kept", "n_words"]
    return table(spark, rows).withColumns({c: F.lit("old") for c in clash} | {"lang": F.lit("en"), "source": F.lit(None).cast("string")})


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], database(sf_dir))


def test_shingles_equal_python():
    texts = ["a b c a b", "", "Solo", "É é x\ty", "A b\nC"]
    column = pa.array([*texts, None])
    found = []
    for _, _, data, offsets in textgrams.blocks(column):
        h, first = textgrams.shingles(textgrams.Tokens(data, offsets, textgrams.WHITESPACE), 2)
        found += [h[a:b] for a, b in zip(first[:-1], first[1:])]
    seen = {}
    for text, hashes in zip([*texts, ""], found):
        words = text.encode().lower().split()
        want = list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)] if words else []
        assert len(hashes) == len(want)
        for w, x in zip(want, hashes.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# 1. Decontamination


def hits(text, items, window=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            win = w[s : s + window]
            for p in range(len(own) - len(win) + 1):
                if own[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {str(item)} if item is not None else set()
    return len(own), len(hit), sorted(found)


def test_contamination_against_brute_force(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "short item"), (3, "solo"), (10, item), (4, None), (5, "..."), (None, "the null item here")]
    docs = [*ODD[:-2], (20, f"x {item} y"), (20, f"x {item} y"), (21, item.upper().replace(" ", ", ")), (22, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (23, "beta gamma delta epsilon zeta eta theta iota kappa"), (24, "Solo short-item solo short item"), (25, "the null item here solo"), (26, None)]
    got = contamination(crowded(spark, docs), table(spark, items, "item_id long, text string"))
    rows = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect())
    want = collections.Counter((d, *hits(t, items)[:2], tuple(hits(t, items)[2])) for d, t in docs)
    assert rows == want
    left = drop_contaminated(table(spark, docs), table(spark, items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, t in docs if not hits(t, items)[1])
    none = contamination(table(spark, docs), table(spark, [], "item_id long, text string"))
    assert none.count() == len(docs) and none.where("n_hit > 0").count() == 0
    assert contamination(table(spark, []), table(spark, items, "item_id long, text string")).count() == 0


# 2. Token counts


def test_token_counts_equal_the_library(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    cache = f"file://{tmp_path}/cache"
    docs = crowded(spark, [*ODD, (9, "<s> special </s>")])
    got = count_tokens(docs, TOKENIZER, cache).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = r.text or ""
        assert r.n_tokens == len(model.encode(text)) and r.n_bytes == len(text.encode())
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for _, t in ODD}) + 1
    count_tokens(table(spark, [*ODD, (11, "new text")]), TOKENIZER, cache).collect()
    assert spark.read.parquet(cache).count() == before + 1
    other = count_tokens(table(spark, ODD), public_tokenizers.path("byte_bpe_50k.json"), cache)
    assert other.count() == len(ODD) and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert count_tokens(table(spark, []), TOKENIZER, f"file://{tmp_path}/empty").count() == 0


# 3. Nearest neighbours


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 16))).astype(float)
    x[100:150] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 100 == 0, k=10).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-9)
    right = 0
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        right += len(set(np.lexsort((np.arange(6000), -s))[:10]) & {v for v, _ in found[q]})
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
    assert len(found) == 60 and right / 600 >= 0.9


def test_neighbours_leave_unusable_vectors_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (3, []), (120, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 120), (120, 1, 1), (120, 2, 2), (120, 3, 2), (120, 4, 0)]
    assert nearest(df.where("false"), F.lit(True)).count() == 0


def recall(spark, sf_dir, k, **options):
    """Of op3's rule against brute force, and the answers' lengths."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = nearest(vectors, F.col("vec_id") % k == 0, k=20, **options).toPandas()
    rows = [(r.vec_id, np.asarray(r.embedding, float)) for r in vectors.collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    right = n = 0
    for q, found in got.groupby("query_id").vec_id:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        top = set(ids[np.lexsort((ids, -s))[:20]])
        right, n = right + len(top & set(found)), n + len(top)
    return right / n, set(got.groupby("query_id").size())


def test_op3_reaches_its_recall_on_its_table(spark):
    found = recall(spark, "/root/testdata/sf0.1", 20)
    assert found[0] >= 0.9 and found[1] == {20}
    assert neighbours.fit_partitions(np.random.default_rng(0).normal(size=(2000, 64)), 2000, 20, 0.97).layers  # not exhaustive
    divided = recall(spark, "/root/testdata/sf0.1", 20, split_rows=200)
    assert divided[0] >= 0.9 and divided[1] == {20}


def test_neighbours_are_k_however_small_the_parts(spark):
    x = np.random.default_rng(5).normal(size=(600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 100 == 0, k=400, recall=0.01).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {q: 400 for q in range(0, 600, 100)}
    same = nearest(df.where("vec_id = 0"), F.lit(True), k=5)
    assert same.count() == 0


# 4 to 6. Classifiers


def letters_of(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()) + " "


def test_naive_bayes_against_dictionaries(spark):
    rng = np.random.default_rng(0)
    words = {"en": ["the", "river", "and", "stone"], "de": ["der", "fluß", "und", "stein"], "fr": ["la", "rivière", "et", "pierre"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i in range(60) for lang in [list(words)[i % 3]]]
    mixed = [(100, "the fluß et pierre", None), (101, "und", None), (102, "stone, stein; la", None)]
    got = {r.doc_id: r for r in identify_language(spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")).collect()}
    counts = {x: collections.Counter() for x in words}
    grams = lambda t: [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
    for _, text, lang in rows:
        counts[lang].update(grams(letters_of(text)))
    for doc_id, text, _ in rows + mixed:
        total = {x: np.log(1 / 3) + sum(np.log((counts[x][g] + 1) / (sum(counts[x].values()) + 2**16)) for g in grams(letters_of(text))) for x in words}
        best = max(sorted(words), key=total.get)
        assert got[doc_id].lang_pred == best
        assert got[doc_id].score == pytest.approx(1 / sum(np.exp(v - total[best]) for v in total.values()), abs=2e-3)


def plain_ftrl(rows, labels, alpha, l1, epochs, positive_weight=1.0):
    """Follow the regularised leader, a feature at a time; features are any keys, None the intercept."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else (np.sign(z[f]) * l1 - z[f]) * alpha / (1.0 + n[f] ** 0.5)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i] | {None: 1.0}
            w = {f: weight(f) for f in x}
            error = (1 / (1 + np.exp(-sum(w[f] * v for f, v in x.items()))) - labels[i]) * (positive_weight if labels[i] else 1.0)
            for f, v in x.items():
                g = error * v
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w[f]
                n[f] += g * g
    return lambda x: 1 / (1 + np.exp(-sum(weight(f) * v for f, v in (x | {None: 1.0}).items())))


def labelled_texts():
    rng = np.random.default_rng(8)
    vocabulary = ["amber", "birch", "cedar", "dune", "ember", "fjord"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 4 if i % 3 else 6], 8))) for i in range(90)]
    return rows, [int(i % 3 == 0) for i in range(90)]


def test_quality_against_a_plain_model(spark):
    rows, labels = labelled_texts()

    def features(text):
        words = text.split()
        count = collections.Counter(words) + collections.Counter(zip(words, words[1:]))
        norm = sum(v * v for v in count.values()) ** 0.5
        return {f: v / norm for f, v in count.items()}

    by_text = sorted((i, t, y) for (i, t), y in zip(rows, labels))
    model = plain_ftrl([features(t) for _, t, _ in by_text], [y for _, _, y in by_text], 2.0, 0.05, 4)
    got = score_quality(table(spark, rows), table(spark, list(zip(range(90), labels)), "doc_id long, quality int"), F.lit(False)).collect()
    for r in got:
        assert r.score == pytest.approx(model(features(r.text)), abs=1e-4)


def test_toxicity_against_a_plain_model(spark):
    rows, labels = labelled_texts()
    grams = lambda t: {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}
    sets = [grams(letters_of(t)) for _, t in rows]
    count = collections.Counter((g, y) for s, y in zip(sets, labels) for g in s)
    toxic, share = sum(labels), sum(labels) / len(labels)
    ratio = {}
    for g in {g for s in sets for g in s}:
        n = count[g, 1] + count[g, 0]
        if n >= 3 and abs(count[g, 1] - n * share) >= 4 * (n * share * (1 - share)) ** 0.5:
            ratio[g] = 0.3 * (np.log((count[g, 1] + 1) / (toxic + 2)) - np.log((count[g, 0] + 1) / (90 - toxic + 2)))
    scaled = lambda s: {g: ratio[g] for g in s if g in ratio}
    model = plain_ftrl([scaled(s) for s in sets], labels, 0.5, 0.1, 4, 4.0)
    got = score_toxicity(table(spark, rows), table(spark, list(zip(range(90), labels)), "doc_id long, toxic int"), F.lit(False)).collect()
    for r in got:
        assert r.score == pytest.approx(model(scaled(grams(letters_of(r.text)))), abs=1e-4)


def test_samples_of_one_repeated_id_are_bounded(spark):
    """Many texts under one id are drawn in part; many copies of one row count once."""
    for doc_id in (1, 2, 3, 4):
        many = spark.range(20_000).select(F.lit(doc_id).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
        assert 300 < labelled_sample(many, None, "lang", F.lit(False), most_rows=500).num_rows < 800
        same = spark.range(5000).select(F.lit(doc_id).alias("doc_id"), F.lit("one text").alias("text"))
        labels = spark.range(300).select(F.lit(doc_id).alias("doc_id"), F.lit(1).alias("quality"))
        assert labelled_sample(same, labels, "quality", F.lit(False), most_rows=500).to_pylist() == [{"text": "one text", "label": 1}]


def test_language_held_out_accuracy(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_language_id"](spark, sf_dir).join(truth, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark):
    got = {(r.doc_id, r.text): r for r in identify_language(crowded(spark, ODD)).collect()}
    assert len(got) == len(ODD) - 1
    for doc_id, text in ODD:
        r = got[(doc_id, text)]
        assert r.lang_pred == ("en" if any(c.isalpha() for c in text or "") else "und")
    nothing = identify_language(crowded(spark, ODD).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    assert identify_language(crowded(spark, ODD).where("false")).count() == 0


@pytest.mark.parametrize("name,label,threshold", [("op5_quality", "quality", 0.3), ("op6_toxicity", "toxic", 0.5)])
def test_classifier_contract(spark, name, label, threshold):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= threshold)).all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held[label]).mean() >= 0.9


def test_toxic_words_are_caught(spark):
    rng = np.random.default_rng(3)
    clean = ["garden", "river", "window", "paper", "morning", "table", "music", "silver"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 40))
        if i % 4 == 0:
            words[int(rng.integers(0, 40))] = ["scoundrel", "villainous"][i // 4 % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    held = held_out_fold("doc_id", 5, 0)
    got = score_toxicity(crowded(spark, rows), table(spark, labels, "doc_id long, toxic int"), held).toPandas()
    assert (got.predicted == (got.doc_id % 4 == 0)).all()


@pytest.mark.parametrize("score,label", [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_classifier_edges(spark, score, label):
    labels = table(spark, [(4, 1), (8, 0), (None, 1), (5, None), (4, 1)], f"doc_id long, {label} int")
    never = F.lit(False)
    got = score(crowded(spark, ODD), labels, never).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    without = score(crowded(spark, ODD), labels.where("false"), never).collect()
    assert {r.score for r in without} == {0.5}
    assert score(crowded(spark, ODD).where("false"), labels, never).count() == 0


# 7. Mixing


def brute_mix(rows, weights, budget, epochs, seed):
    """Leaves' budgets by repeated sharing, then prefixes of each epoch's order."""
    tokens = collections.Counter()
    for doc_id, text, domain, source in rows:
        tokens[(domain, source)] += len((text or "").split())
    tokens = {k: v for k, v in tokens.items() if v}
    cap = {k: v * epochs for k, v in tokens.items()}

    def share(given, children, capacity):
        given = min(given, sum(capacity.values()))
        full = set()
        while True:
            rest, w = given - sum(capacity[c] for c in full), sum(weights[c] for c in children if c not in full)
            more = {c for c in children if c not in full and capacity[c] * w <= weights[c] * rest}
            if not more:
                return {c: capacity[c] if c in full else weights[c] * rest // w for c in children}
            full |= more

    domains = {d for d, _ in cap}
    top = share(budget, domains, {d: sum(v for (a, _), v in cap.items() if a == d) for d in domains})
    chosen = collections.Counter()
    for d in domains:
        own = {k: v for k, v in cap.items() if k[0] == d}
        for leaf, given in share(top[d], own, own).items():
            whole, rest = divmod(given, tokens[leaf])
            members = [r for r in rows if (r[2], r[3]) == leaf and (r[1] or "").split()]
            for e in range(whole):
                chosen.update((r[0], e) for r in members)
            order = sorted(members, key=lambda r: hashlib.md5(f"{seed}|{whole}|{r[0]}|{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest())
            for r in order:
                rest -= len(r[1].split())
                if rest < 0:
                    break
                chosen[(r[0], whole)] += 1
    return chosen


def test_mixing_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 30)), f"d{i % 3}", f"s{int(rng.integers(0, 6)) if i % 2 else 0}") for i in range(600)]
    rows += [(601, None, "d0", "s0"), (602, "x y z", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, source string").withColumn("epoch", F.lit("old"))
    weights = collections.defaultdict(lambda: 1, {"d0": 5, "d1": 2, ("d0", "s1"): 3})
    named = [(i, t, d or "(none)", s or "(none)") for i, t, d, s in rows]
    by_domain = F.when(F.col("domain") == "d0", 5).when(F.col("domain") == "d1", 2).otherwise(1)
    by_source = F.when((F.col("domain") == "d0") & (F.col("source") == "s1"), 3).otherwise(1)
    for budget in (500, 4000, 12_000, 10**9):
        got = mix_sources(df, [("domain", F.col("domain")), ("source", F.col("source"))], [by_domain, by_source], budget=budget, epochs=2, seed=3)
        assert collections.Counter((r.doc_id, r.epoch) for r in got.collect()) == brute_mix(named, weights, budget, 2, 3)
    assert mix_sources(df.where("false"), [("domain", F.col("domain"))], [F.lit(1)]).count() == 0


def test_mixing_takes_repeated_rows_in_turn(spark):
    """A prefix may end within copies of one row; texts come out whole, with or without them in the mix."""
    df = table(spark, [(1, "a b c d")] * 50 + [(2, None), (3, "  ")])
    for keep in (["doc_id"], ["doc_id", "text"]):
        got = mix_sources(df, [("leaf", F.lit("x"))], [F.lit(1)], budget=90, epochs=2, keep=keep).collect()
        assert len(got) == 22 and {(r.doc_id, r.n_tokens, r.epoch) for r in got} == {(1, 4, 0)}
        got = mix_sources(df, [("leaf", F.lit("x"))], [F.lit(1)], budget=290, epochs=2, keep=keep).collect()
        assert collections.Counter(r.epoch for r in got) == {0: 50, 1: 22}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_beyond_every_bound(spark, monkeypatch, name):
    """With no broadcasts, and benchmark windows in several blocks, the same rows."""
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 300)
    monkeypatch.setattr(linededup, "MOST_DOCUMENTS", 0)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert_same(QUERIES[name](spark, SMALL), ORACLE_SQL[name], database(SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_duplicates_and_pipeline_stages_beyond_every_bound(spark, monkeypatch):
    import corpus_pipeline as P

    rows = copies(np.random.default_rng(6))
    docs = table(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    run = lambda: [sorted(((r.doc_id, r.text) for r in f(docs).collect()), key=str) for f in (keep_one_of_each, drop_near_duplicates, drop_repeated_lines, lambda d: P.decontamination_stage(spark, d, SMALL))]
    within = run()
    monkeypatch.setattr(neardup, "MOST_BROADCAST", 0)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(linededup, "MOST_DOCUMENTS", 0)
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert run() == within
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle=2).collect()), key=str) == brute_components(rows, 2, 80)


# 8. Line dedup


def test_line_dedup_cases(spark):
    passage = "first line of it\nsecond line of it\n\nthird line of it"
    rows = [(1, f"intro\n{passage}\nend"), (2, f"other\n  {passage}  \nmore"), (3, "second line of it\nthird line of it\nfirst line of it"), (4, "a\na\na\na\na"), (5, None), (6, ""), (7, "x\ny"), (8, "x\ny"), (None, passage), (9, "z\n" * 3000)]
    got = {r.doc_id: r for r in drop_repeated_lines(crowded(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text == "other\nmore" and got[2].n_removed == 4
    assert got[3].n_removed == 0
    assert got[4].text == "a" and got[4].n_removed == 4
    assert got[5].text is None and got[5].n_lines == 0
    assert got[6].text == "" and got[7].text == got[8].text == "x\ny"
    assert got[None].text == ""
    assert got[9].text == "z\n"
    assert drop_repeated_lines(crowded(spark, rows).where("false")).count() == 0


def test_line_dedup_by_clauses_against_brute_force(spark, sf_dir):
    """Lines that end with clauses: what is left equals a plain walk over the documents."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text").distinct().collect())
    rows += [(10**9, "Intro one. " + rows[0][1][:400] + " end"), (10**9 + 1, ", . ;\n\n: "), (10**9 + 2, "")]
    rows.sort(key=lambda r: (r[0], hashlib.md5(r[1].encode()).hexdigest()))
    seen, want = set(), {}
    for key, text in rows:
        ends = [m.start() for m in re.finditer(r"\n|(?<=[.,;:!?]) ", text)]
        pieces = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]  # each with the end before it
        bare = [(x[1:] if i else x).strip(" ") for i, x in enumerate(pieces)]
        at = [i for i, x in enumerate(bare) if x]
        gone = set()
        for a, _, c in zip(at, at[1:], at[2:], strict=False):
            found = "\n".join(bare[i] for i in range(a, c + 1) if bare[i])
            if len(found) >= linededup.LEAST_CLAUSES:
                if found in seen:
                    gone.update(range(a, c + 1))
                seen.add(found)
        left = "".join(x for i, x in enumerate(pieces) if i not in gone)
        want[(key, len(pieces), len(gone), left[1:] if 0 in gone else left)] = 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_repeated_lines(docs, ends=linededup.CLAUSES, least=linededup.LEAST_CLAUSES).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert {tuple(r) for r in got} == set(want) and sum(r.n_removed for r in got) > 0


def test_line_dedup_of_very_long_texts(spark):
    """Texts of 100,000 distinct lines that share 1,000, made where they are read."""
    line = lambda i: F.concat(F.lit("line "), F.when((F.col("id") == 2) & (i >= 1000) & (i < 2000), i).otherwise(i + F.col("id") * 100_000).cast("string"))
    df = spark.range(1, 3, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99_999)), line), "\n").alias("text"))
    short = table(spark, [(3, "\n".join(f"line {i}" for i in range(500, 1500)))])
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text_length) for r in drop_repeated_lines(df.union(short)).withColumn("text_length", F.length("text")).drop("text").collect()}
    assert got[1][:2] == (100_000, 0) and got[2][:2] == (100_000, 0)
    assert got[3] == (1000, 500, len("\n".join(f"line {i}" for i in range(500, 1000))))


# 9. Near duplicates


def brute_components(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(((d, len(s), least.get(g) if s else d) for (d, _), s, g in zip(rows, sets, group)), key=str)


def copies(rng):
    rows = list(ODD)
    for g in range(12):
        words = [f"w{v}" for v in rng.integers(0, 5000, 80)]
        for _ in range(int(rng.integers(1, 25))):
            copy = list(words)
            for p in rng.integers(0, 80, int(rng.integers(0, 9))):
                copy[p] = f"x{int(rng.integers(0, 10**6))}"
            rows.append((1000 - len(rows), " ".join(copy)))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = copies(np.random.default_rng(4))
    df = crowded(spark, rows)
    got = near_duplicates(df, shingle=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id or r.component_id is None) for r in got)
    left = drop_near_duplicates(df, shingle=2)
    assert left.count() == sum(r.kept for r in got) and left.columns == df.columns
    assert near_duplicates(df.where("false")).count() == 0


def test_one_of_each_group_stays(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(1, a)] * 50 + [(None, b)] * 30 + [(None, c), (7, c + "more"), (7, c), (2, ""), (2, ""), (3, None), (4, "alone")]
    got = keep_one_of_each(table(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in got) == {1: 1, None: 1, 7: 1, 2: 2, 3: 1, 4: 1}
    assert [r.text for r in got if r.doc_id is None] == [b]
    assert keep_one_of_each(table(spark, [])).count() == 0


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate((both, rng.integers(0, 2**63, 1000 - len(both), dtype=np.uint64)))) for _ in range(2)]
        truth = len(both) / (2000 - len(both))
        k = registers_of(sets)
        assert estimate_jaccard(k[:1], k[1:], np.array([1000]), np.array([1000]))[0] == pytest.approx(truth, abs=0.16)
        whole = registers_of([np.union1d(*sets)])
        assert (whole[0] == np.maximum(k[0], k[1])).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict((r.node, r.component) for r in connected_components(df, Workspace(spark, "test"), "c").collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200
    assert connected_components(df.where("false"), Workspace(spark, "test"), "c").count() == 0


# 10. Licenses


def test_licenses_are_found_with_spans(spark):
    mit = TEMPLATES["MIT-notice"]
    cut = TEMPLATES["BSD-grant"].split()
    edited = " ".join(cut[:6] + ["really"] + cut[6:10] + cut[11:])
    rows = [*ODD, (20, f"é {mit} tail"), (21, f"{mit} {mit}"), (22, mit.upper()), (23, "Released under the terms"), (24, f"start {edited} end"), (25, f"{TEMPLATES['GPL-3.0-notice']} {LONG}")]
    got = {(r.doc_id, r.text): r for r in scan_licenses(crowded(spark, rows)).collect()}
    one = got[(20, rows[10][1])].licenses[0]
    assert rows[10][1][one.start : one.stop] == mit.rstrip(".") and one.coverage == 1.0 and one.license == "MIT-notice"
    assert [x.license for x in got[(21, rows[11][1])].licenses] == ["MIT-notice"] * 2
    assert got[(22, rows[12][1])].licensed and not got[(23, rows[13][1])].licensed
    near = got[(24, rows[14][1])].licenses
    assert [x.license for x in near] == ["BSD-grant"] and near[0].matched == len(cut) - 1
    assert got[(25, rows[15][1])].licensed
    assert not any(got[k].licensed for k in ODD)
    assert scan_licenses(table(spark, [])).count() == 0


# The pipeline


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_licenses_against_longest_common_subsequences():
    """Random prose of a template's words, with an edited copy in it or not."""
    rng = np.random.default_rng(2)
    text = NOTICES["ISC-grant"]
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text)]
    n, index = len(words), build_index({"x": text})
    least = -(-len(words) * 4 // 5)
    for trial in range(60):
        around = [list(rng.choice(sorted(set(words)), int(rng.integers(5, 60)))) for _ in range(2)]
        copy, changes = list(words), int(rng.integers(0, n - least + 1))
        for _ in range(changes):
            p, kind = int(rng.integers(0, len(copy))), int(rng.integers(0, 2))
            copy[p : p + 1] = ["changed"] if kind else []
        own = around[0] + (copy if trial % 3 else []) + around[1]
        most = max(longest_common(words, own[s : s + n + 8]) for s in range(max(1, len(own) - n)))
        found = scan_batch(pa.array([" ".join(own)]), index)[0].to_pylist()[0]
        if trial % 3:
            assert found and found[0]["matched"] >= n - changes
            assert found[0]["matched"] <= longest_common(words, " ".join(own)[found[0]["start"] : found[0]["stop"]].split())
        elif most < least:
            assert not found


def test_standard_licenses_are_found():
    """Headers, a warranty alone, whole texts with other line breaks, and prose that only uses their words."""
    cases = {
        "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\n# GNU General Public License for more details.",
        "Unlicense-text": TEMPLATES["Unlicense-text"].replace(" ", "\n"),
        "BSL-1.0-text": TEMPLATES["BSL-1.0-text"],
        "MIT-warranty": TEMPLATES["MIT-warranty"].lower(),
        "BSD-warranty": TEMPLATES["BSD-warranty"],
        "GPL-3.0-text": "My program\n" + TEMPLATES["GPL-3.0-text"],
    }
    plain = "The program is software for any person, and the license of the work is a permission to use the copy. " * 50
    found = scan_batch(pa.array([*cases.values(), plain]), build_index(TEMPLATES))[0].to_pylist()
    for name, x in zip(cases, found, strict=False):
        assert name in {f["license"] for f in x}, name
    assert not found[-1]


def test_licenses_changed_as_far_as_allowed_are_found():
    """Every single-word deletion and substitution that min_coverage allows, and words put between."""
    index = build_index(NOTICES)
    for name, text in NOTICES.items():
        words = re.findall(r"[A-Za-z0-9]+", text)
        if not (len(words) - 1) / len(words) >= MIN_COVERAGE or len(words) > 100:
            continue
        changed = [words[:i] + new + words[i + 1 :] for i in range(len(words)) for new in ([], ["zzz"])]
        every = max(2, round(1 / (1 - MIN_COVERAGE)))
        changed.append([w if i % every else "zzz" for i, w in enumerate(words, 1)])
        changed.append([w for i, x in enumerate(words) for w in ((x, "zzz") if i == 1 else (x,))])
        texts = pa.array(["alpha beta " + " ".join(x) + " gamma" for x in changed])
        for x, found in zip(changed, scan_batch(texts, index)[0].to_pylist(), strict=True):
            assert name in {f["license"] for f in found}, (name, x)


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, repeats, an empty table, and columns that clash."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None) for k, (i, t) in enumerate(ODD)] + [(None, None, None, None, None)]
    odd = spark.createDataFrame(rows, schema)
    for docs in (odd, odd.where("false"), odd.withColumns({"score": F.lit(1), "lang_pred": F.lit(2), "n_removed": F.lit(3), "epoch": F.lit(4)})):
        left = docs
        for k, (_, stage) in enumerate(P.STAGES):
            left = Workspace(spark, "test").materialize(stage(spark, left, SMALL), str(k))
            assert k == 4 or left.columns == odd.columns
        kept = {r.doc_id for r in left.collect()}
        assert kept <= {4, 5, 7, 8, None} and (docs.isEmpty() or kept)


def test_pipeline_stages_keep_clean_documents(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, work = [docs], Workspace(spark, "test")
    for k, (_, stage) in enumerate(P.STAGES):
        steps.append(work.materialize(stage(spark, steps[-1], sf_dir), str(k)))
    assert all(s.columns == docs.columns for s in steps[:-1])
    frames = [s.toPandas() for s in steps]
    assert len(frames[1]) >= 0.98 * len(frames[0])
    assert len(frames[2]) == len(frames[1])
    rows = list(zip(frames[2].doc_id.tolist(), frames[2].text))
    assert sorted(frames[3].doc_id) == sorted(d for d, _, c in brute_components(rows, 5, 80) if d == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(frames[4].doc_id) == sorted(d for d, t in zip(frames[3].doc_id, frames[3].text) if not hits(t, items)[1])
    assert set(frames[5].doc_id) <= set(frames[4].doc_id) and len(frames[5])
    again = P.run(spark, sf_dir).select("doc_id", "epoch").toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, frames[5][["doc_id", "epoch"]].values))
