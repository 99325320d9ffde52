"""The methods against enumeration, numeric gradients and direct arithmetic."""

import itertools
import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import embeddings, mixing, quality, secrets, toxicity, urls


def test_viterbi_equals_enumeration():
    rng = random.Random(0)
    for _ in range(60):
        label = "".join(rng.choices("abc", k=rng.randrange(1, 11)))
        counts = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(12)}
        total = sum(counts.values())
        log_p = {(i, j): math.log(counts[label[i:j]] / total) for i, j in itertools.combinations(range(len(label) + 1), 2) if label[i:j] in counts}

        def score(words):
            return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)

        splits = []
        for cuts in itertools.product((0, 1), repeat=len(label) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(label)]
            splits.append([label[i:j] for i, j in zip(at, at[1:])])
        found = urls.viterbi(label, log_p, total)
        assert "".join(found) == label and abs(score(found) - max(map(score, splits))) < 1e-9


def test_url_scores_equal_direct_bayes(spark):
    """Block scores from raw counts of tokens; repeated rows, labels of every length, very long hosts, clashing columns."""
    hosts = ["www.casino-win.example.org", "news.example.org", "a" * 63 + ".org", "b" * 5000 + ".net", "cheappills.net", ""]
    rows = [(i, f"http://{h}/de/{i}/page.html?q=1") for i, h in enumerate(hosts * 7)] + [(3, f"http://{hosts[3]}/de/3/page.html?q=1"), (99, None), (99, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "tokens", "said", "label", "word")})
    texts = spark.createDataFrame([("cheap cheap pills and news example",)] * 40, "text string")
    got = urls.filter_urls(pages, texts, prior=0.3).collect()
    assert len(got) == len(rows)
    tokens = lambda r: [f"h:{w}" for w in r["words"]] + [f"p:{w}" for w in r["path"].lower().replace(str(r["page_id"]), "0").replace("/", " ").replace(".", " ").split()]
    ordinary, blocked = {}, {}
    for r in got:
        for t in tokens(r):
            ordinary[t] = ordinary.get(t, 0) + 1
    seeds = [w for name in urls.BLOCK_SEEDS for w in name.split()]
    for w in seeds:
        for m in ("h:", "p:"):
            blocked[m + w] = blocked.get(m + w, 0) + 1
    base = sum(ordinary.values()) + 1e-3 * urls.BUCKETS
    for r in got:
        z = math.log(0.3 / 0.7) + sum(math.log(urls.ORDINARY + (1 - urls.ORDINARY) * blocked.get(t, 0) / (2 * len(seeds)) / ((ordinary[t] + 1e-3) / base)) for t in tokens(r))
        assert abs(r["block_score"] - 1 / (1 + math.exp(-z))) < 1e-6
    words = {r["host"]: r["words"] for r in got}
    assert words[hosts[3]] == ["b" * 5000, "net"] and words["cheappills.net"] == ["cheap", "pills", "net"] and "".join(words[hosts[2]]) == "a" * 63 + "org"


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_pu_gradient_is_that_of_the_risk(prior):
    rng = np.random.default_rng(0)
    p, u = rng.normal(0.7, 1, (50, 4)), rng.normal(0, 1, (80, 4))
    signs = set()
    for k in range(8):
        w = rng.normal(size=4) * 3
        positive, negative, g = quality.pu_risk(w, p, u, prior)
        signs.add(negative >= 0)
        brute = prior * np.mean([math.log(1 + math.exp(-x @ w)) for x in p]), np.mean([math.log(1 + math.exp(x @ w)) for x in u]) - prior * np.mean([math.log(1 + math.exp(x @ w)) for x in p])
        assert np.allclose((positive, negative), brute)
        value = (lambda v: sum(quality.pu_risk(v, p, u, prior)[:2])) if negative >= 0 else lambda v: -quality.pu_risk(v, p, u, prior)[1]
        numeric = [(value(w + e) - value(w - e)) / 2e-5 for e in np.eye(4) * 1e-5]
        assert np.allclose(g, numeric, atol=1e-6)
    assert signs == ({True, False} if prior > 0.9 else {True}) or prior < 0.9


def test_class_prior_of_mixtures():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        p = rng.normal(3, 1, 4000)
        u = np.concatenate([rng.normal(3, 1, int(4000 * share)), rng.normal(-2, 1, 4000 - int(4000 * share))])
        assert abs(quality.class_prior(p, u) - share) < 0.06


def test_ordinal_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    texts = [rng.choice(6, rng.integers(1, 5), replace=False) for _ in range(30)]
    flat, row = np.concatenate(texts), np.repeat(np.arange(30), [len(t) for t in texts])
    grade, weight = rng.integers(0, 3, 30), rng.random(30)
    w, b = rng.normal(size=6), np.array([0.3, -0.4])
    loss, g, db = toxicity.ordinal_loss(w, b, flat, row, grade, weight)
    cuts, brute = [b[0], b[0] + math.exp(b[1])], 0.0
    for t, y, k in zip(texts, grade, weight):
        z = w[t].sum()
        above = [1, *(1 / (1 + math.exp(c - z)) for c in cuts), 0]
        brute -= k * math.log(above[y] - above[y + 1])
    assert abs(loss - brute) < 1e-9
    value = lambda x: toxicity.ordinal_loss(x[:6], x[6:], flat, row, grade, weight)[0]
    x = np.concatenate([w, b])
    assert np.allclose(np.concatenate([g, db]), [(value(x + e) - value(x - e)) / 2e-5 for e in np.eye(8) * 1e-5], atol=1e-6)


def test_marked_words_of_very_long_texts_enter_the_fit(spark):
    """A text of 60,000 distinct words whose only marked word is one of the last: the model equals one fitted on all words in memory."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60_000)]
    texts = [(i, " ".join(rng.choices(words[:300], k=40)) + (" vileword" * (1 + i % 3) if i % 2 else "")) for i in range(60)]
    texts += [(100 + i, " ".join(words) + (" vileword" if i % 2 else "")) for i in range(4)]
    docs, labels = spark.createDataFrame(texts + texts[:3], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    got = toxicity.fit(docs, labels)
    made, toxic = [toxicity.text_features(t) for _, t in texts], np.array([i % 2 for i, _ in texts])
    want = toxicity.OrdinalModel().fit([m[0] for m in made], toxicity._grades(made, toxic), np.ones(len(toxic)))
    assert np.allclose(got.w, want.w) and np.allclose(got.cuts, want.cuts) and got.w[toxicity.text_features("vileword")[0][0]] > 0
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for (i, _), m in zip(texts, made):
        above = 1 / (1 + np.exp(-(want.w[m[0]].sum() - want.cuts)))
        assert abs(scored[i]["severity"] - above.sum()) < 1e-6 and abs(scored[i]["p_toxic"] - above[0]) < 1e-6


def test_long_labels_are_segmented(spark):
    label = "".join(w * 3 for w in ("casino", "news", "zzqx")) * 12
    lexicon = spark.createDataFrame([("casino", 30), ("news", 50), ("asi", 2), ("w" * 400, 1)], "word string, n long")
    labels = spark.createDataFrame([(label,), ("w" * 400,), ("casino" * 12,), ("",), (label,)], "label string")
    got = {r["label"]: r["words"] for r in urls.segment_labels(labels, lexicon).collect()}
    assert got.keys() == {label, "w" * 400, "casino" * 12} and got["casino" * 12] == ["casino"] * 12 and got["w" * 400] == ["w" * 400]
    assert got[label] == (["casino"] * 3 + ["news"] * 3 + ["zzqxzzqxzzqx"]) * 12


def test_viterbi_equals_all_splits():
    rng = random.Random(5)
    for _ in range(200):
        label = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        log_p = {(i, j): math.log(rng.randint(1, 50) / 300) for i in range(len(label)) for j in range(i + 1, len(label) + 1) if rng.random() < 0.3}
        p = lambda i, j: log_p.get((i, j), math.log(10 / 300) - (j - i) * math.log(10))
        cuts = [[0, *c, len(label)] for k in range(len(label)) for c in itertools.combinations(range(1, len(label)), k)]
        got = urls.viterbi(label, log_p, 300)
        at = list(itertools.accumulate([0, *map(len, got)]))
        assert "".join(got) == label and abs(sum(map(p, at, at[1:])) - max(sum(map(p, c, c[1:])) for c in cuts)) < 1e-9


def test_markov_ratio_equals_direct_counts(spark):
    rng = random.Random(3)
    samples = [(secrets.random_string("base62", 24, rng), True) for _ in range(40)] + [(secrets.ordinary_string(rng), False) for _ in range(60)]
    ratio = secrets.fit(spark.createDataFrame(samples, "value string, secret boolean")).first()["ratio"]
    letters = string.ascii_lowercase + string.ascii_uppercase + string.digits
    classes = lambda s: [63] + [letters.index(c) if c in letters else 62 for c in s]
    n = {k: np.zeros((64, 64)) for k in (True, False)}
    for value, secret in samples:
        for a, b in itertools.pairwise(classes(value)):
            n[secret][a, b] += 1

    def log_p(m):
        alone = (m.sum(0) + 0.1) / (m.sum() + 0.1 * 64)
        return np.log((m + secrets.PULL * alone) / (m.sum(1, keepdims=True) + secrets.PULL))

    want = log_p(n[True]) - log_p(n[False])
    assert np.allclose(ratio, want.ravel())
    tokens = [secrets.random_string(k, 30, rng) for k in ("base62", "base36", "base64")] + [secrets.ordinary_string(rng) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "doc_id long, text string")
    found = secrets.find_secrets(docs, spark.createDataFrame(samples, "value string, secret boolean"))
    got = {r["doc_id"] for r in found.collect() if any(s["name"] == "markov" for s in r["spans"])}
    base = {r["doc_id"] for r in found.collect() if any(s["name"] != "markov" for s in r["spans"])}
    judged = {i for i, t in enumerate(tokens) if i not in base and all(c in letters + "+/_=-" for c in t)}
    assert got == {i for i in judged if np.mean([want[a, b] for a, b in itertools.pairwise(classes(tokens[i]))]) >= secrets.MARGIN}


def test_block_permutation_equals_a_sequential_one(spark):
    """Budgets by source, and the last epoch as the prefix of the permutation that still fits; unequal sources, one hot."""
    rng = random.Random(6)
    rows = [(i, rng.choices(["big", "mid", "small", None], [90, 20, 5, 3])[0], "w " * rng.randrange(1, 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = {i: max(1, len(t.split())) for i, _, t in rows}
    of = {}
    for i, s, _ in rows:
        of.setdefault(s, []).append(i)
    total = {s: sum(tokens[i] for i in ids) for s, ids in of.items()}
    for options in ({"max_repeat": 3.0}, {"max_repeat": None, "entropy": 1.1}, {"max_repeat": 2.0, "budget": 20_000.0}):
        size = 500
        got = mixing.mix_sources(docs, block_tokens=size, **options).toPandas()
        a = mixing.temperature(spark.createDataFrame([(str(s), t) for s, t in total.items()], "source string, tokens long"), options.get("max_repeat"), options.get("entropy"))
        z = sum(t**a for t in total.values())
        whole = options.get("budget") or max(t ** (1 - a) for t in total.values()) * z
        hashes = docs.select("doc_id", *(F.xxhash64("doc_id", F.lit(s)).alias(f"h{s}") for s in (6, 7))).toPandas().set_index("doc_id")
        for s, ids in of.items():
            budget = math.floor(total[s] ** a / z * whole + 1e-6)
            full, rest = divmod(budget, total[s])
            blocks = max(1, -(-total[s] // size))
            name = "null" if s is None else f"s:{s}"
            block = {i: int(hashes.loc[i, "h6"]) % blocks for i in ids}
            place = {b: r["p"] for b, r in zip(sorted(set(block.values())), spark.createDataFrame([(name, b, full) for b in sorted(set(block.values()))], "s string, b long, f int").select(F.xxhash64("s", "b", "f", F.lit(6)).alias("p")).collect())}
            order = sorted(ids, key=lambda i: (place[block[i]] % 2**64, block[i], int(hashes.loc[i, "h7"]), i))
            last, used = set(), 0
            for i in order:
                used += tokens[i]
                if used > rest:
                    break
                last.add(i)
            want = sorted((i, e) for i in ids for e in range(full + (i in last)))
            own = got[got["source"].isna()] if s is None else got[got["source"] == s]
            assert sorted(zip(own["doc_id"].tolist(), own["epoch"].tolist())) == want
            assert all(b == block[i] for i, b in zip(own["doc_id"].tolist(), own["block"].tolist()))


@pytest.mark.parametrize("step", range(3))
def test_lattice_recall_at_every_step_of_the_ladder(spark, step):
    """Links at cosines from 0.95 up, differing lengths, large groups; recall against brute force."""
    rng = np.random.default_rng(step)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 400, 2):
        c, e = rng.uniform(0.951, 0.97), rng.normal(size=64)
        e -= (e @ x[i]) * x[i]
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * e / np.linalg.norm(e)
    x[500:] = x[500] + rng.normal(size=(100, 64)) * 0.01
    y = np.vstack([rng.normal(size=3) * np.ones((2, 1)), rng.normal(size=(3, 3))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)] + [(2000, [3.0]), (2001, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, scale, tables = embeddings.LADDER[step]
    got = embeddings.linked_vectors(df, ladder=((1 << 62, scale, tables),)).toPandas().set_index("vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.95).sum(1) - 1
    found = got.loc[range(600), "n_links"].to_numpy()
    assert (found <= want).all() and found[:400].sum() >= 0.96 * want[:400].sum() and found.sum() >= 0.98 * want.sum()
    assert got.loc[1000, "n_links"] >= 1 and got.loc[2001, "component_id"] == 2000
