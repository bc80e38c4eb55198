"""The corpus operators against brute force, round trips, held-out accuracy, and awkward tables."""

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lakesift.llm import bpe, common, components, decontaminate, html_wrapper, labelled, line_dedup, masked_lm, ngram_join, quality_model, quality_rules, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, n_words string, score string, kept string, a string, node string, __kept string, d string, v string"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts, schema=SCHEMA):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t), "x", "y", "z", "k", "a", "n", "q", "d", "v") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choices(WORDS, k=120)) for _ in range(6)]
    near = [" ".join(w if k not in (5, 70) else "new" for k, w in enumerate(base[0].split())), base[0].upper() + " tail"]
    lines = "\n".join(" ".join(rng.choices(WORDS, k=30)) for _ in range(4))
    return [base[0], None, "", "no id " + base[1], *base[1:], *near, base[0], base[0], " \t\n ", "one two three", "One  TWO three", lines, base[2] + "\n" + lines + "\nend", ("long " + base[3] + " ") * 400, "é漢字 \x1c  'll #*$%&|<>", "same\nsame\nsame"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t):
    w = word_list("".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_bpe_like_tiktoken(spark, docs, texts, empty):
    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    tool = bpe.Codec(raw, public_tokenizers.PATTERN, remembered=50)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    rng = random.Random(2)
    odd = ["a" * 3000, "\U0001f600" * 50, " \n\n x", "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(3000)), *(t for t in texts if t)]
    for t in odd:
        ids = tool.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t) and tool.decode(ids) == t.encode()
    got = bpe.encode_documents(docs).select("text", "n_tokens", "decoded", "score").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == len(other.encode_ordinary(r.text or "")) and r.score == "z" for r in got)
    assert len(got) == len(texts) and bpe.digests(empty).count() == 0


def test_merges_by_hand():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"ab": 299, b"aab": 301}
    assert bpe.merge_tokens(b"aaab", ranks) == [300, 299]
    assert bpe.merge_tokens(b"aaaaa", ranks) == [300, 300, 97]


def test_length_histogram(spark, empty):
    lengths = [0, 0, 3, 5, 5, 9, 2000, 5000]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens bigint")
    h = token_counts.length_histogram(df)
    for r in h.collect():
        n = r.n_tokens
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.docs_at_most == sum(x <= n for x in lengths) and r.truncated_tokens == sum(min(x, n) for x in lengths) and r.tokens_at_most == sum(x for x in lengths if x <= n)
    for limit in (0, 4, 7, 3000, 9999):
        r = token_counts.at_limit(h, limit).first()
        assert (r.truncated_tokens, r.docs_cut) == (sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    assert token_counts.length_at_quantile(h, 0.5).first().n_tokens == 5
    assert token_counts.length_histogram(token_counts.token_lengths(empty, keep=[])).count() == 0


def test_token_lengths(spark, docs, texts):
    """Equal to the library where it can encode at all; very long runs of one kind end."""
    ranks = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN).ranks
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = token_counts.token_lengths(docs)
    assert out.columns.count("n_tokens") == 1 and set(out.columns) == set(docs.columns)
    assert Counter((r.text, r.n_tokens) for r in out.collect()) == Counter((t, len(other.encode_ordinary(t or ""))) for t in texts)
    rng = random.Random(4)
    long = [" " * 2_000_000, "\n" * 1_000_000, "".join(rng.choices("abcdefghij", k=1_000_000)), ("some text " * 10 + "\n") * 20_000]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_lengths(spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")).collect()}
    tool = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert got[3] == len(other.encode_ordinary(long[3])) and all(0 < got[k] <= len(long[k]) for k in range(3))
    assert got[0] == len(tool.encode(long[0])) // 4 and tool.decode(tool.encode(long[1])) == long[1].encode()


def stats_by_hand(t):
    w = word_list(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    marked = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if word_list(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark, docs, texts, empty):
    got = quality_rules.quality_rules(docs)
    rows = got.collect()
    assert len(rows) == len(texts) and set(docs.columns) <= set(got.columns)
    for r in rows:
        n, chars, symbols, dup, repeat = stats_by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = quality_rules.quality_rules(real, keep=["doc_id"]).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    share = {(q, k): sum(r["count"] for r in good if (r.quality, r.kept) == (q, k)) for q in (0, 1) for k in (True, False)}
    assert share[1, False] <= 0.01 * share[1, True] and share[0, True] <= 0.1 * share[0, False]  # the distance alone tells them apart


def mcd_by_hand(x, ridge, rng, starts=60):
    """Rows of the least determinant found by many random starts, each with steps to its end."""
    n, p = x.shape
    need, best = int(np.ceil(quality_rules.SHARE * n)), None
    for _ in range(starts):
        chosen = rng.permutation(n)[: p + 1]
        for _ in range(40):
            mean, cov = x[chosen].mean(axis=0), np.cov(x[chosen].T, bias=True) + ridge
            away = x - mean
            chosen = np.argsort(np.einsum("ij,ij->i", away @ np.linalg.inv(cov), away))[:need]
        mean, cov = x[chosen].mean(axis=0), np.cov(x[chosen].T, bias=True)
        det = np.linalg.slogdet(cov + ridge)[1]
        best = min(best, (det, mean.tolist(), cov.tolist())) if best else (det, mean.tolist(), cov.tolist())
    return best[0], np.array(best[1]), np.array(best[2])


def test_minimum_covariance_determinant(spark):
    """Small groups, some of them with a third of outliers, against random starts on single rows."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, (n, bad) in enumerate(((40, 0), (60, 12), (150, 30), (6, 1))):
        mix = rng.normal(0, 1, (3, 3))
        for k in range(n):
            a, b, c = rng.normal(0, 0.3, 3) @ mix
            words = int(np.exp(5.5 + a))
            out = k < bad
            rows.append(("en", f"s{g}", words, int(words * (9 if out else 5) * np.exp(0.1 * b)), 0, 0, 0, int(words * 0.08), int(words * (0.9 if out else 0.15) * np.exp(0.2 * c)), max(1, int(words * (0.4 if out else 0.7) * np.exp(0.05 * a)))))
    stats = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} bigint" for c in quality_rules.STATS))
    fitted = {r["at"]: r for r in quality_rules.fit(stats.repartition(3)).collect()}
    assert len(fitted) == 4 + 1 + 1
    x = np.array(stats.filter(~quality_rules.base_failed()).selectExpr(*quality_rules.FEATURES).collect())
    source = [r.source for r in stats.filter(~quality_rules.base_failed()).collect()]
    ridge = np.diag(quality_rules.RIDGE * x.var(axis=0))
    factor = quality_rules.SHARE / quality_rules.chi2(quality_rules.chi2_quantile(quality_rules.SHARE), quality_rules.P + 2)
    for g in range(3):
        own = x[np.array(source) == f"s{g}"]
        det, mean, cov = mcd_by_hand(own, ridge, rng)
        r = fitted[f'{{"level":0,"lang":"en","source":"s{g}"}}']
        mine = (quality_rules._square(r["cov"]) - ridge) / factor
        assert r.n == len(own) and np.linalg.slogdet(mine + ridge)[1] < det + 0.1
        assert np.abs(np.array(r["mean"]) - mean).max() < 0.5 * np.sqrt(np.diag(cov)).max()
    verdict = quality_rules.estimates(stats).collect()
    assert {r["__source"]: r.fit_rows for r in verdict} == Counter(source)
    for share, dof, value in ((0.99, 5, 15.0863), (0.75, 6, 7.8408), (0.5, 1, 0.4549)):
        assert abs(quality_rules.chi2_quantile(share, dof) - value) < 1e-3


def components_by_hand(items):
    """Least id reachable by links, for (id, text)."""
    sets = [(i, shingle_set(t)) for i, t in items]
    least = {i: i for i, _ in sets}
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_ngram_join(spark, docs, texts, empty):
    want = components_by_hand([(i, t) for i, t in enumerate(texts) if i != 3])
    got = ngram_join.ngram_join(docs).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingle_set(t)) for i, t in enumerate(texts) if i != 3}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None}
    assert ngram_join.ngram_join(empty).count() == 0


def test_group_of_near_copies(spark):
    """A group whose members mostly link through a few hubs only, and strangers that share a passage."""
    rng = random.Random(5)
    base, passage = rng.choices(WORDS, k=100), [f"p{i}" for i in range(40)]
    items = [(1000, " ".join(base))]
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(100)] = f"x{i}_{rng.randrange(9)}"
        items.append((i, " ".join(w)))
    items += [(2000 + i, " ".join([*(f"y{i}_{k}" for k in range(60)), *passage])) for i in range(40)]
    got = ngram_join.ngram_join(spark.createDataFrame(items, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components_by_hand(items)


def test_ngram_join_with_several_texts_of_one_id(spark):
    """All texts of a doc_id count for it: 3 and 7 meet in 5, 2 meets 5's second text, empty rows stay alone."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, b), (3, a), (15, a + " x"), (15, c), (12, c + " y"), (15, ""), (20, None), (None, c)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(5, 56, 3), (5, 56, 3), (7, 56, 3), (3, 56, 3), (15, 57, 3), (15, 56, 3), (12, 57, 3), (15, 0, 15), (20, 0, 20), (None, 56, 3)], key=str
    )
    apart = [(5, a), (9, a), (5, b), (2, b + " x")]
    assert {r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(apart, "doc_id bigint, text string")).collect()} == {2}


def test_order_filter_loses_nothing():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.sort(rng.integers(0, 1 << 40, n).astype(np.uint64) << np.uint64(24))
        b = np.sort(np.unique(np.concatenate([a[rng.random(n) < 0.9], rng.integers(0, 1 << 40, 3).astype(np.uint64) << np.uint64(24)])))
        a = np.unique(a)
        p = [x[: len(x) - (4 * len(x) + 4) // 5 + 1] for x in (a, b)]
        if len(a) and len(b):
            top = [(x >> np.uint64(32)).astype("<u4") for x in p]
            assert ngram_join._most_shared(len(a), len(b), *top) >= len(np.intersect1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_decontamination(spark, texts, empty):
    rng = random.Random(6)
    items = [(0, " ".join(rng.choices(WORDS, k=40))), (1, " ".join(rng.choices(WORDS, k=9))), (2, None), (3, ""), (4, "one two three"), (5, " ".join(rng.choices(WORDS, k=300)))]
    long = " ".join(rng.choices(WORDS, k=20000))
    part = " ".join(items[5][1].split()[:250])
    found = [items[0][1] + " and more", long + " " + items[0][1].upper() + " " + long, long + " " + items[1][1], part, " ".join(items[5][1].split()[:200]), *texts]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, found)
    want = {(i if i != 3 else None, k) for i, t in enumerate(found) for k, q in items if shingle_set(q) and 100 * len(shingle_set(q) & shingle_set(t)) >= 80 * len(shingle_set(q))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench, block_bytes=300).collect()} == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(found) - len({d for d, _ in want})
    assert decontaminate.contained_items(empty, bench).count() == 0 and decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def runs_by_hand(items):
    """(id, line numbers deleted): windows with an earlier copy, grown both ways against their first copy."""
    lines = {i: [(p, x) for p, x in enumerate(t.split("\n")) if word_list(x)] for i, t in items}
    first, windows = {}, []
    for i in sorted(lines):
        for j in range(len(lines[i])):
            some = [tuple(x for _, x in lines[i][j : j + 3])] if j + 3 <= len(lines[i]) else []
            for content in some + ([(lines[i][j][1], None)] if len(word_list(lines[i][j][1])) >= 25 else []):
                windows.append((i, j, content))
                first.setdefault(content, (i, j))
    gone = {i: set() for i in lines}
    for i, j, content in windows:
        d, k = first[content]
        if (i, j) <= (d, k):
            continue
        match = lambda x: 0 <= x < len(lines[i]) and 0 <= x - j + k < len(lines[d]) and lines[i][x][1] == lines[d][x - j + k][1]  # noqa: B023, E731
        low = high = j
        while match(low - 1):
            low -= 1
        while match(high + 1):
            high += 1
        end = lines[i][high + 1][0] if high + 1 < len(lines[i]) else len(dict(items)[i].split("\n"))
        gone[i] |= set(range(lines[i][low][0], end))
    return gone


def test_line_dedup(spark, docs, texts, empty):
    rng = random.Random(7)
    pool = [" ".join(rng.choices(WORDS, k=rng.choice((2, 5, 30)))) for _ in range(12)] + ["", " "]
    items = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(40)]
    got = line_dedup.line_dedup(spark.createDataFrame(items, "doc_id bigint, text string")).collect()
    want = runs_by_hand(items)
    for r in got:
        before = dict(items)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for p, x in enumerate(before) if p not in want[r.doc_id]) and r.n_deleted == len(want[r.doc_id])
    out = line_dedup.line_dedup(docs)
    rows = out.collect()
    assert len(rows) == len(texts) and out.columns == [*docs.columns, "n_lines", "n_deleted"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert line_dedup.line_dedup(empty).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifiers(spark, docs, texts, empty):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for run, module, name, folds, held, least in ((toxicity.toxicity, toxicity, "toxic", 5, 0, 0.9), (quality_model.quality, quality_model, "quality", 3, 1, 0.97)):
        got = run(real, labels).join(labels, "doc_id").filter("held_out").collect()
        assert all((zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in got)
        for value in (0, 1):
            some = [r.predicted == value for r in got if r[name] == value]
            assert sum(some) / len(some) >= least
        rows = run(docs, labels).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        none = run(docs, labels.limit(0)).collect()
        assert {r.score for r in none} == {0.5} and run(empty, labels).count() == 0


def test_interactions_are_learnt():
    """Neither term alone is toxic; only both together are."""
    rng = np.random.default_rng(9)
    rows, y = [], []
    for k in range(800):
        a, b = k % 2, (k // 2) % 2
        at = np.unique(np.array([10] * a + [20] * b + list(rng.integers(1000, 1100, 3)), dtype=np.int32))
        rows.append((at, np.ones(len(at), np.float32)))
        y.append(a and b)
    model = toxicity.fit(rows, np.array(y, float), clearly=0, epochs=40)
    says = [model.margin(r[0]) > 0 for r in rows]
    assert np.mean(np.array(says) == np.array(y, bool)) > 0.97


def test_interactions_of_terms_common_in_both_classes():
    """Each term is as common in toxic as in clean texts, and the production defaults still learn the pair."""
    rng = np.random.default_rng(9)
    rows, y = [], []
    for k in range(2000):
        a, b = k % 2, (k // 2) % 2
        at = np.unique(np.array([10] * a + [20] * b + list(rng.integers(1000, 1100, 3)), dtype=np.int32))
        rows.append((at, np.ones(len(at), np.float32)))
        y.append(a == b)
    model = toxicity.fit(rows, np.array(y, float))
    assert model.place[10] >= 0 and model.place[20] >= 0
    says = [model.margin(r[0]) > 0 for r in rows]
    assert np.mean(np.array(says) == np.array(y, bool)) > 0.97


def test_factorization_machine_by_hand():
    """The margin against a double loop over pairs; a step of training lowers the loss of its text."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 50, 12)).astype(np.int32), None) for _ in range(60)]
    model = toxicity.fit(rows, (rng.random(60) < 0.5).astype(float), epochs=2)
    for at, _ in rows:
        k = [int(model.place[a]) for a in at if model.place[a] >= 0]
        pairs = sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(k) for b in k[i + 1 :])
        assert abs(model.margin(at) - (model.bias + sum(float(model.weight[a]) for a in k) + pairs / max(1, len(k)))) < 1e-5


def test_regularised_leader_by_hand():
    """Against the published update, one coordinate at a time in dictionaries."""
    rng = np.random.default_rng(7)
    rows = [(np.unique(rng.integers(0, 30, 6)).astype(np.int32),) for _ in range(40)]
    rows = [(i, rng.random(len(i)).astype(np.float32)) for (i,) in rows]
    y = np.array([k % 2 for k in range(40)], float)
    model = quality_model.fit(rows, y, epochs=2)
    z, n, bias, order = Counter(), Counter(), 1 << quality_model.BITS, np.random.default_rng(9)

    def leader(k):
        l1 = 0 if k == bias else 0.05
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - np.sign(z[k]) * l1) / (1 + n[k] ** 0.5 + 0.5)

    for _ in range(2):
        for r in order.permutation(40):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist())), bias: 1.0}
            w = {k: leader(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                g = (p - y[r]) * x[k]
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) * w[k]
                n[k] += g * g
    assert abs(model.bias - leader(bias)) < 1e-6 and max(abs(model.weight[k] - leader(k)) for k in range(30)) < 1e-6


def test_training_rows_are_bounded(spark):
    """The rows of least hash, as long as their features together stay within the bound."""
    rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(10))) for i in range(200)] + [(7, "again")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (6, 3)], "doc_id bigint, y int")
    fit = lambda rows, y: (len(rows), float(np.sum(y)), sum(len(r[0]) for r in rows))
    run = lambda per_class, most: labelled.train(rows, labels, "y", F.lit(True), per_class, most, toxicity.terms, fit)
    assert run(1000, 10**9)[:2] == (201, 101.0) and run(30, 10**9)[0] in (60, 61)
    n, _, terms = run(1000, 500)
    assert 0 < terms <= 1000 and n < 100 and run(0, 10) == (0, 0.0, 0)


def test_fold(spark):
    got = spark.range(50).select("id", labelled.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_wrapper(spark, empty):
    page = lambda k, n, extra="": f'<html><head><title>t{k}</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>menu</a></nav><!-- c --><div class="content"><h1>Head {k}</h1>' + "".join(f"<p>Part {k} {i} &amp; more<br>x</p>" for i in range(n)) + f'</div>{extra}<div class="comments"><p>say {k}</p></div><footer>foot</footer></body></html>'
    rows = [(k, f"http://h{k % 2}.org/{k}", page(k, 1 + k % 3, '<div class="ad">buy</div>' if k % 4 == 0 else "")) for k in range(9)]
    rows += [(90, None, None), (91, "not a url", ""), (92, "http://other.org/x", "plain <b>te</b>xt"), (0, rows[0][1], rows[0][2])]
    got = html_wrapper.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 90:
            assert r.text == f"Head {r.page_id} " + " ".join(f"Part {r.page_id} {i} & more x" for i in range(1 + r.page_id % 3))
        assert r.n_chars == len(r.text)
    assert {r.page_id: r.text for r in got if r.page_id >= 90} == {90: "", 91: "", 92: "plain text"}
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_wrapper.main_texts(none).count() == 0


def test_wrapper_expression(spark):
    """Mismatches become optional and repeated groups and slots; the wrapper is the same in any order and number of tasks."""
    page = lambda k: f"<body>{'<div class=ad>x</div>' if k % 2 else ''}<article><h1>H {k}</h1>{''.join(f'<p>P {k} {i}' for i in range(k % 3))}<ul><li>a<li>b<li>c</ul></article></body>"
    pages = spark.createDataFrame([(f"http://h.org/{k}", page(k)) for k in range(12)], "url string, html string")
    shown = {html_wrapper.expression(html_wrapper.infer_wrappers(pages.repartition(n)).collect()) for n in (1, 5)}
    assert shown == {"<body>(<div.ad!>#</>)?<article><h1>#</>((<p>#</>)+)?<ul>(<li>#</>)+</></></>"}


def brute_text(page):
    """Text of the article element of a simple page, by cutting it out."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)
    plain = re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>|<!--.*?-->", "", re.sub("<br>", " ", inner[1] if inner else ""))
    blocks = re.split(r"</?(?:p|h1|h2|div|ul|li|table|tr|td|blockquote)[^>]*>", plain)
    return " ".join(" ".join(html.unescape(x).split()) for x in blocks if x.strip())


def test_wrapper_decides_where_marks_are_missing(spark):
    """Templates without telling names: a page alone takes its long notice for the article, the host's pages together don't."""
    note = "We value what you read here and so on and so forth. " * 6
    page = lambda k, n: f"<body><div><div><b>Menu</b></div><div>{note}</div><div>{''.join(f'<p>Story {k} part {i} tells something new.</p>' for i in range(n))}</div></div></body>"
    rows = [(k, f"http://h.org/{k}", page(k, 30 if k else 1)) for k in range(6)]
    got = {r.page_id: r.text for r in html_wrapper.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for k in range(6):
        assert got[k] == " ".join(f"Story {k} part {i} tells something new." for i in range(30 if k else 1))
    assert html_wrapper.main_text(rows[0][2]) != got[0]


def test_article_by_roles():
    say = html_wrapper.main_text
    assert say("<article><p>a</p><svg/><p>b</p></article>") == "a b" == say('<article><p>a</p><iframe src="x"/><p>b</p></article>')
    assert say("<head><title>never closed<body><article><p>a</p></article>") == "a"
    assert say('<article><p>a</p><ul><li class="comment"><p>me too</p></li></ul><table><tr><td class="ad"><p>buy</p></td></tr></table><p>b <span class="ad">now <b>!</b></span> c</p></article>') == "a b c"
    for name in ("related-work", "search-results", "form", "share-price"):
        assert say(f'<article><p>a</p><section class="{name}"><p>b</p></section></article>') == "a b"
    for name in ("sidebar-left", "commentList", "ad-banner", "related-posts"):
        assert say(f'<article><p>a</p><div class="{name}"><p>b</p></div></article>') == "a"
    assert say("<article><p>so <math><mi>x</mi></math></p></article>") == "so x"
    assert say("<article><p>one<p>two<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == "one two x y 1 2 3"


def test_long_pages(spark):
    """Time in proportion to the page: many blocks, many unclosed elements, deep nesting."""
    many = "<article>" + "".join(f"<p>b{i}</p>" if i % 3 else f"<ul><li>b{i}</ul>" for i in range(100_000)) + "</article>"
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    odd = "<article>" + "<select>" * 5_000 + "<p>a</p>" + "<span class=ad>" * 5_000
    rows = [(0, "http://a.org/", many), (1, "http://b.org/", deep), (2, "http://c.org/", odd), (3, None, "x" * 3_000_000)]
    got = {r.page_id: r.text for r in html_wrapper.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == " ".join(f"b{i}" for i in range(100_000)) and got[1] == "text" and got[2] == "a" and len(got[3]) == 3_000_000


def test_pages_of_the_table(spark):
    """The given pages against cutting out the article element."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: brute_text(r.html or "") for r in pages.collect()}
    got = {r.page_id: r.text for r in html_wrapper.main_texts(pages).collect()}
    assert sum(got[k] == want[k] for k in want) / len(want) >= 0.99


def test_unclosed_and_self_closed_elements():
    blocks = lambda page: [b.text for b in html_wrapper.parse(page)]
    assert blocks('<p>a</p><svg class="i"/><p>rest</p>') == ["a", "rest"]
    for name in ("svg", "select", "object", "canvas"):
        assert blocks(f"<p>a</p><{name} x='>'>lost<p>rest</p>") == ["a", "rest"]
        assert blocks(f"<p>a</p><{name}>lost<p>rest</p><{name}>x</{name}><p>end</p>") == ["a", "rest", "end"]
        assert blocks(f"<p>a <{name}><g>no</g></{name}> b</p><{name}><p>no</p></{name}>") == ["a b"]
    assert blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds <math/> b</p><p>c</p>") == ["so x=2 holds b", "c"]
    assert blocks("<p>a</p><script>var x = '<p>no</p>'") == ["a"]


def test_wrapper_leaves_out_constant_blocks(spark):
    """Notices in plain elements inside the article, the same on all pages of a host; a host of one page keeps all."""
    page = lambda k: f"<body><article><div>Our menu</div><h1>Head {k}</h1><p>All rights belong to us.</p>" + "".join(f"<p>Part {k} {i}</p>" for i in range(1 + k % 3)) + "<p>Buy now!</p></article></body>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(9)] + [(20, "http://one.org/a", page(1)), (21, "http://one.org/b", page(1)), (22, "http://h.org/empty", "")]
    got = {r.page_id: r.text for r in html_wrapper.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    for k in range(9):
        assert got[k] == f"Head {k} " + " ".join(f"Part {k} {i}" for i in range(1 + k % 3))
    assert got[20] == got[21] == "Our menu Head 1 All rights belong to us. Part 1 0 Part 1 1 Buy now!" and got[22] == ""


def test_masked_lm(spark, docs, texts, empty):
    rng = random.Random(8)
    pairs = spark.createDataFrame([(i, " ".join(f"l{k} r{k}" for k in (rng.randrange(6) for _ in range(150)))) for i in range(200)], "doc_id bigint, text string")
    lexicon = masked_lm.lexicon_of(masked_lm.word_counts(pairs))
    net = masked_lm.train(pairs.coalesce(1), lexicon, rounds=2)
    right, wrong = (masked_lm.score_texts([t.encode()], masked_lm.Codes(lexicon), net)[1][0] for t in ("l1 r1 l2 r2 l3 r3", "l1 r2 l2 r3 l3 r1"))
    assert right > wrong
    got = masked_lm.pseudo_likelihood(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(word_list(r.text)) and (r.mean_log_likelihood is None) == (r.n_tokens == 0)
    assert masked_lm.pseudo_likelihood(empty).count() == 0


def test_masked_lm_by_hand(spark, monkeypatch):
    """Every word's probability by plain loops over the network's formula and the words' counts; all words together have 1."""
    for name, value in (("LISTED", 20), ("OWN", 8), ("SHARED", 4), ("PAD", 12), ("CLASSES", 10)):
        monkeypatch.setattr(masked_lm, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"a{k}" for k in range(30)], k=60)) for _ in range(30)] + [f"once{k} pair{k} pair{k} tail{k % 5}" for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    table = masked_lm.word_counts(docs)
    lexicon = masked_lm.lexicon_of(table)
    net = masked_lm.train(docs, lexicon)
    counts = Counter(w for t in texts for w in t.split())
    assert {r.h: r.c for r in table.collect()} == {masked_lm.xxhash.xxh3_64_intdigest(w) - (1 << 64) * (masked_lm.xxhash.xxh3_64_intdigest(w) >> 63): c for w, c in counts.items()}
    codes = masked_lm.Codes(lexicon)
    cls = {w: int(lexicon.cls[codes[w.encode()]]) for w in counts}
    mass = Counter()
    for w, c in counts.items():
        mass[cls[w]] += c
    assert all(abs(lexicon.mass[k] - m) < 1e-9 for k, m in mass.items()) and sum(codes[w.encode()] < 20 for w in counts) == 20

    def probability(around, word):
        h = sum(net.places[k][lexicon.row[codes[x.encode()]] if x else 12].astype(float) for k, x in enumerate(around)) + net.b
        z = np.tanh(h) @ net.out[:-1].astype(float) + net.out[-1]
        return np.exp(z[cls[word]]) / np.exp(z).sum() * counts[word] / mass[cls[word]]

    used = np.array(sorted(mass))
    for around in (("a1", "a2", "a3", "once1"), (None, None, "a7", "pair2")):
        h = sum(net.places[k][lexicon.row[codes[x.encode()]] if x else 12].astype(float) for k, x in enumerate(around)) + net.b
        z = np.exp(np.tanh(h) @ net.out[:-1].astype(float) + net.out[-1])
        assert abs(sum(probability(around, w) for w in counts) - z[used].sum() / z.sum()) < 1e-9
    for r in masked_lm.pseudo_likelihood(docs, keep=["doc_id"]).collect():
        w = [None, None, *texts[r.doc_id].split(), None, None]
        assert abs(r.log_likelihood - sum(np.log(probability((w[i - 2], w[i - 1], w[i + 1], w[i + 2]), w[i])) for i in range(2, len(w) - 2))) < 1e-3


def test_masked_lm_tells_words_of_a_class_apart(spark, monkeypatch):
    """With one class for all listed words only what divides it can see that a word doesn't fit its neighbours."""
    monkeypatch.setattr(masked_lm, "CLASSES", 2)
    rng = random.Random(8)
    pairs = spark.createDataFrame([(i, " ".join(f"l{k} r{k}" for k in (rng.randrange(6) for _ in range(150)))) for i in range(200)], "doc_id bigint, text string")
    lexicon = masked_lm.lexicon_of(masked_lm.word_counts(pairs))
    net = masked_lm.train(pairs.coalesce(1), lexicon, rounds=2)
    right, wrong = (masked_lm.score_texts([t.encode()], masked_lm.Codes(lexicon), net)[1][0] for t in ("l1 r1 l2 r2 l3 r3", "l1 r2 l2 r3 l3 r1"))
    assert right > wrong + 1


def test_masked_lm_within_classes_by_hand(spark, monkeypatch):
    """Parts and branches by plain loops; all words of a class together have its probability, also words that aren't listed."""
    for name, value in (("LISTED", 20), ("OWN", 8), ("SHARED", 4), ("PAD", 12), ("CLASSES", 4), ("SUBS", 3), ("LEAST", 8)):
        monkeypatch.setattr(masked_lm, name, value)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"a{k}" for k in range(30)], weights=range(1, 31), k=60)) for _ in range(30)] + [f"once{k} pair{k} pair{k} tail{k % 5}" for k in range(12)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    lexicon = masked_lm.lexicon_of(masked_lm.word_counts(docs))
    tree, net = lexicon.tree, masked_lm.train(docs, lexicon)
    counts = Counter(w for t in texts for w in (t or "").split())
    code = {w: masked_lm.Codes(lexicon)[w.encode()] for w in counts}

    def branches(w):
        return [(int(x) >> 1, int(x) & 1) for x in tree.path[tree.first[code[w]] :][: tree.depth[code[w]]]]

    def place(w):
        return lexicon.cls[code[w]], tree.part[code[w]], tuple(branches(w))

    left = Counter()
    for w, c in counts.items():
        left[place(w)] += c
    assert sum(len({w for w in counts if place(w) == x}) > 1 for x in left) >= 1 and sum(len(x[2]) > 1 for x in left) > 5  # some words stay together, most are told apart
    assert all(n < 8 or len({code[w] for w in counts if place(w) == x}) == 1 for x, n in left.items())

    def hidden(around):
        return np.append(np.tanh(sum(net.places[k][lexicon.row[code[x]] if x else 12].astype(float) for k, x in enumerate(around)) + net.b), 1.0)

    def probability(around, w):
        h, (cls, part, path) = hidden(around), place(w)
        a, b = np.exp(h @ net.out.astype(float)), np.exp(h @ net.inner[cls].astype(float))
        p = a[cls] / a.sum() * b[part] / b.sum()
        for node, side in path:
            p /= 1 + np.exp((1 - 2 * side) * (h @ net.nodes[node].astype(float)))
        return p * counts[w] / left[place(w)]

    for around in (("a1", "a2", "a3", "once1"), (None, None, "a7", "pair2")):
        a = np.exp(hidden(around) @ net.out.astype(float))
        assert all(abs(sum(probability(around, w) for w in counts if place(w)[0] == c) - a[c] / a.sum()) < 1e-6 for c in {place(w)[0] for w in counts})
    one, other = (probability(x, "a29") / probability(x, "a1") for x in (("a1", "a2", "a3", "a4"), ("a9", "a8", "a7", "a6")))
    assert abs(one - other) > 1e-6
    for r in masked_lm.pseudo_likelihood(docs, keep=["doc_id"]).collect():
        w = [None, None, *(texts[r.doc_id] or "").split(), None, None]
        assert abs(r.log_likelihood - sum(np.log(probability((w[i - 2], w[i - 1], w[i + 1], w[i + 2]), w[i])) for i in range(2, len(w) - 2))) < 1e-3


def test_masked_lm_gradient_within_classes():
    """Steps on parts and branches go along the gradient, and what they send back to the input too."""
    rng = np.random.default_rng(4)
    cls, counts = np.repeat(np.arange(masked_lm.CLASSES), 300), rng.integers(1, 300, 300 * masked_lm.CLASSES)
    tree = masked_lm.Tree.of(cls, counts)
    net = masked_lm.Network(*(x.astype(np.float64) for x in vars(masked_lm.Network.start(np.bincount(cls, counts), tree)).values()))
    net.inner += rng.normal(0, 0.2, net.inner.shape)
    net.nodes += rng.normal(0, 0.2, net.nodes.shape)
    codes = np.sort(rng.integers(0, len(cls), 64))
    around, target = list(rng.integers(0, 50, (4, 64)).astype(np.int32)), cls[codes]
    state = masked_lm.State(net)
    for k in ("places", "b", "out", "inner", "nodes"):
        setattr(state, k, getattr(state, k).astype(np.float64))
    moved = masked_lm.Network(*(x.copy() for x in vars(net).values()))
    moved.log_likelihood(around, target, (state, 0.05), (tree, codes))
    node = int(tree.path[tree.first[codes[9]]] >> 1)
    assert tree.depth[codes[9]] > 1
    for name, at in (("places", (1, int(around[1][0]), 3)), ("b", (5,)), ("inner", (int(target[9]), 2, int(tree.part[codes[9]]))), ("inner", (int(target[9]), masked_lm.HIDDEN, 1)), ("nodes", (node, 4)), ("nodes", (node, masked_lm.HIDDEN))):
        value = []
        for d in (1e-5, -1e-5):
            other = masked_lm.Network(*(x.copy() for x in vars(net).values()))
            getattr(other, name)[at] += d
            value.append(other.log_likelihood(around, target, words=(tree, codes)).mean())
        slope = (value[0] - value[1]) / 2e-5
        assert np.sign(getattr(moved, name)[at] - getattr(net, name)[at]) == np.sign(slope)
        if name in ("b", "inner"):
            assert abs(np.sqrt(getattr(state, name)[at] - 1e-6) - abs(slope)) < 1e-5
    assert moved.log_likelihood(around, target, words=(tree, codes)).mean() > net.log_likelihood(around, target, words=(tree, codes)).mean()


def test_masked_lm_words_in_bulk(monkeypatch):
    """Words looked up all at once, before and after the table is emptied, against a plain split; null and empty texts between."""
    rng = random.Random(6)
    words = [b"a" * n for n in (*range(1, 30), 63, 64, 65, 66, 200)] + [b"b" * 64 + b"c", b"b" * 64 + b"d", b"\x00", b"a\x00", b"\x1c", b"\x85\xa0", "é漢字".encode(), b"ABC"] + [b"w%d" % k for k in range(900)]
    texts = [None, b"", b" \t\n\v\f\r", *(b"\t \v".join(rng.choices(words, k=60)) + rng.choice([b"", b" \r\f"]) for _ in range(50)), None, b"end"]
    h = np.sort(np.array([masked_lm.xxhash.xxh3_64_intdigest(w.lower()) for w in words[::2]], np.uint64))
    z = np.zeros(masked_lm.RARE + len(h), np.int32)
    lexicon = masked_lm.Lexicon(h, np.arange(len(h), dtype=np.int32)[::-1], z, z, z, z, masked_lm.Tree.of(z, z))
    keys_of = masked_lm.word_keys
    for most, bits in ((400_000, 64), (300, 64), (0, 64), (400_000, 47), (400_000, 44)):  # few bits: many words for few slots
        monkeypatch.setattr(masked_lm, "word_keys", lambda *x, bits=bits: keys_of(*x) >> np.uint64(64 - bits) | np.uint64(1))
        monkeypatch.setattr(masked_lm.Codes, "MOST", most)
        codes = masked_lm.Codes(lexicon)
        for _ in range(2):
            for some in (texts, texts[::-1], [], [None], [b"one"]):
                found, at, owner, hashes = masked_lm.windows(some, codes)
                plain = [(k, w) for k, t in enumerate(some) for w in (t or b"").lower().split()]
                assert owner.tolist() == [k for k, _ in plain] and hashes.tolist() == [masked_lm.xxhash.xxh3_64_intdigest(w) for _, w in plain]
                assert found[at].tolist() == [lexicon.code_of(w) for _, w in plain]
                assert len(found) == len(plain) + masked_lm.REACH * (len(some) + 1) and (np.delete(found, at) == -1).all()


def test_masked_lm_gradient():
    """One step goes along the gradient, found by differences; steps on a batch make it likelier."""
    rng = np.random.default_rng(4)
    net = masked_lm.Network.start(rng.integers(1, 100, masked_lm.CLASSES).astype(float))
    around, target = list(rng.integers(0, 50, (4, 64)).astype(np.int32)), rng.integers(0, masked_lm.CLASSES, 64)
    before = masked_lm.Network(*(x.astype(np.float64) for x in vars(net).values()))
    state = masked_lm.State(before)
    start = {k: getattr(state, k).astype(np.float64) for k in ("places", "b", "out")}
    for k, v in start.items():
        setattr(state, k, v.copy())
    moved = masked_lm.Network(*(x.copy() for x in vars(before).values()))
    moved.log_likelihood(around, target, (state, 0.05))
    for name, at in (("places", (1, int(around[1][0]), 3)), ("b", (5,)), ("out", (2, int(target[0]))), ("out", (masked_lm.HIDDEN, 7))):
        value = []
        for d in (1e-5, -1e-5):
            other = masked_lm.Network(*(x.copy() for x in vars(before).values()))
            getattr(other, name)[at] += d
            value.append(other.log_likelihood(around, target).mean())
        slope = (value[0] - value[1]) / 2e-5
        assert np.sign(getattr(moved, name)[at] - getattr(before, name)[at]) == np.sign(slope)
        if name != "places":
            assert abs(np.sqrt(getattr(state, name)[at] - start[name][at]) - abs(slope)) < 1e-6
    state, first = masked_lm.State(net), net.log_likelihood(around, target).mean()
    for _ in range(20):
        net.log_likelihood(around, target, (state, 0.05))
    assert net.log_likelihood(around, target).mean() > first + 0.5


def test_masked_lm_sums_of_groups():
    """Groups of one row, of few and of many, against plain sums in order; none at all."""
    rng = np.random.default_rng(9)
    for keys in (np.repeat(np.arange(40), np.arange(1, 41)), np.zeros(30, int), np.arange(25), rng.integers(0, 300, 900), np.repeat([3, 5, 8], [8, 9, 7])):
        keys = rng.permutation(keys)
        rows = rng.standard_normal((len(keys), 4)).astype(np.float32)
        got = masked_lm._sums(rows, *masked_lm._groups(keys))
        assert got.dtype == rows.dtype and len(got) == len(set(keys.tolist()))
        for g, key in zip(got, sorted(set(keys.tolist()))):
            assert np.allclose(g, rows[keys == key].astype(float).sum(axis=0), atol=1e-5)


def test_bitmap(spark):
    ids = spark.range(100).toDF("k")
    bits = common.membership(ids, "k")
    assert common.members_only(ids, "k", bits).count() == 100 and common.members_only(spark.range(10_000, 10_200).toDF("k"), "k", bits).count() < 5


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, keep=["doc_id"]).filter("kept").collect()}
    assert kept == {i for i, t in texts.items() if i in kept} and all(stats_by_hand(texts[i])[0] >= 50 for i in kept)
    items = [(i, texts[i]) for i in sorted(kept)]
    gone = runs_by_hand(items)
    items = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]), bool(gone[i])) for i, t in items]
    items = [(i, t) for i, t, changed in items if word_list(t) or not changed]
    least = components_by_hand(items)
    items = [(i, t) for i, t in items if least[i] == i]
    bench = [shingle_set(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items = [(i, t) for i, t in items if not any(q and 100 * len(q & shingle_set(t)) >= 80 * len(q) for q in bench)]
    tool = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    want = {i: len(tool.encode(t)) // 4 for i, t in items}
    assert {r.doc_id: r.n_tokens for r in P.run(spark, DATA).collect()} == want
    assert [n for n, _ in P.STAGES][0] == "quality_rules"


def test_queries_are_registered():
    from lakesift.llm import queries

    names = set(queries.queries()) - {"base_statistics"}
    assert sorted(int(n.removeprefix("op").split("_")[0]) for n in names) == list(range(1, 11))


def test_line_dedup_of_a_text_that_repeats_itself(spark):
    """Work stays in proportion to the lines, whatever the period; a window of all documents is no hot key."""
    rng = random.Random(17)
    one, three = ["word " * 3] * 200_000, ["a b c", "d e f", "g h i"] * 60_000
    rows = [(0, "\n".join(one)), (1, "\n".join(three)), (2, "\n".join(["x y", *three[:9], "", "z"]))]
    rows += [(10 + k, "\n".join([f"own {k}", "same one", "same two", "same three", f"tail {k} {rng.random()}"])) for k in range(500)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].text == one[0] and got[0].n_deleted == 199_999
    assert got[1].text == "\n".join(three[:3]) and got[2].text == "x y\nz"
    assert got[10].n_deleted == 0 and all(got[10 + k].n_deleted == 3 for k in range(1, 500))
