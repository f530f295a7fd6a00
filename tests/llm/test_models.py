"""Models against brute force, ties and repeated rows, clashing names, texts above a kernel's block."""

import collections
import math
import random

import numpy as np

from streamloom.llm import ann, langid, minhash, mixing, pii, quality, suffix_dedup, toxicity
from streamloom.llm.common import BLOCK_BYTES


# -- toxicity ----------------------------------------------------------------------------------


def _spelled(words):
    """(beginnings with their counts by class, without what follows a beginning that occurs once) of {word: [n0, n1]}."""
    n = collections.defaultdict(lambda: [0, 0])
    for word, counts in words.items():
        w = (word + b"\n")[: toxicity.DEPTH]
        for k in range(1, len(w) + 1):
            for c in (0, 1):
                n[w[:k]][c] += counts[c]
    return {b: v for b, v in n.items() if len(b) == 1 or sum(n[b[:-1]]) > 1}


def _naive(words):
    """P_c(x | h) as a function, straight from the definition."""
    n = _spelled(words)
    total = {b: sum(v) for b, v in n.items()}
    n1, n2 = sum(t == 1 for t in total.values()), sum(t == 2 for t in total.values())
    D = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
    three = collections.Counter(b.rjust(3, b"\0")[-3:] for b in n)
    two = collections.Counter(t[1:] for t in three)
    one = collections.Counter(t[1:] for t in two)

    def level(counts, x, lower):
        N = sum(counts.values())
        return max(counts.get(x, 0) - D, 0) / N + D * len(counts) / N * lower if N else lower

    def after(table, h):
        return {t[-1]: v for t, v in table.items() if t[:-1] == h}

    def shared(h, x):
        last = (b"\0\0" + h)[-2:]
        p = level(after(one, b""), x, 1 / 256)
        p = level(after(two, last[1:]), x, p)
        p = level(after(three, last), x, p)
        return level({b[-1]: t for b, t in total.items() if b[:-1] == h}, x, p)

    def of(c, h, x):
        own = {b[-1]: v[c] for b, v in n.items() if b[:-1] == h and v[c]}
        return (max(own.get(x, 0) - D, 0) + (D * len(own) + toxicity.STRENGTH) * shared(h, x)) / (sum(own.values()) + toxicity.STRENGTH)

    return n, of


def _words(seed, n=60):
    r = random.Random(seed)
    return {bytes(r.choice(b"abc") for _ in range(r.randint(1, 14))): [r.randint(0, 3), r.randint(0, 2)] for _ in range(n)}


def _tree(words):
    rows = sorted((((w + b"\n")[: toxicity.DEPTH].ljust(toxicity.DEPTH, b"\0")), c) for w, c in words.items() if sum(c))
    flat = np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(-1, toxicity.DEPTH)
    counts = np.array([c for _, c in rows])
    t = toxicity.tree(flat, counts.sum(1))
    sums = np.concatenate([np.zeros((1, 2), int), np.cumsum(counts, 0)])
    return t, sums[t.row_end] - sums[t.row], flat


def test_toxicity_models_match_the_definition_and_add_up_to_1():
    for seed in range(4):
        words = {w: c for w, c in _words(seed).items() if sum(c)}
        known, p = _naive(words)
        for h in [b"", *sorted(known)[::7]]:
            if h == b"" or known[h] and sum(known[h]) > 1 and not h.endswith(b"\n") and len(h) < toxicity.DEPTH:
                for c in (0, 1):
                    assert math.isclose(sum(p(c, h, x) for x in range(256)), 1, abs_tol=1e-9)
        t, n, flat = _tree(words)
        got, _ = toxicity.probabilities(t, n)
        names = [flat[r, : k + 1].tobytes() for r, k in zip(t.row, t.level)]
        assert sorted(names) == sorted(known)
        for i, b in enumerate(names):
            assert np.allclose(got[i], [p(0, b[:-1], b[-1]), p(1, b[:-1], b[-1])], rtol=1e-9)


def test_toxicity_evidence_of_words_matches_the_definition():
    words = {w: c for w, c in _words(11, 200).items() if sum(c)}
    known, p = _naive(words)
    t, n, _ = _tree(words)
    model = toxicity.build(t, n)
    ask = [*list(words)[:40], b"abcabcabcabcabc", b"zzz", b"aaz", b"b"]

    def naive(word):
        w, e = (word + b"\n")[: toxicity.DEPTH], 0.0
        for k in range(len(w)):
            if k and sum(known.get(w[:k], [0, 0])) < 2:
                break  # no history
            e += math.log(p(1, w[:k], w[k]) / p(0, w[:k], w[k]))
        return math.copysign(max(abs(e) - toxicity.MARGIN, 0), e)

    buf = np.frombuffer(b" ".join(ask), np.uint8)
    end = np.cumsum([len(w) + 1 for w in ask]) - 1
    got = toxicity.evidence_of_words(model, toxicity._Index(model.keys), buf, end - [len(w) for w in ask], end)
    assert np.allclose(got, [naive(w) for w in ask], atol=1e-4)


def test_forms_of_a_toxic_stem_are_found(spark):
    r = random.Random(3)
    part = lambda: "".join(r.choice(["ka", "lo", "mi", "ner", "tu", "vas"]) for _ in range(r.randint(2, 4)))
    rows = []
    for k in range(800):
        bad = k % 5 == 0
        w = [part() for _ in range(80)] + ["grok" + part() for _ in range(3 if bad else 0)]
        r.shuffle(w)
        rows.append((k, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.where("doc_id < 500").select("doc_id", "toxic"))
    held = toxicity.score(docs.where("doc_id >= 500"), model).collect()
    assert sum((x.score >= 0.3) == bool(x.toxic) for x in held) >= 0.98 * len(held)


def test_every_byte_of_long_words_is_spelled():
    texts = [b"", b"short ones", b"a" * 12 + b" " + b"b" * 13 + b"-" + b"c" * 24, "\u8a9e".encode() * 50, b"...", b"d" * 1000]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, start, end, first = toxicity.spelled(buf, offs)
    covered = np.zeros(len(buf), int)
    for a, b in zip(start, end):
        covered[a:b] += 1
    assert (covered == toxicity._KEEP[buf]).all() and (end - start <= toxicity.DEPTH).all() and len(h) == len(start)
    assert np.diff(first).tolist() == [sum(-(-len(w) // 12) for w in t.replace(b"-", b" ").replace(b".", b" ").split()) for t in texts]


def test_toxic_ends_of_long_words_are_found(spark):
    r = random.Random(5)
    part = lambda: "".join(r.choice(["ka", "lo", "mi", "ner", "tu", "vas"]) for _ in range(r.randint(2, 4)))
    rows = []
    for k in range(800):
        bad = k % 5 == 0
        w = [part() for _ in range(80)] + ["unverkennbar" + ("grok" if bad else "") + part() for _ in range(3)]
        r.shuffle(w)
        rows.append((k, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.where("doc_id < 500").select("doc_id", "toxic"))
    held = toxicity.score(docs.where("doc_id >= 500"), model).collect()
    assert sum((x.score >= 0.3) == bool(x.toxic) for x in held) >= 0.98 * len(held)


def test_texts_above_a_block(spark):
    long = "word other " * (BLOCK_BYTES // 8)
    docs = spark.createDataFrame([(1, long), (2, "short one here"), (3, long + "word")], "doc_id long, text string")
    assert len(long) > BLOCK_BYTES
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, toxic int, quality int")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.train(docs, labels, label)
        got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
        assert len(got) == 3 and all(0 <= v <= 1 for v in got.values())
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1].n_removed == len(long) and got[2].n_removed == 0 and got[3].n_bytes == len(long) + 4
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 1}


# -- language, quality -------------------------------------------------------------------------


def test_language_code_lengths_match_brute_force():
    r = random.Random(5)
    texts = {"p": "".join(r.choice("aab cd") for _ in range(300)).encode(), "q": "".join(r.choice("bccd a") for _ in range(250)).encode()}
    grams = {k: collections.Counter() for k in texts}
    for k, t in texts.items():
        for i in range(len(t)):
            grams[k][sum((256 if i - j < 0 else t[i - j]) << (9 * j) for j in range(langid.ORDER + 1))] += 1
    names = np.array([k for k in texts for _ in grams[k]], object)
    flat = [(g, n) for k in texts for g, n in grams[k].items()]
    m = langid.build(sorted(texts), names, np.array([g for g, _ in flat]), np.array([n for _, n in flat]))
    used = sorted(set(b"".join(texts.values())))
    pooled = collections.Counter()
    for k in texts:
        for g, n in grams[k].items():
            pooled[g >> 9] += n

    def probability(language, context, b):
        """P(b) after the context (bytes before, nearest first, 256 before the start), by escapes and exclusion."""
        def level(k):
            own = collections.Counter()
            for g, n in grams[language].items():
                if all((g >> (9 * (j + 1))) & 511 == context[j] for j in range(k)):
                    own[g & 511] += n
            lower = level(k - 1) if k else dict.fromkeys(range(256), 1 / 256)
            if not own:
                return lower
            N, kinds = sum(own.values()), len(own)
            rest = sum(lower[x] for x in range(256) if x not in own)
            return {x: own[x] / (N + kinds) if x in own else kinds / (N + kinds) * lower[x] / rest for x in range(256)}

        deep = pooled[sum(c << (9 * j) for j, c in enumerate(context))] > 1
        return level(3 if deep else 2)[b]

    A = m.costs.shape[1]
    for _ in range(60):
        context, b = tuple(r.choice(used) for _ in range(3)), r.choice([*used, 200])
        node = m.nodes[(m.rank[context[2]] * A + m.rank[context[1]]) * A + m.rank[context[0]]]
        for k, language in enumerate(sorted(texts)):
            assert math.isclose(m.costs[node, m.rank[b], k], -math.log2(probability(language, context, b)), abs_tol=1e-4)


def test_attention_gradient_matches_finite_differences():
    rng = np.random.default_rng(2)
    x, first = rng.normal(size=(11, quality.DIM)), np.array([0, 3, 4, 8, 11])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    shapes = {"E": (quality.DIM, quality.HIDDEN), "e": (quality.HIDDEN,), "V": (quality.HIDDEN, quality.GATE), "U": (quality.HIDDEN, quality.GATE), "a": (quality.GATE,), "c": (quality.HIDDEN,), "d": (1,)}
    w = {k: rng.normal(0, 0.2, s) for k, s in shapes.items()}

    def loss():
        p = quality._forward(w, x, first)[-1]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    g = quality.gradient(w, x, first, y, weight)
    for k in shapes:
        for i in rng.integers(0, w[k].size, 5):
            at = np.unravel_index(i, w[k].shape)
            keep = w[k][at]
            w[k][at] = keep + 1e-6
            up = loss()
            w[k][at] = keep - 1e-6
            down = loss()
            w[k][at] = keep
            assert math.isclose(g[k][at], (up - down) / 2e-6, abs_tol=1e-6)


# -- neighbours, terms, mixing, passages -----------------------------------------------------------


def test_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(1)
    base, ids = rng.normal(size=32), rng.permutation(600)
    cases = [[(int(i), base * (0.5 + rng.random())) for i in ids], [(int(i), np.eye(600)[j]) for j, i in enumerate(ids)], [(int(i), base) for i in ids]]
    for rows in cases:
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
        got = ann.search(df, df.where("vec_id in (0, 50)")).orderBy("query_id", "rank").collect()
        assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_large_cells_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.outer(0.5 + rng.random(300), rng.normal(size=8)), rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(df, df.where("vec_id % 50 = 0")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 50):
        c = np.round(u @ u[q], 12)
        c[q] = -9
        hit += len({got[q, k] for k in range(1, 6)} & set(np.lexsort((np.arange(600), -c))[:5].tolist()))
    assert hit >= 0.9 * 60


def test_disclosures_match_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(25)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(6)) + (f" user{r.randint(0, 3)}@x.com" if r.random() < 0.4 else "") for _ in range(60)]
    texts += texts[:10]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    based = pii._based(df, "text", "doc_id")
    got = {(x.entity, x.term): x.disclosure for x in pii.disclosures(df, based, "text").collect()}
    sets = [({w for w in t.split() if "@" in w}, {w for w in t.split() if "@" not in w}, t) for t in texts]
    want = {}
    for e in set().union(*(s[0] for s in sets)):
        n_e = sum(e in s[0] for s in sets)
        if len({s[2] for s in sets if e in s[0]}) < pii.SUPPORT:
            continue
        for term in vocabulary:
            both = [s for s in sets if e in s[0] and term in s[1]]
            if len({s[2] for s in both}) < pii.SUPPORT:
                continue
            n_t, info = sum(term in s[1] for s in sets), -math.log2(n_e / len(sets))
            d = math.log2(len(both) * len(sets) / (n_t * n_e)) / info
            if d >= pii.GENERALISE:
                want[e, term] = d
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_rows_that_repeat_an_id_have_the_terms_of_their_own_text(spark):
    a, b = "Mister Fonseca of Acme a@b.com", "Other words entirely a@b.com then Fonseca and Acme"
    df = spark.createDataFrame([(0, a), (0, b), (1, "lone word")], "doc_id long, text string")
    got = [sorted((a if r.email[0].start == 23 else b)[t.start : t.end] for t in r.term) for r in pii.find(df).collect() if r.email]
    assert got == [["Acme", "Fonseca"]] * 2


def test_repeated_rows_share_what_the_mix_takes(spark):
    df = spark.createDataFrame([(7, "a", 10)] * 3 + [(1, "b", 100), (2, "c", 20)], "doc_id long, source string, size long")
    got = mixing.taken(df).collect()
    assert all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got if r.doc_id == 7) == 90


def test_names_that_clash(spark):
    rows = [(7, "a", "x y z", "p", 1, 2), (7, "a", "x y z", "q", 3, 4), (8, "b", "u v w " * 9, "r", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, dropped_id string, epoch int, mix_from int")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {r.dropped_id for r in mixed.collect()} == {"p", "q", "r"}
    assert minhash.drop_near_duplicates(df).columns == df.columns


def test_shared_passages_match_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5)))
    fifty, thirty = [word() for _ in range(50)], [word() for _ in range(30)]
    free = lambda n: [word() + str(r.random())[2:6] for _ in range(n)]
    rows = [free(30) + fifty + free(5), fifty, free(60), free(20) + thirty + free(20), thirty + free(40), free(3), [], free(10) + fifty[:49] + free(10)]
    df = spark.createDataFrame([(i, " ".join(w) if w else None) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.n_passages for x in suffix_dedup.remove_repeats(df).collect()}
    assert got[0] > 0 and got[1] > 0 and not any(got[i] for i in (2, 3, 4, 5, 6))


def test_strings_of_one_name_are_compared_by_their_bytes():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 120, 1500).astype(np.uint8)
    pieces = [base[a : a + n].copy() for a, n in zip(rng.integers(0, 1000, 12), rng.integers(400, 500, 12))]
    for x in pieces[::3]:
        x[rng.integers(0, len(x))] ^= 1
    buf, count = np.concatenate(pieces), np.array([len(x) for x in pieces]) - suffix_dedup.LENGTH + 1
    start = np.arange(count.sum()) + np.repeat((suffix_dedup.LENGTH - 1) * np.arange(12), count)
    strings = [buf[i : i + suffix_dedup.LENGTH].tobytes() for i in start]
    n = collections.Counter(strings)
    for names in (5, 2**60):  # with collisions and without
        name = np.array([hash(s) % names for s in strings], np.uint64)
        got = suffix_dedup._equal_strings(buf, start, name, np.ones(len(start), np.int64))
        assert got.tolist() == [n[s] > 1 for s in strings]
