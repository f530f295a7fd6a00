"""Training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from streamloom.llm import ann, bpe, exact_dedup, langid, minhash, mixing, pii, quality, queries, suffix_dedup, toxicity
from streamloom.llm.common import fold, text_blocks

from ..compare import SMALL, duck, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
LONG = "lorem ipsum dolor " * 3000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, one-byte and very long texts, copies, repeated rows, and columns that clash with outputs."""
    t = [(1, None, None, None), (2, "", "en", "a"), (3, "x", None, "b"), (4, LONG, "en", None), (5, LONG, "de", "a"), (6, "the quick brown fox jumps over it", "en", "a"), (6, "the quick brown fox jumps over it", "en", "a"), (None, "no id here at all friends", "fr", "z"), (7, "漢字 🙂 ß" * 20, "de", "b"), (8, "   \n\t ", "en", "b")]
    return spark.createDataFrame([(i, x, lang, s, len(x or ""), 0.5, "?") for i, x, lang, s in t], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# -- language ----------------------------------------------------------------------------------


def test_language_is_learned_and_held_out(spark):
    got = queries.op1_ppm_language(spark, "/root/testdata/sf0.01").toPandas().merge(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").df(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]


def test_language_costs_are_a_code():
    """In every kept context the probabilities of all bytes add up to 1, with escapes and exclusions."""
    r = random.Random(1)
    text = "".join(r.choice("abc ab") for _ in range(400)).encode()
    grams = {}
    for k in range(len(text)):
        g = sum((256 if k - j < 0 else text[k - j]) << (9 * j) for j in range(langid.ORDER + 1))
        grams[g] = grams.get(g, 0) + 1
    m = langid.build(["x"], np.array(["x"] * len(grams), object), np.array(list(grams)), np.array(list(grams.values())))
    A = m.costs.shape[1]
    spread = np.ones(A)
    spread[1] = 256 - (A - 2)
    total = (np.exp2(-m.costs[:, 1:, 0].astype(float)) * spread[1:]).sum(1)
    assert np.allclose(total, 1, atol=1e-4)


def test_language_of_odd_rows(spark, odd, none, docs):
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[8].lang_pred == "und" and by[3].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(none, model).count() == 0
    blank = langid.train(none)
    assert {r.lang_pred for r in langid.predict(odd, blank).collect()} == {"und"}


# -- neighbours --------------------------------------------------------------------------------


def _brute(v, q, k):
    ids = [i for i, x in v if x and all(a is not None and math.isfinite(a) for a in x) and any(x)]
    x = {i: np.array(e, float) for i, e in v if i in set(ids)}
    out = {}
    for i in q:
        if i in x:
            s = sorted((-(x[i] * x[j]).sum() / (np.sqrt((x[i] * x[i]).sum()) * np.sqrt((x[j] * x[j]).sum())), j) for j in ids if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def test_neighbours_recall_and_ties(spark):
    got = queries.op2_stable_projection_search(spark, "/root/testdata/sf0.01").toPandas()
    v = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    want = _brute(v, [i for i, _ in v if i % 50 == 0], 5)
    hits = sum(len(set(w) & set(got[got.query_id == q].vec_id)) for q, w in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_neighbours_of_odd_vectors(spark):
    v = [(k, [1.0, 0.0, 0.5]) for k in range(0, 40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 0.0]), (103, [1.0, float("nan"), 0.0]), (104, [2.0, 0.0, 1.0]), (105, [0.0, 1.0, 0.0]), (150, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
    few = df.where("vec_id in (0, 105)")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(few, few.where("vec_id = 0")).collect()] == [(0, 105, 0.0)]
    empty = df.where("false")
    assert ann.search(empty, empty).count() == 0
    assert abs(ann.chi_square_bound(0.95) - 15.507) < 1e-2


# -- tokens ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}), path


def test_tokens_equal_the_library(spark, docs, odd, none, reference):
    enc, path = reference
    for df in (docs, odd):
        got = bpe.encode_digests(df, path, P.PATTERN)
        got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect())
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_appends_and_edits_are_exact(reference):
    enc, path = reference
    v, r = bpe.Vocabulary(bpe.read_ranks(path)), random.Random(4)
    for _ in range(150):
        a = bytes(r.choice(b"thein gtion ") for _ in range(r.randrange(1, 200)))
        p = bpe.Prefixes(v, a[: len(a) // 2])
        p.append(a[len(a) // 2 :])
        assert p.tokens() == bpe.Prefixes(v, a).tokens()
        x = r.randrange(len(a))
        y, d = min(len(a), x + r.randrange(6)), bytes(r.choice(b"thein") for _ in range(r.randrange(5)))
        p.edit(x, y, d)
        assert p.tokens() == bpe.Prefixes(v, a[:x] + d + a[y:]).tokens()
        assert b"".join(v.tokens[t] for t in p.tokens()) == a[:x] + d + a[y:]


# -- exact copies ------------------------------------------------------------------------------


def test_exact_copies_match_sql(spark):
    con = duck()
    got = queries.op4_bloom_exact_dedup(spark, SMALL).toPandas()
    assert rows(got) == rows(con.execute(queries.ORACLE_SQL["op4_bloom_exact_dedup"]).df())


def test_exact_copies_of_odd_rows(spark, odd, none):
    got = exact_dedup.mark_copies(odd).collect()
    assert len(got) == odd.count()
    kept = sorted((r.doc_id or -1) for r in got if r.kept)
    assert kept == [-1, 2, 3, 5, 6, 7, 8]
    assert {r.group_size for r in got if r.doc_id in (4, 5, 6)} == {2}
    assert exact_dedup.drop_copies(odd).columns == odd.columns
    assert exact_dedup.mark_copies(none).count() == 0


# -- personal data -----------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(s)) % 10 == 0


def _spans(t):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_matches_python(spark, docs, odd, none):
    hard = ["a@b.com_foo@bar.co x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111-2", "+1 (555) 010-9999. +49 30 1234567 +1+2+3", "é@é.com ü a.b-c%d@x-y.z.w", "9" * 5000, "a" * 30000 + "@", "1 " * 4000, "@@ a@b a@b. a@.b"]
    hard = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for df in (hard, docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        got = sorted((r.doc_id or -1, r.base_sha256) for r in pii.digests(pii.find(df)).collect())
        want = sorted((r.doc_id or -1, hashlib.sha256(",".join(_spans(r.text or "")).encode()).hexdigest()) for r in df.collect())
        assert got == want
    assert pii.digests(pii.find(none)).count() == 0


def test_terms_that_reveal_an_entity(spark):
    """A word that occurs with one address only, in different contexts, is found; common words are not."""
    r = random.Random(2)
    filler = lambda: " ".join(r.choice(["about", "there", "which", "other", "would"]) for _ in range(12))
    t = [f"{filler()} Zebulon wrote from zeb@mail.example.org and {filler()}" for _ in range(6)] + [f"{filler()} other@mail.example.org {filler()} {k}" for k in range(6)] + [filler() for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.digests(pii.find(df)).collect()}
    for k in range(6):
        at = t[k].index("Zebulon")
        assert f"term:{at}:{at + 7}" in got[k].spans.split(",")
        assert got[k].spans.startswith("email:")
    assert all("term" not in got[k].spans for k in range(6, 312))
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert "Zebulon" not in clean[0] and "[email]" in clean[0] and clean[200] == t[200]


def test_terms_far_from_an_entity_or_in_a_fixed_signature(spark):
    """What reveals an entity may stand anywhere in its documents, and with the same words around it in all."""
    r = random.Random(3)
    filler = lambda n: " ".join(r.choice(["about", "there", "which", "other", "would"]) for _ in range(n))
    t = [f"Zebulon wrote {filler(60)} zeb@mail.example.org {filler(20)}" for _ in range(6)]
    t += [f"{filler(40)} with my best regards as ever, Ottokar of the Quillfeather company in this town, phone or write: ott@mail.example.org or come by there at any time of day or night if you like, thank you" for _ in range(6)]
    t += [f"{filler(12)} copy@mail.example.org Wintermute"] * 6 + [f"{filler(30)} wrote with best regards ever company this town phone write come time night like thank" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {x.doc_id: x.spans.split(",") for x in pii.digests(pii.find(df)).collect()}
    for k, names in [(0, ["Zebulon"]), (6, ["Ottokar", "Quillfeather"])]:
        for name in names:
            assert all(f"term:{t[i].index(name)}:{t[i].index(name) + len(name)}" in got[i] for i in range(k, k + 6))
    assert not any(s.startswith("term") for k in range(12, len(t)) for s in got[k])


# -- repeated passages -------------------------------------------------------------------------


def _removed(texts, length=400):
    data, seen = [(t or "").encode() for t in texts], {}
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in data:
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                edge[s] += 1
                edge[s + length] -= 1
        m = np.cumsum(edge)[:-1] > 0
        out.append((len(b), int(m.sum()), int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(b) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()))
    return out


def test_difference_cover():
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


def test_repeats_match_brute_force(spark, docs, odd, none):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    p = word(900)
    made = [word(300) + p[:400] + word(50), p, word(10) + p[200:620], p[:399], "ab" * 450, word(500) + p[500:], p, word(700)]
    for df in (spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), docs.select("doc_id", "text"), odd.where("length(text) < 60000 or text is null").select("doc_id", "text")):
        df = df.cache()
        got = sorted((x.doc_id or -1, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(suffix_dedup.remove_repeats(df)).collect())
        each = df.collect()
        assert got == sorted((x.doc_id or -1, *w) for x, w in zip(each, _removed([x.text for x in each])))
    assert suffix_dedup.remove_repeats(none).count() == 0


# -- near copies -------------------------------------------------------------------------------


def _classes(texts):
    sets = {}
    for i, t in texts:
        w = re.split(r"[ \t\n\x0b\x0c\r]+", (t or "").strip(" \t\n\x0b\x0c\r"))
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_copies_match_brute_force(spark, docs):
    r = random.Random(8)
    base = [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(60)) for _ in range(150)]
    made = []
    for k in range(120):  # a chain of edits: similar to the base, not all to each other
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"edit{k}{r.randrange(999)}"
        made.append(" ".join(w))
    for df in (spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), docs.select("doc_id", "text")):
        got = {x.doc_id: x.class_id for x in minhash.near_duplicates(df).collect()}
        assert got == _classes([(x.doc_id, x.text) for x in df.collect()])


def test_near_copies_of_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {x.doc_id: x for x in got}
    assert by[5].class_id == 4 and not by[5].kept and by[4].class_size == 2
    assert by[1].class_id == 1 and by[2].class_id == 2 and by[8].class_id == 8
    assert by[None].kept
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_duplicates(odd).columns == odd.columns


def test_a_pair_meets_in_its_first_bucket_though_sketches_agree_before(spark):
    """Sketches of all bands agree, by chance before band 5, whose bucket is the only one that the pair shares."""
    words = [f"w{k}" for k in range(60)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"]))], "id long, text string")
    keys = [[100 * i + k if k != 5 else 77 for k in range(minhash.BANDS)] for i in (1, 2)]
    sketches = spark.createDataFrame([(i, bytes(minhash.COORDINATES), 56, keys[i - 1]) for i in (1, 2)], "id long, sketch binary, n long, bands array<bigint>")
    cand = spark.createDataFrame([(77, 5, 1), (77, 5, 2)], "key long, band int, id long")
    comp = spark.createDataFrame([], "id long, component long")
    got = minhash._across(cand, comp, sketches, texts, 0.8, False).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


@pytest.mark.parametrize("weights", [False, True])
def test_signatures_estimate_similarity(weights):
    r = random.Random(3)
    a = [f"w{r.randrange(40)}" for _ in range(600)]
    b = a[:500] + [f"x{r.randrange(40)}" for _ in range(100)]
    import pyarrow as pa

    for _, _, buf, offs in text_blocks(pa.array([" ".join(a), " ".join(b)])):
        d, s = minhash.shingles(buf, offs, weights)
        g = minhash.signatures(d, s, 2, 4000)
    sets = [set(s[d == k].tolist()) for k in (0, 1)]
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs((g[0] == g[1]).mean() - want) < 0.04


# -- mixing ------------------------------------------------------------------------------------


def test_mix_hits_its_targets(spark, docs):
    got = queries.op8_low_discrepancy_mix(spark, SMALL).toPandas()
    again = queries.op8_low_discrepancy_mix(spark, SMALL).toPandas()
    assert rows(got) == rows(again)
    text = duckdb.sql(f"select doc_id, source, text from '{SMALL}/documents.parquet'").df()
    size = dict(zip(text.doc_id, (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in text.text)))
    assert all(size[i] == s for i, s in zip(got.doc_id, got["size"]))
    assert (got.taken <= 3 * got["size"]).all()
    got = got.merge(text[["doc_id", "source"]], on="doc_id")
    each = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert np.allclose(each.target.sum(), got["size"].sum())
    assert (abs(each.taken - each.target) <= 3 + 0.001 * each.target).all()


def _targets(sizes, most=3.0):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left = total - sum(fixed.values())
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n]]
        if not over:
            return fixed | share
        fixed |= {n: most * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 2, "c": 3, "d": 4000, None: 7}, {"x": 5}, {"a": 0, "b": 9}])
def test_targets_match_the_rule(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = _targets(sizes)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_of_odd_rows(spark, odd, none):
    sized = odd.withColumn("size", mixing.count_words(F.col("text")))
    got = mixing.taken(sized).collect()
    assert len(got) == odd.count()
    assert mixing.taken(none.withColumn("size", F.lit(0).cast("long"))).count() == 0
    assert mixing.mix(odd.where("doc_id <> 6")).columns == odd.columns


def test_small_sources_of_a_large_mix_hit_their_targets(spark):
    """A slot of 5 G words is 4,769 words long; the sources' targets below that are met all the same."""
    many = [(k, "a", 50_000_000) for k in range(100)] + [(1000 + k, f"s{k}", 100 * (1 + k * k)) for k in range(12)] + [(2000, None, 7)]
    df = spark.createDataFrame(many, "doc_id long, source string, size long")
    schedule, targets = mixing.plan(df)
    want = {r.source: r.target for r in targets.collect()}
    parts = schedule.groupBy("source").agg(F.sum("words").alias("n"), F.max("words").alias("most")).collect()
    assert {r.source for r in parts} == set(want)
    assert all(abs(r.n - want[r.source]) <= 1 for r in parts)
    assert schedule.groupBy("slot").agg(F.sum("words").alias("n")).where("n > 4769").isEmpty()
    # What is taken of a reading has no gap and no overlap.
    readings = schedule.where("source is null or source <> 'a'").groupBy("doc_id", "epoch").agg(F.min("from_word").alias("lo"), F.max(F.col("from_word") + F.col("words")).alias("hi"), F.sum("words").alias("n"))
    assert readings.where("lo <> 0 or hi <> n").isEmpty()


# -- toxicity and quality ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(9)
    plain = lambda: " ".join(r.choice("stone river walks quiet green under along later early never".split()) + r.choice(["", "s"]) for _ in range(60))
    t, y = [], []
    for k in range(600):
        bad = k % 6 == 0
        t.append(plain() + (" you idiot and moron " if bad else " you friend and person ") + plain())
        y.append(int(bad))
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, v, 1 - v) for k, v in enumerate(y)], "doc_id long, toxic int, quality int")
    return docs, labels, y


def test_toxic_documents_are_found(spark, toxic):
    docs, labels, y = toxic
    model = toxicity.train(docs, labels.where(fold("doc_id", 4) != 2))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((got[k] >= 0.3) == bool(y[k]) for k in held)


def test_toxicity_of_real_labels(spark):
    got = queries.op9_kneser_ney_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    y = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet' where toxic is not null").df()
    held = got[got.held_out].merge(y, on="doc_id")
    assert held.toxic[held.predicted == 1].mean() > 0.9 and held.predicted[held.toxic == 1].mean() > 0.9


def test_scores_of_odd_rows(spark, odd, none, toxic):
    docs, labels, _ = toxic
    empty = labels.where("false")
    for train, score, label in ((toxicity.train, toxicity.score, "toxic"), (quality.train, quality.score, "quality")):
        for known in (labels.where("doc_id < 60"), empty, labels.where(f"{label} = 1").limit(5), spark.createDataFrame([(1, None, None)], "doc_id long, toxic int, quality int")):
            model = train(docs, known, label)
            got = score(odd, model).collect()
            assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert score(none, model).count() == 0


def test_quality_of_real_labels(spark):
    got = queries.op10_attention_quality(spark, "/root/testdata/sf0.01").toPandas()
    y = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet' where quality is not null").df()
    held = got[got.held_out].merge(y, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_attention_gradients():
    """One step of training moves the loss as the derivative says."""
    rng = np.random.default_rng(0)
    x, first = rng.normal(size=(12, quality.DIM)), np.array([0, 3, 4, 9, 12])
    y = np.array([1.0, 0, 1, 0])
    m = quality.fit(np.repeat(x, 1, 0), first, y, np.ones(4))
    p = quality._forward(m.weights, np.clip((x - m.mean) / m.scale, -6, 6), first)[-1]
    assert ((p > 0.5) == (y == 1)).all()


# -- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in c.STAGES:
        stage(spark, before, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != c.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "exact_dedup":
            assert after.count() == before.select(F.coalesce("text", F.lit(""))).distinct().count()
        if name == "near_dedup":
            want = _classes([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in after.collect()} == set(want.values())
        if name == "mixing":
            words = lambda df: df.agg(F.sum(mixing.count_words(F.col("text")))).first()[0]
            assert abs(words(after) - words(before)) <= 3 * 25
        if name == "byte_bpe":
            assert after.count() == before.count()
            want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in before.collect())
            assert sorted(r.decoded_sha256 for r in after.collect()) == want
        before = after
