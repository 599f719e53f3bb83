"""Operators as Spark jobs: plain counterparts, odd rows, empty tables, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import cotraining, language, licences, line_dedup, minhash, mixing, nearest, packing, personal, quality_rules
from casebook.llm.queries import vocabulary
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, words string, row int, a int, id int"


def corpus(seed=1, n=120):
    """Small documents with copies, near copies, shared runs of lines, nulls, blanks and repeated rows."""
    rnd = random.Random(seed)
    vocab = [a + b for a in "ka lo mi nu pe".split() for b in "r s t é".split()]
    line = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12)))
    shared = [[line() for _ in range(rnd.randint(2, 6))] for _ in range(4)] + [[" ".join(rnd.choice(vocab) for _ in range(60))]]
    out = []
    for i in range(n):
        kind = rnd.random()
        if out and kind < 0.15:
            text = rnd.choice(out)[1]
        elif out and kind < 0.4:
            words = (rnd.choice(out)[1] or "x").split(" ")
            words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind < 0.45:
            text = rnd.choice([None, "", " \n\t ", "one", "one two", "# * $"])
        else:
            lines = [line() for _ in range(rnd.randint(1, 8))]
            if rnd.random() < 0.5:
                lines[rnd.randrange(len(lines)) : 0] = rnd.choice(shared)
            text = "\n".join(lines)
        out.append((i, text, rnd.choice(["xx", "yy", None]), rnd.choice(["s1", "s1", "s1", "é2", None]), len(text or "")))
    out.append((n, "long " * 30_000, "xx", "s1", 150_000))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    odd = ("k", "w", 7, 8, 9)
    return spark.createDataFrame([r + odd for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_quality_rules_on_capitals_and_doubled_words(spark):
    """Pages mostly in capitals or of doubled words fail; the same words written plainly pass."""
    plain = " ".join("the" if i % 10 == 0 else f"word{i}" for i in range(80))
    doubled = " ".join(w for p in plain.split() for w in (p, p))
    rows = [(1, plain), (2, plain.upper()), (3, doubled), (4, "the " * 30 + plain)]
    got = {r["doc_id"]: (r["failed"], r["passed"]) for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == ([], True) and not got[2][1] and not got[3][1]
    assert "upper_case" in got[2][0] and "repeated_neighbours" in got[3][0] and "repeated_neighbours" in got[4][0]


def test_licences(docs, rows, nothing):
    got = by_id(licences.scan(docs))
    for doc_id, text, *_ in rows:
        n, starts, _ = brute.licence_base(text, licences.BASE)
        assert got[doc_id]["n_words"] == n
    assert licences.scan(nothing).count() == 0


def test_quality(docs, rows, nothing):
    got = by_id(quality_rules.judged(docs))
    for doc_id, text, *_ in rows:
        g = got[doc_id]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == brute.quality(text)
        assert g["passed"] == (not g["failed"]) and (g["n_words"] >= 50 or "length" in g["failed"])
    assert quality_rules.judged(nothing).count() == 0


def test_quality_runs_without_user_functions(docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.replace("RoundRobinPartitioning", "").split("Project")[0]


def test_personal(spark, docs, nothing):
    rnd = random.Random(2)
    texts = []
    for i in range(150):
        good = f"mail a{i}@host{i}.org ip {i}.2.3.4 call +1 (394) 555-{1000 + i} card 4111 1111 1111 1111"
        texts.append((i, good if i % 2 else f"no {i}.999.3.4 and +12 3 and 4111 1111 1111 111{rnd.randint(2, 9)} end"))
    texts += [(900, None), (901, ""), (902, "jane (at) mail dot example.org"), (1, texts[1][1])]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = personal.find(frame).collect()
    assert len(found) == len(texts)
    for r in found:
        text = dict(texts)[r["doc_id"]]
        base = sorted((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"])
        assert base == sorted(brute.personal(text))
        for s in r["spans"]:
            assert 0 <= s["score"] <= 1 and s["kind"] in personal.KINDS
            others = [o for o in r["spans"] if o != s and not o["base"]]
            assert s["base"] or all(o["end"] <= s["start"] or s["end"] <= o["start"] for o in others)
    assert personal.find(nothing).count() == 0
    assert personal.find(docs).count() == docs.count()


def test_thresholds():
    import pandas as pd

    frame = pd.DataFrame({"label": [1, 1, 1, 0, 1], "p": [0.9, 0.8, 0.7, 0.6, 0.6]})
    assert personal.threshold(frame, 0.95) == 0.7
    assert personal.threshold(frame, 0.5) == 0.6
    assert personal.threshold(frame[frame.label == 0], 0.95) == 2.0
    assert personal.threshold(frame.assign(weight=1.0), 0.95) == 0.7


def test_personal_learns_from_every_candidate(spark, monkeypatch):
    """All 7,000 candidates of the plain formats reach the trees, four fifths of them by a hash."""
    from pyspark.ml.classification import GBTClassifier

    seen, fit = [], GBTClassifier.fit

    def counted(self, rows, *args):
        seen.append(rows.groupBy("label").count().collect())
        return fit(self, rows, *args)

    monkeypatch.setattr(GBTClassifier, "fit", counted)
    texts = [(i, f"host 10.{i % 250}.7.{i % 200} or 300.{i % 250}.7.{i % 200}") for i in range(3_500)]
    found = personal.candidates(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3))
    model, limits = personal.learn(found, trees=2)
    n = {r["label"]: r["count"] for r in seen[0]}
    assert set(n) == {0.0, 1.0} and 5_400 < sum(n.values()) < 5_800 and set(limits) == set(personal.KINDS)


def test_mixing(spark, docs, rows, nothing):
    got = by_id(mixing.mix(docs))
    size = {r[0]: len(brute.BLANK_WORDS.findall(r[1] or "")) for r in rows}
    sources = {}
    for r in rows:
        sources[r[3]] = sources.get(r[3], 0) + size[r[0]]
    want, taken = brute.targets(sources), dict.fromkeys(sources, 0)
    for r in rows:
        g = got[r[0]]
        assert (g["size"], g["source_size"]) == (size[r[0]], sources[r[3]])
        assert g["target"] == pytest.approx(want[r[3]], rel=1e-12) and 0 <= g["copies"] <= 3
        taken[r[3]] += g["size"] * g["copies"]
    largest = {s: max(size[r[0]] for r in rows if r[3] == s) for s in sources}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sources)
    assert mixing.mix(nothing).count() == 0
    again = by_id(mixing.mix(docs.repartition(2)))
    assert {k: v["copies"] for k, v in again.items()} == {k: v["copies"] for k, v in got.items()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(v["copies"] for v in got.values())
    blank = spark.createDataFrame([(1, None, "s")], "doc_id bigint, text string, source string")
    assert mixing.mix(blank).first()["target"] == 0.0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1}, {"a": 5, "b": 0, None: 700}, {"a": 3}])
def test_water_filling(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.water_fill(mixing.weighted_sources(frame)).collect()}
    assert got == pytest.approx(brute.targets(sizes), rel=1e-12)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("min_lines, min_words", [(3, 50), (2, 8), (1, 1)])
def test_line_dedup(docs, rows, nothing, min_lines, min_words):
    want = brute.deleted_lines([r[:2] for r in rows], min_lines, min_words)
    out = line_dedup.dedup_lines(docs, min_lines=min_lines, min_words=min_words)
    assert out.columns == [*docs.columns, "n_deleted"]
    got = by_id(out)
    assert any(want.values())
    for doc_id, text, *_ in rows:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[doc_id])
        assert (got[doc_id]["text"], got[doc_id]["n_deleted"]) == (kept, len(want[doc_id]))
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_runs_go_whole(spark):
    """What comes after a line of 50 words, or before one, goes with the run; a first place elsewhere does not matter."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, c, d = line("a", 80), line("b", 10), line("c", 60), line("d", 10)
    texts = [(1, a), (2, "\n".join([a, b])), (3, "\n".join(["own", a, b, "end"])), (4, "\n".join([b, c, d])),
             (5, "\n".join(["x", b, c, d, "y"])), (6, "\n".join([d, "z", b])), (7, "\n".join([b, c, "w", d]))]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id bigint, text string")))
    assert {i: r["n_deleted"] for i, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 3, 6: 0, 7: 2}
    assert got[3]["text"] == "own\nend" and got[5]["text"] == "x\ny" and got[7]["text"] == "w\n" + d
    assert {i: len(x) for i, x in brute.deleted_lines(texts, 3, 50).items()} == {2: 1, 3: 2, 5: 3, 7: 2}


def test_line_dedup_of_repeated_rows(spark):
    text = "\n".join(f"line number {i}" for i in range(5))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_deleted"]) for r in line_dedup.dedup_lines(frame).collect())
    assert got == [(0, 0), (1, 5), (1, 5), (2, 5)]


def test_line_dedup_is_native(docs):
    assert "Python" not in line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates(docs, rows, nothing):
    want = brute.components([r[:2] for r in rows])
    got = by_id(minhash.near_duplicates(docs))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in got.items()} == want
    assert all(v["kept"] == (k == want[k][1]) for k, v in got.items())
    assert sum(k != c for k, (_, c) in want.items()) > 20
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """A drift from text to text links ends that are unlike each other."""
    words = [f"w{i}" for i in range(100)]
    chain = []
    for i in range(40):
        words[(i * 7) % 100] = f"x{i}"
        chain.append((100 - i, " ".join(words)))
    frame = spark.createDataFrame(chain + [(500, None), (None, "w1 w2"), (100, chain[0][1])], "doc_id bigint, text string")
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == 43
    assert {r["component_id"] for r in got if r["doc_id"] not in (None, 500)} == {61}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (5, 5)]
    found = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(1, 61), 1), 100: 100, 200: 100, 300: 100}


def test_components_join_up(spark):
    def of(edges):
        return spark.createDataFrame(edges, "a bigint, b bigint")

    first = minhash.joined_up(None, of([(5, 6), (6, 7), (10, 11)]))
    more = minhash.joined_up(first, of([(7, 11), (2, 10), (30, 31)]))
    assert {r["node"]: r["component"] for r in more.collect()} == {**dict.fromkeys((2, 5, 6, 7, 10, 11), 2), 30: 30, 31: 30}


def test_packing(docs, rows, nothing):
    pieces = packing.pack(docs, *vocabulary(), window=256, shard_rows=30).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] or "" for r in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(own, key=lambda p: p["start"])])
        assert ids.tolist() == tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [1]
        assert {p["doc_tokens"] for p in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own]).tolist()
        assert [p["offset"] for p in own] == [0, *ends[:-1]]
        assert ends[-1] <= 256 and ends[-1] & (ends[-1] - 1) == 0
    assert packing.pack(nothing, *vocabulary()).count() == 0


def test_language(spark, nothing):
    rnd = random.Random(4)
    words = {"xx": "alpha beta gamma delta epsilon".split(), "yy": "rouge vert bleu jaune noir".split()}
    data = [(i, " ".join(rnd.choice(words[x]) for _ in range(8)), x) for i in range(200) for x in [rnd.choice(["xx", "yy"])]]
    data += [(300, None, "xx"), (301, "12 !", "yy"), (302, "", None), (303, "Alphabeta deltas", None), (304, "bleuvert noire", None)]
    frame = spark.createDataFrame([(*r, 1) for r in data], "doc_id bigint, text string, lang string, extra int")
    model = language.learn(language.labelled_sample(frame.filter("doc_id % 2 = 0"), "text", "lang", "doc_id"))
    out = language.identify(frame, model)
    assert out.columns == [*frame.columns, "lang_pred", "score"]
    got = by_id(out)
    assert all(got[i]["lang_pred"] == x for i, _, x in data[:200])
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 303, 304)] == ["und", "und", "und", "xx", "yy"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[300]["score"] == 0
    none = language.learn(language.labelled_sample(nothing, "text", "lang", "doc_id"))
    assert {r["lang_pred"] for r in language.identify(frame, none).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0
    with pytest.raises(ValueError):
        language.identify(out, model)


def test_learned_counts(spark):
    frame = spark.createDataFrame([("xx", "aba ab ab"), ("yy", "ba")], "lang string, text string")
    model = language.learn(frame, max_gram=2)
    assert set(model["words"]) == {"aba", "ab", "ba"}
    assert {g for g in model["grams"] if len(g) == 2} == {" a", "ab", "ba", "a ", "b ", " b"}
    vector = model["vectors"][model["words"]["ab"]]
    assert vector[0] == pytest.approx(np.log(2 / 3), rel=1e-5) and vector[1] < vector[0]


def test_cotraining(spark, docs, nothing):
    rnd = random.Random(5)
    good = lambda: " ".join(rnd.choice("the river runs over old stones and fields".split()) for _ in range(30))
    bad = lambda: " ".join(rnd.choice("WIN!! $$$ CLICK### cash### now%%%".split()) for _ in range(30))
    data = [(i, good() if i % 3 else bad(), "xx", "s1" if i % 3 else "s2", 100) for i in range(240)]
    frame = spark.createDataFrame([*data, (500, None, None, None, None), data[0]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)], "doc_id bigint, label int")
    got = cotraining.quality(frame, labels, labelled=100, rounds=1).collect()
    assert len(got) == 242
    right = [r["kept"] == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] != 500]
    assert np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in cotraining.quality(frame, labels.filter("label = 1")).collect()} == {1.0}
    assert cotraining.quality(nothing, labels.limit(0)).count() == 0


def test_every_source_hands_over_its_surest_rows(spark):
    """Small sources give too; the step at which the share is reached is taken whole."""
    rows = [("big", 4.0 + i / 100, b"%d" % i) for i in range(200)] + [("small", 3.0, b"s"), ("small", -2.5, b"t"), (None, 9.0, b"n"), ("big", 0.5, b"u")]
    pool = spark.createDataFrame(rows, "source string, l double, v binary")
    got = sorted((bytes(r["v"]), r["label"]) for r in cotraining.surest(pool, "l", 0.05).collect())
    assert got == sorted([(b"%d" % i, 1.0) for i in range(190, 200)] + [(b"s", 1.0), (b"t", 0.0), (b"n", 1.0)])


def test_calibration():
    rnd = np.random.default_rng(0)
    x = rnd.normal(0, 4, 4000)
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(0.5 * x + 1)))).astype(float)
    slope, offset = cotraining.calibrated(x, y)
    assert abs(slope - 0.5) < 0.08 and abs(offset - 1) < 0.2


def test_nearest(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((8, 24))
    data = [(i, (centres[i % 8] + 0.7 * rnd.standard_normal(24)).astype("float32").tolist()) for i in range(1500)]
    data += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23),
             (2004, [float("inf")] + [1.0] * 23), (2020, [1.0, 2.0]), (2040, [2.0, 1.0]), (20, data[20][1]), (2005, data[40][1])]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = nearest.nearest(frame, queries=F.col("vec_id") % 20 == 0, shard_rows=400, query_rows=50).collect()
    vectors = {i: np.array(v, float) for i, v in data if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids])
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == {i for i in vectors if i % 20 == 0} | {2020, 2040}
    assert [(r["vec_id"], r["score"]) for r in found[2020]] == [(2040, 4.0)]
    hits = 0
    queries = [i for i in found if i in vectors]
    for q in queries:
        scores = matrix @ vectors[q]
        want = [int(i) for s, i in sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:20]]
        assert [r["rank"] for r in found[q]] == list(range(1, 21))
        hits += len(set(want) & {r["vec_id"] for r in found[q]})
        assert all(r["score"] == pytest.approx(float(vectors[r["vec_id"]] @ vectors[q]), abs=1e-12) for r in found[q])
    assert hits / (20 * len(queries)) >= 0.95
    assert nearest.nearest(frame.limit(0)).count() == 0
