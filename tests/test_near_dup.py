import datetime
import random

import pytest
from hypothesis import given, settings, strategies as st

from casebook.functions import edits
from casebook.operators import near_dup as N
from casebook.plans.catalog import QUERIES


def slow(a, b, change=1):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else change)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcé", max_size=70), st.text("abcé", max_size=70), st.integers(0, 40))
def test_edit_distances(a, b, limit):
    d, e = slow(a, b), slow(a, b, 2)
    assert edits.distance(a, b) == d
    assert edits.within(a, b, limit) == (d if d <= limit else -1)
    assert edits.indel_within(a, b, limit) == (e if e <= limit else -1)


def _texts():
    rnd = random.Random(5)
    words = "alpha beta gamma delta 公司 贷款 über".split()
    rows = []
    for i in range(60):
        base = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 6, 14])))
        rows.append((2 * i, rnd.choice("xxy"), base))
        copy = list(base)
        for _ in range(rnd.randint(0, max(1, len(copy) // 6))):
            copy[rnd.randrange(len(copy))] = rnd.choice("qz")
        rows.append((2 * i + 1, rows[-1][1], "".join(copy)))
    return rows + [(1000, "x", None), (1001, None, "alpha"), (1002, "x", ""), (1003, "x", "")]


def _brute(rows, threshold, metric):
    items = {}
    for i, block, text in sorted(rows, key=lambda r: r[0]):
        if text is not None and block is not None:
            items.setdefault((block, text), []).append(i)
    want = {(b, ids[0], i): 100.0 for (b, _), ids in items.items() for i in ids[1:]}
    flat = [(b, t, ids[0]) for (b, t), ids in items.items()]
    for k, (b1, t1, i1) in enumerate(flat):
        for b2, t2, i2 in flat[:k]:
            if b1 == b2 and abs(len(t1) - len(t2)) <= 20:
                size = max(len(t1), len(t2)) if metric == "edit" else len(t1) + len(t2)
                s = 100.0 * (1 - slow(t1, t2, 1 if metric == "edit" else 2) / size)
                if s > threshold:
                    want[(b1, min(i1, i2), max(i1, i2))] = s
    return want


@pytest.mark.parametrize("threshold,metric", [(80.0, "edit"), (90.0, "edit"), (80.0, "indel")])
@pytest.mark.parametrize("hot_rows", [0, 2000])
def test_pairs_equal_brute_force_on_both_ways(spark, threshold, metric, hot_rows):
    rows = _texts()
    df = spark.createDataFrame(rows, "id bigint, block string, text string").repartition(5)
    got = N.near_duplicates(df, "id", "block", "text", threshold, hot_rows=hot_rows, metric=metric).collect()
    assert len(got) == len({(r["block"], r["id_1"], r["id_2"]) for r in got})
    assert {(r["block"], r["id_1"], r["id_2"]): pytest.approx(r["similarity"]) for r in got} == _brute(rows, threshold, metric)


def test_many_copies_make_a_star(spark):
    df = spark.createDataFrame([(i, "b", "same words here") for i in range(400)], "id bigint, block string, text string")
    got = N.near_duplicates(df, "id", "block", "text").collect()
    assert len(got) == 399 and {r["id_1"] for r in got} == {0}


def test_gap_is_limited_on_one_side_unless_asked(spark):
    day = datetime.datetime(2024, 5, 1)
    gaps = {1: 0, 2: 89, 3: 90, 4: -5, 5: -200}
    pairs = spark.createDataFrame([("b", 0, i, 95.0) for i in gaps] + [("b", 0, 9, 85.0)], "block string, id_1 bigint, id_2 bigint, similarity double")
    rows = [(0, day), (9, day)] + [(i, day + datetime.timedelta(days=g)) for i, g in gaps.items()]
    facts = spark.createDataFrame(rows, "id bigint, at timestamp_ntz")
    one = {r["id_2"]: r["gap_days"] for r in N.suspicious_pairs(pairs, facts, "id", "at").collect()}
    assert one == {1: 0, 2: 89, 4: -5, 5: -200}
    both = {r["id_2"] for r in N.suspicious_pairs(pairs, facts, "id", "at", abs_days=True).collect()}
    assert both == {1, 2, 4}


def test_columns_may_have_any_name(spark):
    rows = [(1, "x", "some text here"), (2, "x", "some text her"), (3, "y", "some text here")]
    for block in ("a", "b", "na", "tb", "id"):
        df = spark.createDataFrame(rows, f"row_id bigint, {block} string, t string")
        assert [(r["id_1"], r["id_2"]) for r in N.near_duplicates(df, "row_id", block, "t").collect()] == [(1, 2)]


@pytest.mark.parametrize("hot_rows", [0, 2000])
def test_a_threshold_that_binds_nothing_is_refused(spark, hot_rows):
    df = spark.createDataFrame([(1, "x", "t")], "id bigint, b string, t string")
    with pytest.raises(ValueError):
        N.near_duplicates(df, "id", "b", "t", 50, metric="indel", hot_rows=hot_rows)


def test_copies_keep_their_own_days(spark):
    """Equal texts 1 and 2 a year apart, near copy 3 days after 2: the pair is (2, 3)."""
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, "x", text), (2, "x", text), (3, "x", text[:-1] + "m"), (4, "x", "something else altogether, much longer than the others")]
    days = {1: (2020, 1, 1), 2: (2021, 1, 1), 3: (2021, 1, 5), 4: (2021, 1, 5)}
    facts = spark.createDataFrame([(i, datetime.datetime(*d)) for i, d in days.items()], "id long, at timestamp_ntz")
    pairs = N.near_duplicates(spark.createDataFrame(rows, "id long, b string, t string"), "id", "b", "t")
    for both in (False, True):
        got = N.suspicious_members(pairs, facts, "id", "at", abs_days=both).collect()
        assert [(r.b, r.id_1, r.id_2, r.gap_days) for r in got] == [("x", 2, 3, 4)]
        assert got[0].time_2 == datetime.datetime(2021, 1, 5)


@pytest.mark.parametrize("abs_days", [False, True])
@pytest.mark.parametrize("rows_per_bucket", [10**6, 7])
def test_members_are_those_of_all_pairs(spark, abs_days, rows_per_bucket):
    """Against all pairs of copies: no member is lost, every row is such a pair, partners are the nearest ones."""
    rnd = random.Random(3)
    texts = ["complaint about the app %s, money not returned" % x for x in ("one", "two", "too", "old")] + ["a wholly different text", None]
    rows = [(i, rnd.choice("xxy"), rnd.choice(texts)) for i in range(160)]
    start = datetime.datetime(2020, 1, 1)
    at = {i: start + datetime.timedelta(hours=rnd.randrange(24 * 900)) for i, _, _ in rows if i % 9}
    facts = spark.createDataFrame([*at.items(), (5, start + datetime.timedelta(days=5000)), (7, None)], "id long, at timestamp_ntz")
    pairs = N.near_duplicates(spark.createDataFrame(rows, "id long, b string, t string"), "id", "b", "t")
    got = N.suspicious_members(pairs, facts, "id", "at", 20, abs_days=abs_days, rows_per_bucket=rows_per_bucket).collect()
    assert len(got) == len({(r.id_1, r.id_2) for r in got})

    def gap(x, y):
        days = (at[y] - at[x]).days
        return (abs(at[y] - at[x])).days if abs_days else days

    every = {}
    for i, b, t in rows:
        for j, c, u in rows:
            if i < j and b == c and None not in (t, u) and i in at and j in at:
                similarity = 100.0 * (1 - slow(t, u) / max(len(t), len(u)))
                if similarity >= 90 and gap(i, j) < 20:
                    every[i, j] = (b, similarity, gap(i, j))
    for r in got:
        b, similarity, days = every[r.id_1, r.id_2]
        assert (r.b, r.gap_days) == (b, days) and abs(r.similarity - similarity) < 1e-9
    assert {i for r in got for i in (r.id_1, r.id_2)} == {i for p in every for i in p}
    assert len(got) < len(every)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.05, 0.1, 0.2, 0.45, 0.6]), st.booleans())
def test_many_texts_at_once_equal_one_pair_at_a_time(seed, loss, indel):
    rnd = random.Random(seed)
    left = ["".join(rnd.choice("abcé公") for _ in range(rnd.choice([0, 1, 63, 64, rnd.randint(0, 400)]))) for _ in range(8)]
    right = ["".join(c for c in t if rnd.random() > 0.1) + rnd.choice(["", "q"]) for t in left]
    wanted = edits.np.array([[rnd.random() < 0.8 for _ in right] for _ in left])
    measure = edits.indel_within if indel else edits.within
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            size = len(a) + len(b) if indel else max(len(a), len(b))
            d = measure(a, b, int(loss * size + 1e-9))
            if wanted[i, j] and d >= 0:
                want[i, j] = d
    a, b, d = edits.pairs_within(left, right, wanted, loss, indel)
    assert dict(zip(zip(a.tolist(), b.tolist()), d.tolist())) == want and len(a) == len(want)


def test_grams_settle_unlike_texts_before_they_are_compared(monkeypatch):
    """Of 40 unlike texts and a near copy of one, only the pair of copies is compared whole."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghij é公") for _ in range(rnd.randint(395, 405))) for _ in range(40)]
    texts.append(texts[7][:200] + "zz" + texts[7][201:])
    compared, whole = [], edits.within
    monkeypatch.setattr(edits, "within", lambda *a: compared.append(a) or whole(*a))
    wanted = edits.np.triu(edits.np.ones((41, 41), bool), 1)
    a, b, d = edits.pairs_within(texts, texts, wanted, 0.1)
    assert [tuple(x) for x in zip(a, b, d)] == [(7, 40, 2)] and len(compared) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 6), st.sampled_from([64, 4096]), st.integers(0, 60))
def test_no_pair_within_its_limit_is_settled_by_grams(seed, q, bits, edit):
    rnd = random.Random(seed)
    left = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 300))) for _ in range(6)]
    right = [list(t) for t in left]
    for t in right:
        for _ in range(edit if t else 0):
            at = rnd.randrange(len(t))
            t[at : at + 1] = rnd.choice([[], ["q"], ["a", "b"]])
            t or t.append("a")
    right = ["".join(t) for t in right]
    d = edits.np.array([[slow(a, b) for b in right] for a in left])
    kept = edits.may_be_within(left, right, edits.np.ones_like(d, bool), d, q)
    assert kept.all()


@pytest.mark.parametrize("many", [1, 16])
def test_near_copies_side_by_side_equal_one_pair_at_a_time(monkeypatch, many):
    """Whole texts in a band, some longer than it is wide, some with characters of their own."""
    monkeypatch.setattr(edits, "MANY", many)
    rnd = random.Random(8)
    texts = []
    for size in (130, 900, 2100):
        base = "".join(rnd.choice("abcdefé公") for _ in range(size))
        for edit in [0, 1, 5, size // 30, size // 14, size // 11] * 3:
            t = list(base)
            for _ in range(edit):
                at = rnd.randrange(len(t))
                t[at : at + 1] = rnd.choice([[], ["q"], ["a", "b"]])
            texts.append("".join(t))
    wanted = edits.np.triu(edits.np.ones((len(texts),) * 2, bool), 1)
    a, b, d = edits.pairs_within(texts, texts, wanted, 0.1)
    want = {(i, j): edits.within(texts[i], texts[j], max(len(texts[i]), len(texts[j])) // 10) for i, j in edits.np.argwhere(wanted).tolist()}
    assert dict(zip(zip(a.tolist(), b.tolist()), d.tolist())) == {k: x for k, x in want.items() if x >= 0} and len(a) == len(set(zip(a, b)))
    band = edits.Band(texts)
    for j in (0, 20, 40):
        got = band.distances(texts[j], edits.np.full(len(texts), len(texts[j])), 3000)
        assert got.tolist() == [edits.distance(t, texts[j]) for t in texts]


def test_full_bands_in_tiles_and_links_without_pairs(spark):
    """Tiles of three rows give the pairs of brute force; links are those pairs, counted for each text."""
    rows = _texts()
    df = spark.createDataFrame(rows, "id bigint, block string, text string").repartition(5)
    want = _brute(rows, 80.0, "edit")
    got = N.near_duplicates(df, "id", "block", "text", tile_rows=3).collect()
    assert {(r["block"], r["id_1"], r["id_2"]): pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want)
    first, n = {}, {}
    for i, block, text in sorted(rows, key=lambda r: r[0]):
        first.setdefault((block, text), i)
    for (_, x, y), s in want.items():
        if s < 100:
            n[x], n[y] = n.get(x, 0) + 1, n.get(y, 0) + 1
    links = {(b, i, first[b, t], n.get(first[b, t], 0)) for i, b, t in rows if None not in (b, t)}
    for tile_rows in (None, 3):
        out = N.near_duplicate_links(df, "id", "block", "text", tile_rows=tile_rows).collect()
        assert {tuple(r) for r in out} == links and len(out) == len(links)


def _address_tables(spark, folder):
    urls = {1: "http://a.com/item/000001", 2: "http://a.com/item/000002", 3: "http://a.com/item/000001", 4: "http://a.com/other/page", 5: "http://b.com/item/000001", 6: None}
    spark.createDataFrame(list(urls.items()), "page_id bigint, url string").write.parquet(f"{folder}/pages.parquet")


def test_addresses_are_paired_not_only_counted(spark, tmp_path):
    """The query names each pair of unlike addresses of a host; the addresses themselves come once."""
    _address_tables(spark, tmp_path)
    got = QUERIES["near_duplicate_addresses"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("a.com", 1, 2, pytest.approx(100 * 23 / 24, abs=1e-6))]


@pytest.mark.parametrize("copies_at_once", [500, 2])
def test_every_copy_is_paired_with_every_similar_row(spark, copies_at_once):
    rows = _texts()
    rows += [(i + 2000, b, t) for i, b, t in rows if i % 3 == 0] + [(i + 4000, b, t) for i, b, t in rows if i % 9 == 0]
    df = spark.createDataFrame(rows, "id bigint, block string, text string").repartition(5)
    want = {}
    for i, b, t in rows:
        for j, c, u in rows:
            if i < j and b == c and None not in (b, t, u) and abs(len(t) - len(u)) <= 20:
                s = 100.0 * (1 - slow(t, u) / max(len(t), len(u), 1))
                if s > 80:
                    want[b, i, j] = s
    got = N.near_duplicates(df, "id", "block", "text", every_copy=True, copies_at_once=copies_at_once).collect()
    assert {tuple(r)[:3]: pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want)


def _document_tables(spark, folder):
    """Texts 1, 2 and 3 are the same, 4 is a near copy of them; 2 came ten days before 1."""
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, "en", text), (2, "en", text), (3, "en", text), (4, "en", text[:-1] + "m"), (5, "en", None), (6, "en", "unlike")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    days = {1: 11, 2: 1, 3: 20, 4: 11}
    times = [(i, datetime.datetime(2024, 5, d)) for i, d in days.items()]
    spark.createDataFrame(times, "event_id bigint, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")


def test_documents_pair_with_all_copies(spark, tmp_path):
    _document_tables(spark, tmp_path)
    got = QUERIES["near_duplicate_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.id_1, r.id_2) for r in got) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_all_suspicious_pairs_are_named_not_only_the_nearest(spark, tmp_path):
    _document_tables(spark, tmp_path)
    got = QUERIES["suspicious_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.id_1, r.id_2, r.gap_days) for r in got) == [(1, 2, -10), (1, 4, 0), (3, 4, -9)]


def test_repeated_rows_stay_in_pairs_and_are_one_row_when_suspicious(spark, tmp_path):
    """Row 2 comes twice: its pair with the least id does as well, as it does without ``every_copy``."""
    rows = [(1, "en", "one text"), (2, "en", "one text"), (2, "en", "one text"), (3, "en", "one text")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    times = [(i, datetime.datetime(2024, 5, 1)) for i in (1, 2, 3)]
    spark.createDataFrame(times, "event_id bigint, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["near_duplicate_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.id_1, r.id_2) for r in got) == [(1, 2), (1, 2), (1, 3), (2, 3)]
    got = QUERIES["suspicious_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.id_1, r.id_2) for r in got) == [(1, 2), (1, 3), (2, 3)]
