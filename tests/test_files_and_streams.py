import datetime
import os

import pandas as pd
from pyspark.sql import functions as F

from casebook.functions.runtime import join_on, scratch_path, settle
from casebook.operators import models as K
from casebook.sources import files as S
from casebook.streaming import intake as N


def test_folder_scan_skips_hidden_files(spark, tmp_path):
    for name, text in (("a.csv", 'id,t\n1,"x, ""y""\nz"\n'), ("b.csv", "id,t\n2,\n"), (".c.csv", "id,t\n3,h\n"), ("_d.csv", "id,t\n4,h\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = {r["id"]: r["t"] for r in S.scan_folder(spark, str(tmp_path), "id int, t string").collect()}
    assert rows == {1: 'x, "y"\nz', 2: None}


def test_texts_in_three_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("投诉".encode("utf-8"))
    (tmp_path / "g.txt").write_bytes("投诉".encode("gbk"))
    (tmp_path / "l.txt").write_bytes(b"caf\xe9")
    got = {r["file"]: (r["text"], r["encoding"]) for r in S.read_texts(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"u.txt": ("投诉", "utf-8"), "g.txt": ("投诉", "gbk"), "l.txt": ("café", "latin-1")}


SAMPLES = {
    "simplified": "本公司于二〇二三年收到消费者投诉，要求退还已支付的贷款利息。客服表示将在三个工作日内处理，但至今没有答复。",
    "traditional": "本公司於二零二三年收到消費者投訴，要求退還已支付的貸款利息。客服表示將在三個工作日內處理，但至今沒有答覆。",
    "french": "L'été dernier, la société a répondu à la réclamation ; le client n'a reçu aucun remboursement, même après plusieurs appels.",
    "german": "Der Kläger hat die Überweisung für das Gerät bestätigt, aber die Rückzahlung ist bis heute nicht erfolgt. Größe: fünf Stück.",
    "spanish": "La compañía respondió al cliente el año pasado; según él, todavía no ha recibido la devolución de 20 € ni explicación.".replace("€", "$"),
    "english": "The complaint was closed without an answer; see case no. 12 (2021).",
}


def test_encodings_are_sniffed(spark, tmp_path):
    """Byte strings that are valid in several encodings come out as what they read as; also short ones and mixed lines."""
    want = {}
    for name, text in SAMPLES.items():
        codecs_of = {"simplified": ["gbk", "gb18030", "utf-8", "utf-16-le", "utf-16-be"], "traditional": ["big5", "utf-8", "utf-16-le", "utf-16-be"]}
        for codec in codecs_of.get(name, ["latin-1", "utf-8", "utf-16-le", "utf-16-be"]):
            for part, piece in (("whole", text), ("half", text[: len(text) // 2]), ("mixed", f"id,{name},2021-05-01\n7,{text}\n")):
                file = f"{name}_{codec}_{part}.txt"
                (tmp_path / file).write_bytes(piece.encode(codec))
                plain = codec == "latin-1" and piece.isascii()
                want[file] = (piece, {"gb18030": "gbk"}.get(codec, "utf-8" if plain else codec))
    (tmp_path / "mark.txt").write_bytes(b"\xff\xfe" + "ab".encode("utf-16-le"))
    (tmp_path / "mark8.txt").write_bytes(b"\xef\xbb\xbfcaf\xc3\xa9")
    (tmp_path / "four.txt").write_bytes(("投诉㐀" + SAMPLES["simplified"]).encode("gb18030"))
    want |= {"mark.txt": ("ab", "utf-16-le"), "mark8.txt": ("café", "utf-8"), "four.txt": ("投诉㐀" + SAMPLES["simplified"], "gb18030")}
    got = {r["file"]: (r["text"], r["encoding"]) for r in S.read_texts(spark, str(tmp_path), "*.txt").collect()}
    assert got == want


def test_keys_and_rules_on_file_names(spark, tmp_path):
    for name in ("600001_2020-12-31.csv", "800001_2020-12-31.csv", "600002_2021-06-30.csv"):
        (tmp_path / name).write_text("id\n1\n")
    df = S.scan_folder(spark, str(tmp_path), "id int")
    keyed = S.keys_from_file_name(S.drop_files(df, "^8|-06-30"), r"^(\d+)_(\d{4})", ["code", "year"])
    assert [(r["code"], r["year"]) for r in keyed.collect()] == [("600001", "2020")]


def test_month_scan_reads_only_its_folders(spark):
    path = scratch_path(spark, "months")
    rows = [(i, datetime.datetime(2020 + i // 12, i % 12 + 1, 5)) for i in range(30)]
    S.write_months(spark.createDataFrame(rows, "id int, at timestamp_ntz"), "at", path)
    df = S.scan_months(spark, path, "202011", "202102")
    assert sorted(r["id"] for r in df.collect()) == [10, 11, 12, 13]
    assert "PartitionFilters: [" in df._jdf.queryExecution().toString()
    assert len(df.inputFiles()) >= 4 and {"at", "year", "month"} <= set(df.columns)


def test_small_tables_are_settled_and_large_ones_left(spark):
    assert settle(spark.range(5), 10).count() == 5
    assert settle(spark.range(50), 10).count() == 50
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    assert join_on(a, a.select("k", F.col("v").alias("w")), ["k"]).count() == 2


def _files(spark, label, groups):
    path = scratch_path(spark, label)
    for ids in groups:
        rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)) for i in ids]
        spark.createDataFrame(rows, "id bigint, at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema


def test_new_ids_over_several_runs(spark):
    path, schema = _files(spark, "in", [[1, 2, 2], [2, 3]])
    out = scratch_path(spark, "out")

    def run():
        N.append_new_ids(N.file_stream(spark, path, schema, files_per_batch=1), "id", ["at"], out, out + "-progress")
        return sorted(r["id"] for r in spark.read.parquet(out).select("id").collect())

    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]
    spark.createDataFrame([(3, None), (4, None)], "id bigint, at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    assert run() == [1, 2, 3, 4]


def test_the_first_row_of_a_new_id_is_kept(spark):
    path = scratch_path(spark, "first")
    rows = [(1, datetime.datetime(2024, 1, d)) for d in (9, 3, 5)]
    spark.createDataFrame(rows, "id bigint, at timestamp_ntz").repartition(3).write.parquet(path)
    out = scratch_path(spark, "first-out")
    N.append_new_ids(N.file_stream(spark, path, spark.read.parquet(path).schema), "id", ["at"], out, out + "-progress")
    assert [r["at"].day for r in spark.read.parquet(out).collect()] == [3]


def test_new_ids_do_not_read_what_was_written(spark):
    """Ids are known from state alone: the output of earlier runs may be gone, and settings stay as they were."""
    path, schema = _files(spark, "state-in", [range(0, 40), range(20, 60)])
    before = spark.conf.get(N.STORE, None)
    progress = scratch_path(spark, "state-progress")

    def run(label):
        out = scratch_path(spark, label)
        N.append_new_ids(N.file_stream(spark, path, schema, files_per_batch=1), "id", ["at"], out, progress)
        return out

    first = run("state-one")
    assert sorted(r["id"] for r in spark.read.parquet(f"{first}/*.parquet").collect()) == list(range(60))
    rows = [(i, None) for i in (None, None, 7, 59, 60, 60)]
    spark.createDataFrame(rows, "id bigint, at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    assert sorted(str(r["id"]) for r in spark.read.parquet(run("state-two") + "/*.parquet").collect()) == ["60", "None"]
    assert spark.conf.get(N.STORE, None) == before


def test_windows_survive_a_restart(spark):
    path, schema = _files(spark, "win", [range(0, 30), range(30, 50)])
    out = scratch_path(spark, "win-out")

    def run():
        stream = N.file_stream(spark, path, schema, files_per_batch=1)
        N.keep_updates(N.windowed_counts(stream, "at", []), out, out + "-progress")
        return sorted(r["n"] for r in N.latest_counts(spark.read.parquet(out), ["window_start"]).collect())

    assert run() == [2, 24, 24]
    rows = [(100, datetime.datetime(2024, 1, 3, 5))]
    spark.createDataFrame(rows, "id bigint, at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    assert run() == [3, 24, 24]


def test_nearest_labels_of_sparse_vectors_and_equal_scores(spark):
    """Zeros do not travel; empty vectors and equal scores go to the smaller ids as in a plain sort."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.linalg import SparseVector

    batch = pa.record_batch([pa.array([1, 2]), pa.array([[0.0, 2.0, 0.0, 1.0], [0.0] * 4], pa.list_(pa.float32()))], names=["id", "_v"])
    sent = pa.Table.from_batches(K._without_zeros([batch], ["id"])).to_pandas()
    assert [len(x) for x in sent["_x"]] == [8, 0] and K._dense(sent).tolist() == [[0.0, 2.0, 0.0, 1.0], [0.0] * 4]

    rnd = np.random.default_rng(5)
    kinds = [{}, {0: 1.0}, {1: 1.0}, {0: 0.6, 1: 0.8}, {7: 1.0}]
    known = [(i, float(rnd.integers(3)), kinds[rnd.integers(5)]) for i in range(60)]
    asked = [(100 + i, 0.0, kinds[rnd.integers(5)]) for i in range(20)]
    frames = [spark.createDataFrame([(i, label, SparseVector(8, v)) for i, label, v in rows], ["id", "label", "features"]) for rows in (known, asked)]
    want = {}
    for i, _, v in asked:
        near = sorted(known, key=lambda r: (-round(sum(v.get(j, 0.0) * x for j, x in r[2].items()), 6), r[0]))[:5]
        votes = [label for _, label, _ in near]
        want[i] = min(votes, key=lambda label: (-votes.count(label), label))
    for rows in (5_000, 7):
        assert {r["id"]: r["prediction"] for r in K.nearest_label(*frames, "id", 5, share_rows=rows).collect()} == want


def test_nearest_labels_do_not_depend_on_shares(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, float(i % 3), Vectors.dense([float(i % 3 == j) + 0.01 * ((i * 7 + j) % 11) for j in range(3)])) for i in range(60)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    test = df.filter("id >= 45")
    one = {r["id"]: r["prediction"] for r in K.nearest_label(df, test, "id", 5).collect()}
    many = {r["id"]: r["prediction"] for r in K.nearest_label(df, test, "id", 5, share_rows=9).collect()}
    assert one == many and len(one) == 15
    assert all(one[i] == float(i % 3) for i in one)


def test_scoring_skips_blanks_and_rows_outside(spark):
    df = spark.createDataFrame([(1, "ab", 1), (2, " ", 1), (3, None, 1), (4, "abc", None), (5, "abcd", 0)], "id int, t string, d int")
    got = {r["id"]: r["prediction"] for r in K.score_texts(df, "t", lambda: lambda batch: [len(t) for t in batch], within=F.col("d") == 1).collect()}
    assert got == {1: 2}


def test_vectors_meet_without_being_shuffled(spark):
    """Shares and blocks are written once each and meet as they are read; what is shuffled are the best rows."""
    from pyspark.ml.linalg import Vectors

    rows = [(i, float(i % 3), Vectors.dense([float(i % 3 == j) for j in range(3)])) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    found = K.nearest_label(df, df, "id", 3, share_rows=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsInPandas" not in plan
    assert {r["id"]: r["prediction"] for r in found.collect()} == {i: float(i % 3) for i in range(40)}
