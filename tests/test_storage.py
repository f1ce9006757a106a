import os
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from labourlens.schemas import RUN
from labourlens.session import scratch
from labourlens.sources import files
from labourlens.streaming import ingest as st

ROW = StructType([StructField("job_id", StringType()), StructField("note", StringType()), StructField("tags", ArrayType(StringType()))])


def test_csv_with_bom_breaks_and_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿job_id,note,tags\nj1,"two\nlines, ""quoted""","[\'x\', \'y\']"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("job_id,note,tags\nj2,plain,oops\n", encoding="utf-8")
    got = {r.job_id: r for r in files.read_raw_csv(spark, f"{tmp_path}/*.csv", ROW, ["tags"]).collect()}
    assert got["j1"].note == 'two\nlines, "quoted"' and got["j1"].tags == ["x", "y"] and got["j2"].tags == []


def test_csv_columns_go_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("job_id,note\nj1,n1\n")
    (tmp_path / "b.csv").write_text("note,job_id\nn2,j2\n")
    (tmp_path / "c d.csv").write_text("job_id,tags\nj3,\"['x']\"\n")
    got = {(r.job_id, r.note, tuple(r.tags)) for r in files.read_raw_csv(spark, f"{tmp_path}/*.csv", ROW, ["tags"]).collect()}
    assert got == {("j1", "n1", ()), ("j2", "n2", ()), ("j3", None, ("x",))}


def test_lists_with_quotes_survive_csv(spark):
    path, tags = scratch(spark, "t-lists"), ["it's", 'a "b"', "c, d", "e\\f", "[g]"]
    files.flat_lists(spark.createDataFrame([("j", "n", tags)], ROW)).write.options(header=True, escape='"').csv(path)
    assert files.read_raw_csv(spark, path, ROW, ["tags"]).first().tags == tags


def test_newest_folder_counts_whatever_its_files_took(spark):
    import os
    import time

    path = scratch(spark, "t-newest")
    pages = spark.createDataFrame([(i, "u", "h") for i in range(100)], "page_id long, url string, html string")
    files.write_pages(pages.limit(7), path, "1")
    files.write_pages(pages.repartition(4), path, "2")
    folder = f"{path}/archived=2".removeprefix("file:")
    for k, name in enumerate(sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))):
        os.utime(f"{folder}/{name}", (time.time() + 3 * k,) * 2)
    assert files.newest_file(spark, path).count() == 100
    with pytest.raises(FileNotFoundError):
        files.newest_file(spark, path + "-none")


def test_absent_files_give_empty_tables(spark, tmp_path):
    assert files.read_raw_csv(spark, f"{tmp_path}/none_*.csv", ROW).columns == ["job_id", "note", "tags"]
    assert files.read_or_empty(spark, f"{tmp_path}/none", ROW).count() == 0


def test_snapshots(spark):
    path = scratch(spark, "t-snap")
    df = spark.createDataFrame([("j", "n", ["a", "b"])], ROW)
    files.write_snapshot(df, path, "20240101_000000")
    files.write_snapshot(df.withColumn("note", F.lit("new")), path, "20240102_000000")
    files.write_snapshot(df.withColumn("note", F.lit("new")), path, "20240102_000000")  # a retried job
    got = files.latest_snapshot(spark, path).collect()
    assert [(r.note, r.tags) for r in got] == [("new", ["a", "b"])]


def test_runs_and_export(spark):
    path = scratch(spark, "t-runs")
    files.append_run(spark, path, {"timestamp": "t", "n_jobs": 3, "n_new": 1, "src_counts": {"a": 1, "b": 2}})
    assert {(r.site, r.n) for r in files.run_counts(files.read_runs(spark, path)).collect()} == {("a", 1), ("b", 2)}
    assert files.read_runs(spark, path).schema == RUN
    out = scratch(spark, "t-export")
    files.export(spark.createDataFrame([("j", "n", ["a", "b"])], ROW), out)
    assert spark.read.csv(out, header=True).first().tags == "a; b"
    with pytest.raises(ValueError):
        files.export(spark.range(1), out, "xml")


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "p1.html").write_text("<html>\nhello</html>")
    row = files.read_pages(spark, str(tmp_path)).first()
    assert row.html == "<html>\nhello</html>" and row.url.endswith("p1.html")


def test_ingest_across_batches_and_restart(spark, tmp_path):
    src, path, check = str(tmp_path / "src"), scratch(spark, "t-ingest"), scratch(spark, "t-check")
    schema = StructType([StructField("k", StringType()), StructField("o", LongType())])

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        st.ingest(stream, path, check, "k", "o", schema).awaitTermination()
    arrive([("a", 1), ("a", 2), ("b", 3)])
    run()
    arrive([("b", 4), ("c", 5)])
    arrive([("c", 6), ("d", 7)])
    run()
    got = {(r.k, r.o) for r in st.kept(spark, path, schema).collect()}
    assert {k for k, _ in got} == {"a", "b", "c", "d"} and len(got) == 4 and {("a", 1), ("b", 3)} <= got
    assert sum(r.n_new for r in st.new_per_batch(spark, path, schema).collect()) == 4
    run()
    assert st.kept(spark, path, schema).count() == 4


def test_fifty_batches_leave_few_files(spark, tmp_path, monkeypatch):
    """Every key comes again and again, one in a third of all rows; what is merged is read once, retried batches too."""
    monkeypatch.setattr(st, "MERGED", 4)
    src, path, check = str(tmp_path / "src"), scratch(spark, "t-many"), scratch(spark, "t-many-check")
    schema = StructType([StructField("k", StringType()), StructField("o", LongType())])
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), F.col("id").alias("o"))
    rows.repartitionByRange(50, "o").write.parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    st.ingest(stream, path, check, "k", "o", schema).awaitTermination()
    store = st.Store(spark, path, schema)
    n = sum(1 for _, _, names in os.walk(path) for x in names if x.endswith(".parquet"))
    assert len(store.folders()) == 3 + 0 + 2 and len(store.complete()) < 20 and n < 20  # 50 = 3 * 16 + 0 * 4 + 2
    got = [r.k for r in st.kept(spark, path, schema).collect()]
    assert len(got) == len(set(got)) == rows.select("k").distinct().count()
    assert sum(r.n_new for r in st.new_per_batch(spark, path, schema).collect()) == len(got)


def test_unfinished_and_replaced_folders_do_not_count(spark, monkeypatch):
    path, schema = scratch(spark, "t-store"), StructType([StructField("k", StringType())])
    store = st.Store(spark, path, schema)
    assert store.read().count() == 0 and store.folders() == []
    for b in range(16):
        rows = st._bucketed(spark.createDataFrame([(f"k{b}",)], schema), "k").withColumn("batch_id", F.lit(b).cast("long"))
        store.write(rows, 1, b, b)
    store.merge(15)
    assert [(f.first, f.last) for f in store.folders()] == [(0, 15)] and len(store.complete()) == 17 and store.read().count() == 16
    store._fs.delete(store._path("batches-000000000000-000000000015/_SUCCESS"), False)
    assert len(store.folders()) == 16 and store.read().count() == 16


def test_late_rows_are_dropped(spark, tmp_path):
    src, path, check = str(tmp_path / "src"), scratch(spark, "t-days"), scratch(spark, "t-days-check")
    schema = "ts timestamp"

    def run(times):
        spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        st.write_counts(st.period_counts(stream, "ts"), path, check).awaitTermination()
    run(["2024-01-01 05:00:00", "2024-01-01 06:00:00", "2024-01-10 00:00:00"])
    run(["2024-01-01 07:00:00", "2024-01-10 03:00:00"])  # nine days late, and on time
    got = {str(r.period)[:10]: r.n for r in st.latest_counts(spark, path).collect()}
    assert got == {"2024-01-01": 2, "2024-01-10": 2}


def test_harvest_twice_and_gate(spark):
    from labourlens.operators.harvest import run_harvest
    from labourlens.schemas import RAW_POSTING
    row = {"job_id": "itviec_q77", "job_title": "Platform Engineer", "company_name": "Mekong Grid", "source_site": "itviec",
           "salary_raw": "22-36 triệu", "description_raw": "Redis", "skills_raw": ["Python"]}
    raw = spark.createDataFrame([tuple(row.get(f) for f in RAW_POSTING.fieldNames())], RAW_POSTING).withColumn("ord", F.lit(0))
    root = scratch(spark, "t-harvest")
    with pytest.raises(RuntimeError, match="below threshold"):
        run_harvest(spark, raw, root, 1, "t0", minimum=2)
    assert files.read_or_empty(spark, f"{root}/version=1", ROW).count() == 0
    first = run_harvest(spark, raw, root, 1, "t1", sites=["itviec", "glints"])
    second = run_harvest(spark, raw, root, 2, "t2", sites=["itviec"])
    assert (first["n_jobs"], first["n_new"], second["n_jobs"], second["n_new"]) == (1, 1, 1, 0)
    assert first["src_counts"] == {"itviec": 1, "glints": 0}
    assert files.read_runs(spark, f"{root}-runs").count() == 2
    assert spark.read.parquet(second["path"]).first().skills == ["Python"]


def test_history_is_found_across_a_gap(spark):
    from labourlens.operators.harvest import run_harvest
    from labourlens.schemas import RAW_POSTING

    def raw(*ids):
        rows = [{"job_id": i, "job_title": f"Role of {i}", "company_name": f"Firm {i}", "source_site": "glints", "skills_raw": ["Python"]} for i in ids]
        return spark.createDataFrame([tuple(r.get(f) for f in RAW_POSTING.fieldNames()) for r in rows], RAW_POSTING).withColumn("ord", F.col("job_id").substr(2, 5).cast("long"))
    root = scratch(spark, "t-gap")
    run_harvest(spark, raw("x1", "x2"), root, 1, "t1")
    with pytest.raises(RuntimeError, match="below threshold"):
        run_harvest(spark, raw("x3"), root, 2, "t2", minimum=5)
    third = run_harvest(spark, raw("x4"), root, 3, "t3")
    assert (third["n_jobs"], third["n_new"]) == (3, 1)
    assert spark.read.json(f"{root}-raw").count() == 3 and spark.read.parquet(f"{root}-skills").count() == 3
    assert {r.company_name for r in spark.read.parquet(f"{root}-companies").collect()} == {"Firm x1", "Firm x2", "Firm x4"}
    lost = scratch(spark, "t-lost")
    files.append_run(spark, f"{lost}-runs", {"timestamp": "t", "n_jobs": 3, "n_new": 1, "src_counts": {}})
    with pytest.raises(RuntimeError, match="no stored version"):
        run_harvest(spark, raw("x1"), lost, 4, "t4")


def test_an_arrival_is_dealt_over_files_that_grow_with_the_rows(spark, monkeypatch):
    from labourlens.plans import storage
    monkeypatch.setattr(storage, "ARRIVAL_ROWS", 100)
    path = scratch(spark, "t-waves")
    assert storage.waves(spark.range(1000).withColumnRenamed("id", "o"), path, "o", n=2) == 6
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 12 and sum(sizes) == 1000 and max(sizes) < 150


def test_a_harvest_leaves_its_wide_rows_compressed(spark):
    from labourlens.operators.harvest import run_harvest
    root, text = scratch(spark, "packed"), "one long description of a posting " * 40
    raw = spark.range(0, 300, 1, 2).select(
        F.concat(F.lit("j"), "id").alias("job_id"), F.concat(F.lit("Title "), F.md5(F.col("id").cast("string"))).alias("job_title"),
        F.concat(F.lit("Firm "), "id").alias("company_name"), F.lit("itviec").alias("source_site"),
        F.lit(text).alias("description_raw"), F.col("id").alias("ord"))
    shared = root[:root.rindex("/")].removeprefix("file:")
    old = set(os.listdir(shared))
    assert run_harvest(spark, raw, root, 1, "t1")["n_jobs"] == 300
    files_ = [os.path.join(f, n) for new in set(os.listdir(shared)) - old for f, _, names in os.walk(os.path.join(shared, new)) for n in names]
    assert max(map(os.path.getsize, files_)) < 300 * len(text) / 4
    back = spark.read.json(f"{root}-raw/harvest_no=1")
    assert back.where(F.col("description_raw") == text).select("job_id").distinct().count() == 300


def test_a_stream_leaves_compressed_arrivals_and_no_prepared_batches(spark, sf_dir):
    from labourlens.plans.storage import stream_harvest
    from labourlens.session import shared_dir
    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    kept = stream_harvest(spark, sf_dir)
    new = {n for n in set(os.listdir(root)) - before}
    src = next(n for n in new if n.startswith("harvest-src-"))
    parts = [n for n in os.listdir(f"{root}/{src}") if n.startswith("part-")]
    assert parts and all(n.endswith(".json.gz") for n in parts)
    assert not any(n.startswith("batch-") for n in new) and not kept.isEmpty()
    assert spark.sparkContext._jsc.sc().getRDDStorageInfo().__len__() == 0
