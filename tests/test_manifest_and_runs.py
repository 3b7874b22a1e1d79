import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pairlight import sources
from pairlight.operators import manifest as manifests
from pairlight.operators import runlog
from pairlight.sources import images
from pairlight.streaming import stage_totals, start_commits, start_totals


def png(width=6, height=4, ppm=39370, unit=1):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    phys = chunk(b"pHYs", struct.pack(">IIB", ppm, ppm, unit)) if ppm else b""
    raw = b"".join(b"\0" + bytes(width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + phys + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_header():
    assert images.png_header(png()) == (6, 4, 8, 0, 1000.0, 1000.0)
    assert images.png_header(png(ppm=0))[4:] == (None, None) == images.png_header(png(unit=0))[4:]
    for bad in (b"", b"GIF89a", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            images.png_header(bad)


def test_file_names(spark):
    of = lambda n: spark.createDataFrame([(n,)], "n string").select(manifests.parse_file_name(F.col("n")).alias("f")).first().f
    assert tuple(of("90417755_J_500_palm_10.png")) == ("90417755", "J", 500, "palm", 10)
    for bad in ("90417755_J_500_palm_1.png", "90417755-J-500-palm-10.png", "x90417755_J_500_palm_10.png", "90417755_J_500_palm_10.png.bak", "90417755_J__palm_10.png", ""):
        with pytest.raises(Exception, match="not an image file name"):
            of(bad)


def test_manifest_from_files(spark, tmp_path):
    folder = tmp_path / "u"
    folder.mkdir()
    for name, data in (("00000001_U_1000_roll_01.png", png()), ("00000001_U_1000_roll_02.png", png(ppm=0)), ("00000002_U_1000_roll_01.png", png(7)), ("00000003_U_1000_roll_01.png", png(8))):
        (folder / name).write_bytes(data)
    import hashlib

    good = hashlib.sha256(png()).hexdigest().upper()
    (tmp_path / "checksum1.csv").write_text(f"filename, sha256\nx/00000001_U_1000_roll_01.png,{good}\n00000002_U_1000_roll_01.png,00\n")
    (tmp_path / "checksum2.csv").write_text("other,checksum,filename\n1,ab,00000009_U_1000_roll_01.png\n1, 11 ,00000002_U_1000_roll_01.png\n")
    (tmp_path / "participants.csv").write_text("id,collection_day\n00000001,3\n00000002,4\n")
    found = images.read_images(spark, {"U": str(folder)})
    listed = sources.read_checksums(spark, {"U": str(tmp_path / "checksum*.csv")})
    assert {r.name: r.listed for r in listed.collect()}["00000002_U_1000_roll_01.png"] == "11"
    people = sources.read_participants(spark, str(tmp_path / "participants.csv"))
    exclusions = spark.createDataFrame([("U", "00000002", 1, "C9", "smudged", "x")], sources.EXCLUSIONS)
    sets = spark.createDataFrame([("U", "roll", "rolled", "device", "dir")], "set string, capture_label string, impression string, device_model string, directory string")
    m = {r.image_id: r for r in manifests.build(found, listed, exclusions, people, sets).collect()}
    assert (m["U_00000001_01"].checksum, m["U_00000001_01"].excluded, m["U_00000001_01"].exclusion_reason) == ("ok", 0, "")
    assert m["U_00000001_02"].exclusion_reason == "R2: checksum not_listed; R2: header resolution NonexNone ppi"
    assert m["U_00000002_01"].exclusion_reason == "C9: smudged; R2: checksum mismatch"
    assert m["U_00000003_01"].exclusion_reason.endswith("subject missing from participants.csv") and m["U_00000003_01"].relpath == "dir/png/00000003_U_1000_roll_01.png"
    assert [r.name for r in manifests.missing_files(listed, found).collect()] == ["00000009_U_1000_roll_01.png"]
    assert manifests.unmatched_exclusions(exclusions, manifests.build(found, listed, exclusions, people, sets)).count() == 0
    stray = spark.createDataFrame([("U", "00000002", 9, "C9", "smudged", "x")], sources.EXCLUSIONS)
    with pytest.raises(Exception, match="name no image"):
        manifests.build(found, listed, exclusions.union(stray), people, sets).select("set").collect()
    with pytest.raises(Exception, match="duplicate exclusion"):
        manifests.build(found, listed, exclusions.union(exclusions), people, sets).collect()
    with pytest.raises(Exception, match="does not belong"):
        manifests.build(found, listed, exclusions, people, sets.withColumn("capture_label", F.lit("slap"))).collect()


def test_csv_round_trip(spark, tmp_path):
    rows = [("p", "UxV", "genuine", 1, "a", "b", 1, "ok", "", "3"), ("q", "UxV", "impostor", 1, "a", "c", 0, "failed", "few", "7"), ("r", "UxV", "impostor", 1, "a", "d", 0, "ok", "", None)]
    df = spark.createDataFrame(rows, sources.SCORES)
    sources.write_csv(df, str(tmp_path / "s"), ["pair_id"])
    assert {r.pair_id: r.score for r in sources.read_scores(spark, str(tmp_path / "s")).collect()} == {"p": 3.0, "q": None, "r": None}
    with pytest.raises(Exception, match="already exists"):
        sources.write_csv(df, str(tmp_path / "s"), ["pair_id"])
    (tmp_path / "sample.csv").write_text("image_id,set\nb,U\na,U\n")
    m = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "image_id string, x int")
    assert [r.image_id for r in sources.read_ordered_ids(spark, str(tmp_path / "sample.csv"), m).orderBy("pos").collect()] == ["b", "a"]
    (tmp_path / "c.txt").write_text("1,2\n3,4\n")
    assert sorted((r["row"], r["col"]) for r in sources.read_coordinates(spark, str(tmp_path / "c.txt")).collect()) == [(1, 2), (3, 4)]


def plan_of(spark, n=53, size=10):
    items = spark.range(n).select(F.format_string("%s_%08d_01", F.when(F.col("id") % 2 == 0, "U").otherwise("R"), "id").alias("image_id")).repartition(5)
    cost = spark.createDataFrame([("U", 2.0), ("R", 1.0)], "set string, seconds double")
    return runlog.chunk_plan(items, "one/extract", size, ["image_id"], "image_id", cost)


def test_chunks_are_contiguous(spark):
    rows = sorted(plan_of(spark).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(53)) and [r.item for r in rows] == sorted(r.item for r in rows) and all(r.chunk == r.pos // 10 for r in rows)
    heads = {r.chunk: r for r in runlog.chunk_heads(plan_of(spark)).collect()}
    assert len(heads) == 6 and heads[5]["count"] == 3 and heads[0]["first"] == rows[0].item and heads[0]["last"] == rows[9].item
    digests = {runlog.fingerprint(plan_of(spark).repartition(3)).first().digest for _ in range(2)}
    assert len(digests) == 1 and runlog.fingerprint(plan_of(spark, 52)).first().digest not in digests


def test_positions_of_a_plan_in_many_partitions(spark):
    """The numbered rows and the counts before them are of one dealing, however Spark coalesces what it reads of each."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = plan_of(spark, 100_000, 200).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high")).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tuple(found) == (100_000, 100_000, 0, 99_999)


def test_resume_runs_every_chunk_once(spark, tmp_path):
    plan, paths = plan_of(spark).cache(), (str(tmp_path / "results"), str(tmp_path / "log"))

    def run(todo, started, logged=True):
        todo.select("stage", "chunk", "item", F.length("item").alias("score"), F.lit(started).alias("started")).write.mode("append").parquet(paths[0])
        if logged:
            runlog.log_rows(todo, started, started + 1).write.mode("append").parquet(paths[1])

    run(plan.where("chunk < 4"), 1.0)
    run(plan.where("chunk = 4"), 2.0, logged=False)  # stopped between results and log
    left = runlog.remaining(plan, spark.read.schema(runlog.LOG).parquet(paths[1]))
    assert {r.chunk for r in left.collect()} == {4, 5}
    run(left, 3.0)
    log = spark.read.schema(runlog.LOG).parquet(paths[1])
    assert runlog.remaining(plan, log).count() == 0 and log.count() == 6
    results = runlog.stage_results(spark.read.parquet(paths[0]), log)
    assert results.count() == 53 and results.select("item").distinct().count() == 53
    with pytest.raises(Exception, match="not of this plan"):
        runlog.checked_log(log, runlog.chunk_heads(plan_of(spark, 40))).collect()
    start_totals(spark, paths[1], str(tmp_path / "totals"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "totals")).first()["items"] == 53 == stage_totals(log).first()["items"]


def test_forecast(spark):
    heads = runlog.chunk_heads(plan_of(spark))
    log = heads.where("chunk < 3").select("*", F.lit(0.0).alias("started"), (F.col("expected_s") * 2).alias("finished"))
    stages = spark.createDataFrame([("one/extract", "one", "extract"), ("other/extract", "other", "extract")], "stage string, algorithm string, kind string")
    row = runlog.progress(heads, log, stages, 1e6, 1).first()
    left = sum(r.expected_s for r in heads.collect() if r.chunk >= 3)
    assert (row.items_done, row.chunks_done) == (30, 3) and row.remaining_s == pytest.approx(2 * left)
    assert {r.stage: r.factor for r in runlog.pace(heads, log, stages, 1e6, 1).collect()} == {"one/extract": 2.0, "other/extract": 1.0}
    total = runlog.overall(runlog.progress(heads, log, stages, 1e6, 1)).first()
    assert total.remaining_s == pytest.approx(2 * left) and 0 < total.percent < 100
    assert runlog.runtime(log).first()["items"] == 30


def test_headers_are_read_without_the_pixels(spark, tmp_path):
    """Bytes read: a first look at each file, and the whole of it only for a digest."""
    import hashlib

    data = png() [:-12] + struct.pack(">I", 3_000_000) + b"tEXt" + bytes(3_000_004) + png()[-12:]
    late = png(5)[:33] + struct.pack(">I4s", 2000, b"tEXt") + bytes(2004) + png(5)[33:]  # the resolution comes after a long text
    for name, content in (("a.png", data), ("b.png", late), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    heads = {r.name: r for r in images.read_images(spark, {"U": str(tmp_path)}, digest=False).collect()}
    assert set(heads) == {"a.png", "b.png"} and heads["a.png"].bytes_read <= images.LOOK and heads["b.png"].bytes_read <= 2000 + 3 * images.LOOK
    assert (heads["a.png"].width, heads["b.png"].width, heads["b.png"].ppi_x, heads["a.png"].sha256) == (6, 5, 1000.0, None)
    whole = {r.name: r for r in images.read_images(spark, {"U": f"file://{tmp_path}"}).collect()}
    assert whole["a.png"].sha256 == hashlib.sha256(data).hexdigest() and whole["a.png"].bytes_read >= len(data)
    assert images.read_images(spark, {"U": str(tmp_path), "V": str(tmp_path)}).where("set = 'V'").count() == 2


def test_scores_are_written_in_order_whatever_the_files(spark, tmp_path):
    rows = [(f"p{k}", "UxV" if k % 3 else "RxV", "impostor", k % 10, f"a{k % 7}", f"b{k}", "ok" if k % 5 else "failed", "" if k % 5 else "few, or none", str(k) if k % 5 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "pair_id string, scenario string, kind string, frgp int, probe_image_id string, reference_image_id string, status string, reason string, score string")
    compact = spark.createDataFrame([(f"p{k}",) for k in range(0, 200, 4)] * 2, "pair_id string")
    found = []
    for files in (1, 5):
        sources.write_scores(df.repartition(files + 1), compact, str(tmp_path / f"s{files}"), files)
        found.append(b"".join(p.read_bytes() for p in sorted((tmp_path / f"s{files}").glob("part-*.csv"))))
    assert found[0] == found[1] and len(list((tmp_path / "s5").glob("part-*.csv"))) == 5
    back = sources.read_written_scores(spark, str(tmp_path / "s5")).collect()
    assert {(r.pair_id, r.compact, r.score, r.reason) for r in back} == {(r[0], int(int(r[0][1:]) % 4 == 0), float(r[8]) if r[8] else None, r[7] or None) for r in rows}
    order = [(x.split(",")[1], int(x.split(",")[3]), *x.split(",")[4:6]) for x in found[0].decode().splitlines()]
    assert order == sorted(order)
    with pytest.raises(Exception, match="already exists"):
        sources.write_scores(df, compact, str(tmp_path / "s5"))


def test_reports_round_trip(spark, tmp_path):
    import json

    from pairlight.sources import reports

    rows = [(name, s, a, far, far / 2, 1, 0.25, 4, 10, 0.75, t, 3) for name in ("one", "two") for s in ("UxV", "RxV") for a in ("קו", "b") for far, t in ((0.01, 5.0), (0.001, None))]
    schema = "report string, scenario string, algorithm string, far_target double, far double, false_accepts long, frr double, genuine long, impostor long, tar double, threshold double, true_accepts long"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "reports")
    reports.write_reports(df, path)
    assert sorted(map(tuple, reports.result_rows(reports.read_reports(spark, path)).select(*df.columns).collect()), key=repr) == sorted(rows, key=repr)
    files = list((tmp_path / "reports").glob("report=one/part-*"))
    text = files[0].read_text()
    assert len(files) == 1 and text == reports.json_text(json.loads(text)) and "קו" in text and text.count("\n") > 20
    with pytest.raises(Exception, match="already exists"):
        reports.write_reports(df, path)


def test_commit_leaves_one_copy(spark, tmp_path):
    """A chunk committed twice, and one whose first attempt failed between results and log."""
    plan, paths = plan_of(spark).cache(), (str(tmp_path / "results"), str(tmp_path / "log"))
    schema = "stage string, chunk long, pos long, item string, score int, attempt int"
    of = lambda chunks, attempt: plan.where(chunks).select("stage", "chunk", "pos", "item", F.length("item").alias("score"), F.lit(attempt).alias("attempt"))
    runlog.commit(of("chunk < 4", 1), plan, *paths, 1.0, 2.0)
    runlog.commit(of("chunk = 2", 2), plan, *paths, 3.0, 4.0)
    runlog.commit(of("chunk = 4", 1), plan, paths[0], str(tmp_path / "lost"), 5.0, 6.0)  # its log rows never arrive
    assert runlog.committed(spark, *paths, schema).count() == 40
    left = runlog.remaining(plan, spark.read.schema(runlog.LOG).parquet(paths[1]))
    assert {r.chunk for r in left.collect()} == {4, 5}
    runlog.commit(of("chunk >= 4", 2), plan, *paths, 7.0, 8.0)
    done = runlog.committed(spark, *paths, schema).collect()
    assert len(done) == 53 == len({r.item for r in done}) and {r.chunk: r.attempt for r in done} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 2, 5: 2}
    log = spark.read.schema(runlog.LOG).parquet(paths[1])
    assert log.count() == 6 and runlog.checked_log(log, runlog.chunk_heads(plan)).count() == 6
    wrong = of("chunk = 1", 9)
    for bad in (wrong.where("pos != 12"), wrong.union(wrong.limit(1)), wrong.withColumn("pos", F.lit(29) - F.col("pos")), wrong.withColumn("item", F.lit("x"))):
        with pytest.raises(Exception, match="do not match the plan"):
            runlog.commit(bad, plan, *paths, 9.0, 9.0)
    assert {r.attempt for r in runlog.committed(spark, *paths, schema).where("chunk = 1").collect()} == {1}


def test_results_of_a_stream_are_committed_once(spark, tmp_path):
    plan, paths = plan_of(spark).cache(), (str(tmp_path / "results"), str(tmp_path / "log"))
    schema, inbox = "stage string, chunk long, pos long, item string, score int", str(tmp_path / "inbox")
    send = lambda chunks: plan.where(chunks).select("stage", "chunk", "pos", "item", F.length("item").alias("score")).coalesce(1).write.mode("append").parquet(inbox)
    go = lambda: start_commits(spark.readStream.schema(schema).parquet(inbox), plan, *paths, str(tmp_path / "checkpoint"), 1.0, 2.0).awaitTermination()
    send("chunk < 2")
    go()
    assert runlog.committed(spark, *paths, schema).count() == 20
    send("chunk >= 1")  # chunk 1 comes again
    go()
    done = runlog.committed(spark, *paths, schema).collect()
    assert len(done) == 53 == len({r.item for r in done})
    send("chunk = 3 and pos != 31")
    with pytest.raises(Exception, match="do not match the plan"):
        go()
    assert runlog.committed(spark, *paths, schema).count() == 53
