import datetime as dt

from ledgerloom.streaming.intake import JOB, Job, LeaseTerms, first_seen, leases, watch

T0 = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    return spark.createDataFrame([(j, a, o, T0 + dt.timedelta(seconds=s)) for j, a, o, s in rows], "job_id string, action string, owner string, at timestamp")


def test_leases_batch(spark):
    rows = [
        ("a", "submit", None, 1), ("a", "claim", "w", 2), ("a", "fail", "w", 3), ("a", "claim", "v", 4), ("a", "claim", "v", 34), ("a", "complete", "w", 35),  # too early, then again; not the holder
        ("b", "claim", "w", 1), ("c", "submit", None, 0), ("c", "claim", "w", 1), ("c", "complete", "w", 121), ("d", "submit", None, 0), ("d", "claim", "w", 1), ("d", "abort", "w", 2), ("d", "claim", "w", 99),
    ]
    df = requests(spark, rows + [(None, "submit", "w", 1), ("e", None, "w", 1)])
    got = {r.job_id: (r.status, r.attempts, r.owner, r.error) for r in leases(df).collect()}
    assert got == {"a": ("RUNNING", 2, "v", None), "b": ("NEW", 0, None, None), "c": ("RUNNING", 1, "w", None), "d": ("FAILED", 1, None, "REPORTED")}
    late = {r.job_id: r.status for r in leases(df, LeaseTerms(most_attempts=1), now=T0 + dt.timedelta(hours=1)).collect()}
    assert late == {"a": "FAILED", "b": "NEW", "c": "FAILED", "d": "FAILED"}
    assert leases(df.limit(0)).count() == 0


def test_lease_expiry_and_renewal():
    job, terms = Job(), LeaseTerms(lease_seconds=100, retry_seconds=10, most_attempts=2)
    for action, who, at in [("submit", None, 0), ("claim", "w", 1), ("renew", "w", 90), ("claim", "v", 150)]:
        job.apply(action, who, at * 1000, terms)
    assert (job.status, job.owner, job.attempts) == ("RUNNING", "w", 1)
    job.apply("claim", "v", 190_000, terms)
    assert (job.owner, job.attempts) == ("v", 2)
    job.apply("complete", "w", 191_000, terms)
    assert job.status == "RUNNING"
    job.expire(290_000, terms)
    assert (job.status, job.error) == ("FAILED", "LEASE_EXPIRED")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    requests(spark, [("a", "submit", "", 1), ("a", "claim", "w", 2), ("b", "submit", "", 1), ("b", "claim", "w", 2)]).write.parquet(src)
    schema = spark.read.parquet(src).schema
    terms = LeaseTerms(most_attempts=1)
    q = leases(watch(spark, src, schema), terms, delay="1 second").writeStream.format("memory").queryName("lease").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    requests(spark, [("a", "complete", "w", 3)]).write.mode("append").parquet(src)
    q.processAllAvailable()
    # time goes on with another job's request; b's lease runs out without one of its own
    requests(spark, [("z", "submit", "", 1000)]).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    rows = spark.table("lease")
    assert rows.columns == [x.split(" ")[0] for x in JOB.split(", ")]
    of = lambda j: [(r.status, r.error) for r in rows.where(f"job_id = '{j}'").collect()]
    assert of("a") == [("RUNNING", None), ("SUCCEEDED", None)]
    assert of("b") == [("RUNNING", None), ("FAILED", "LEASE_EXPIRED")]
    docs = str(tmp_path / "docs")
    spark.createDataFrame([("x", dt.datetime(2024, 1, 1)), ("x", dt.datetime(2024, 1, 1)), ("y", dt.datetime(2024, 1, 1))], "h string, t timestamp").write.parquet(docs)
    q = first_seen(watch(spark, docs, spark.read.parquet(docs).schema), "h", "t").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.h for r in spark.table("seen").collect()) == ["x", "y"]
