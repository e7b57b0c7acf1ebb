import pytest
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.operators import harmonize
from tidewatch.sources import datasets
from tidewatch.sources.schemas import NSL_SCHEMA, UNSW_SCHEMA


def nsl(spark, **over):
    row = {f.name: ("x" if f.dataType.simpleString() == "string" else
                    0.0 if f.dataType.simpleString() == "double" else 0) for f in NSL_SCHEMA.fields}
    row.update(over)
    return spark.createDataFrame([tuple(row[c] for c in K.NSL_COLUMNS)], NSL_SCHEMA)


def unsw(spark, **over):
    row = {f.name: ("x" if f.dataType.simpleString() == "string" else
                    0.0 if f.dataType.simpleString() == "double" else 0) for f in UNSW_SCHEMA.fields}
    row.update(over)
    return spark.createDataFrame([tuple(row[f.name] for f in UNSW_SCHEMA.fields)], UNSW_SCHEMA)


def test_layout(spark):
    assert len(K.NSL_COLUMNS) == 43 and len(K.NSL_ATTACK_CATEGORY) == 40
    assert harmonize.nsl_standardize(nsl(spark)).columns == K.UNIFIED_COLUMNS
    assert harmonize.unsw_standardize(unsw(spark)).columns == K.UNIFIED_COLUMNS
    assert len(K.UNIFIED_COLUMNS) == 23


@pytest.mark.parametrize("attack,category,label,event", [
    ("normal", "Normal", 0, 0), ("neptune", "DoS", 1, 1), ("mystery", "Unknown", 1, 5), (None, "Unknown", 1, 5)])
def test_nsl_rules(spark, attack, category, label, event):
    row = harmonize.nsl_standardize(nsl(
        spark, attack_type=attack, flag=None, service="http", protocol_type="udp", src_bytes=-1,
        dst_bytes=1023, duration=400, root_shell=1, su_attempted=2)).first()
    assert (row["attack_category"], row["label"], row["event_type_code"]) == (category, label, event)
    assert (row["log_level_code"], row["protocol_code"], row["log_bytes_sent"], row["log_bytes_recv"]) == (1, 1, 0.0, 10.0)
    assert row["norm_duration"] == 1.0 and row["message_risk_score"] == 50
    assert row["dst_port"] == 80 / 65535 and row["dataset"] == "NSL-KDD"


@pytest.mark.parametrize("raw,cleaned,category", [
    (" Fuzzers ", "Fuzzers", "Probe"), (None, "Normal", "Normal"), ("", "Normal", "Normal"),
    (" ", "Normal", "Normal"), ("Weird", "Weird", "Unknown")])
def test_unsw_rules(spark, raw, cleaned, category):
    row = harmonize.unsw_standardize(unsw(
        spark, attack_cat=raw, proto=" ARP", service=" DNS", state=None, label=1, sttl=None,
        is_ftp_login=1, ct_state_ttl=12, ct_flw_http_mthd=9, spkts=3, dpkts=4, sload=2e6, dttl=300)).first()
    assert (row["attack_type"], row["attack_category"], row["label"]) == (cleaned, category, 1)
    assert (row["protocol_code"], row["dst_port"], row["log_level_code"]) == (3, 53 / 65535, 2)
    assert row["message_risk_score"] == 50  # 20 + 0 + 15 + 15
    assert (row["count"], row["serror_rate"], row["dst_host_serror_rate"]) == (7.0, 1.0, 1.0)


def test_nulls_stay_null(spark):
    row = harmonize.unsw_standardize(unsw(spark, sbytes=None, dur=None, sload=None, ct_state_ttl=None)).first()
    assert row["log_bytes_sent"] is None and row["norm_duration"] is None
    assert row["serror_rate"] is None and row["message_risk_score"] is None


def test_synthetic_columns_are_repeatable_and_in_range(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    made = harmonize.synthetic_from("k")

    def draw(n):
        rows = df.repartition(n).select("k", made.src_port, made.hour, made.weekend, made.port).collect()
        return sorted(tuple(r) for r in rows)
    one = draw(1)
    assert one == draw(7)
    assert all(1024 <= r[1] < 65535 and 0 <= r[2] < 1 and 1024 <= r[4] < 65535 for r in one)
    assert 0.24 < sum(r[3] for r in one) / 5000 < 0.32


def test_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(2000)
    first = [r[0] for r in harmonize.seeded_shuffle(df).collect()]
    assert sorted(first) == list(range(2000)) and first != sorted(first)
    assert first == [r[0] for r in harmonize.seeded_shuffle(df.repartition(9)).collect()]


@pytest.mark.parametrize("n,expected", [(0, 500), (137, 137), (500, 500), (900, 500)])
def test_subsample_size(spark, n, expected):
    df = spark.range(500)
    got = harmonize.subsample(df, n, row_key=F.col("id"))
    assert got.count() == expected == got.distinct().count()


def test_union_needs_a_part(spark):
    with pytest.raises(ValueError):
        harmonize.union_datasets(None, None)
    assert harmonize.union_datasets(None, spark.range(3)).count() == 3


def test_files_and_missing_sources(spark, tmp_path):
    root = str(tmp_path)
    nsl(spark, attack_type="neptune").write.csv(f"{root}/nsl-train")
    nsl(spark, attack_type="normal").write.csv(f"{root}/nsl-test")
    header = [f.name for f in UNSW_SCHEMA.fields][::-1] + ["extra"]
    for name in ("unsw-train", "unsw-test"):
        frame = unsw(spark, attack_cat=" DoS ", sbytes=7).withColumn("extra", F.lit("e")).select(*header)
        frame.coalesce(1).write.option("header", True).csv(f"{root}/{name}")
    read = datasets.read_unsw_csv(spark, f"{root}/unsw-train")
    assert read.first()["sbytes"] == 7 and dict(read.dtypes)["sbytes"] == "bigint" and "extra" in read.columns
    train, test = datasets.load_datasets(spark, (f"{root}/nsl-train", f"{root}/nsl-test"), (f"{root}/a", f"{root}/b"))
    assert [r["dataset"] for r in train.collect()] == ["NSL-KDD"]
    train, test = datasets.load_datasets(spark, (f"{root}/nsl-train", f"{root}/none"),
                                         (f"{root}/unsw-train", f"{root}/unsw-test"))
    assert [r["attack_category"] for r in train.collect()] == ["DoS"]
    with pytest.raises(FileNotFoundError):
        datasets.load_datasets(spark, (f"{root}/a", f"{root}/b"), (f"{root}/c", f"{root}/d"))


def test_unified_round_trip(spark, tmp_path):
    table = harmonize.nsl_standardize(nsl(spark, attack_type="smurf"))
    assert datasets.read_unified_table(spark, f"{tmp_path}/none") is None
    for fmt in ("parquet", "csv"):
        path = f"{tmp_path}/{fmt}"
        datasets.write_unified_table(table, path, fmt)
        back = datasets.read_unified_table(spark, path, table.schema, fmt).select(*K.UNIFIED_COLUMNS)
        assert back.collect() == table.collect()


def test_dataset_views_read_their_tables(spark, sf, tmp_path):
    """A table of many splits is not copied first; the rows are those of the copy, by methods that are compiled."""
    from tidewatch.session import METHOD_LIMIT
    from verification.queries import Inputs

    spark.conf.unset(METHOD_LIMIT)
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(64).write.parquet(f"{tmp_path}/{name}.parquet")
    limits = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "20000"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        many, few = Inputs(spark, str(tmp_path)), Inputs(spark, sf)
        for view in ("unsw", "nsl"):
            got, want = getattr(many, view), getattr(few, view)
            assert all(str(tmp_path) in file for file in got.inputFiles())
            assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert spark.conf.get(METHOD_LIMIT) == "8000"
