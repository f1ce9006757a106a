import pytest

from labourlens import session


def test_runtime_settings_can_be_changed_on_a_running_session(spark):
    # A static setting here would break every query in a session we did not build.
    assert all(spark.conf.isModifiable(k) for k in session.RUNTIME_CONF)
    session.tune(spark)
    assert all(spark.conf.get(k) == v for k, v in session.RUNTIME_CONF.items())


def test_cut_and_stored_keep_rows(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "k int, v array<string>")
    assert session.cut(df).count() == 2
    assert sorted(session.stored(df).collect()) == sorted(df.collect())
    assert session.scratch(spark, "x") != session.scratch(spark, "x")


def test_spread_only_touches_few_splits(spark):
    few = spark.range(10).coalesce(1)
    many = spark.range(0, 100, 1, 64)
    assert session.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(many).rdd.getNumPartitions() == 64


def test_cluster_needs_a_named_folder(monkeypatch):
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
