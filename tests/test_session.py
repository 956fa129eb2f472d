import pytest

from metricwatch import session


class OnCluster:
    """A session as seen by checkpoint_dir, on a master that is not local."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Context:
                    @staticmethod
                    def getCheckpointDir():
                        class Undefined:
                            @staticmethod
                            def isDefined():
                                return False

                        return Undefined

                return Context


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(OnCluster)


def test_workers_get_the_package(spark):
    def imported(batches):
        import sys

        for batch in batches:
            yield batch.assign(ok=any("metricwatch.zip" in p for p in sys.path))

    assert session.prepare(spark) is spark
    assert spark.range(3).mapInPandas(imported, "id long, ok boolean").where("ok").count() == 3
