import os

import pytest

from pointfold.llm import common


def test_tables_are_dropped(spark):
    df = common.written(spark.range(3), "some")
    assert df.count() == 3
    folder = common.run_dir(spark)
    assert any(n.startswith("some-") for n in os.listdir(folder))
    common.drop_written(spark)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake)
