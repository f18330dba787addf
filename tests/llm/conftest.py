import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoint_dir(spark, tmp_path_factory):
    """Tests on one machine name their own checkpoint folder where the session has none."""
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
