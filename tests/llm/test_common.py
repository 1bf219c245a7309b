import glob
import time

from pyspark.sql import functions as F

from tributary.llm.common import RELEASE, cut


def test_cut_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for d in manager.localDirs() for f in glob.glob(f"{d}/*/shuffle_*")}
    before, setting = files(), spark.conf.get(RELEASE, "false")
    out = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(RELEASE, "false") == setting
    assert out.agg(F.sum("count"), F.count("*")).first() == (1000, 7)
