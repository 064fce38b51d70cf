import re
import time

from pyspark.sql import functions as F

from lattica.session import CLEANUP, cut


def test_cut_deletes_the_shuffle_files_of_its_table(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files.mkString(" ")))

    was, before = spark.conf.get(CLEANUP, None), shuffles()
    df = cut(spark.range(1000).repartition(5, F.xxhash64("id")))
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before and df.count() == 1000 and spark.conf.get(CLEANUP, None) == was
