from pyspark.sql import functions as F

from alarmlens.runtime import materialize, own_table, release, run_dir


def test_release_leaves_nothing(spark):
    kept = materialize(spark.range(3), "kept")
    name, path = own_table(spark, "bucketed")
    spark.range(5).withColumn("k", F.col("id") % 2).write.bucketBy(2, "k").option("path", path).saveAsTable(name)
    assert kept.count() == 3 and spark.table(name).count() == 5
    release(spark)
    assert not spark.catalog.tableExists(name)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
