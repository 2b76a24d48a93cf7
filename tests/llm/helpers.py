import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
SF = "/root/testdata/sf0.001"


def words(text, fold=True):
    t = text or ""
    return WORD.findall(t.translate(FOLD) if fold else t)


def frame(spark, rows, schema):
    """Two partitions, so that groups meet across tasks."""
    return spark.createDataFrame(rows, schema).repartition(2)
