import pyarrow.parquet as pq
from pyspark.sql import functions as F

from panelflow.llm.common import ROW_GROUP_BYTES, written


def test_row_groups_are_bounded(spark, tmp_path):
    """However many rows a task writes, the next one's reader holds few of them: row groups don't grow with the input."""
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(30)])
    docs = spark.range(0, 12_000, 1, 1).select("id", text.alias("text"))
    back = written(docs, str(tmp_path), "docs")
    assert back.count() == 12_000 and back.exceptAll(docs).isEmpty()
    (file,) = tmp_path.glob("docs/part-*.parquet")
    found = pq.ParquetFile(file).metadata
    groups = [found.row_group(i) for i in range(found.num_row_groups)]
    sizes = [sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups]
    assert sum(sizes) > 2 * ROW_GROUP_BYTES and max(sizes) <= 1.25 * ROW_GROUP_BYTES
