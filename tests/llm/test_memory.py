"""What stands in memory at once: batches of fat rows and the row groups of stored tables."""
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemill.llm.common import BATCH_BYTES, batch_rows, stored

SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
FAT = 1 << 20


def fat(spark, rows):
    """Rows of a megabyte that does not compress."""
    made = spark.range(0, rows, 1, 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(FAT // 64))))
    return made.groupBy("id").agg(F.concat_ws("", F.collect_list(F.sha2(F.concat_ws("|", "id", "i"), 256))).alias("x")).coalesce(1)


def test_a_batch_of_fat_rows_ends_at_its_bytes(spark):
    table = stored(fat(spark, 40), "fat")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    before = [spark.conf.get(k, None) for k in SETTINGS]
    with batch_rows(spark, 250):
        assert spark.conf.get(SETTINGS[2]) == "250"
        got = table.mapInArrow(run, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 40 and max(r["bytes"] for r in got) <= BATCH_BYTES + 2 * FAT
    assert [spark.conf.get(k, None) for k in SETTINGS] == before


def test_row_groups_of_fat_rows_are_bounded(spark):
    table = stored(fat(spark, 60), "fat")
    [path] = [f.removeprefix("file://") for f in table.inputFiles()]
    meta = pq.ParquetFile(path).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert meta.num_rows == 60 and max(sizes) <= (16 << 20) + 2 * FAT
