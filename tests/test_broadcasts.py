"""What joins of temporary tables are broadcast."""

from pyspark.sql import functions as F

from foliant import shared


def test_a_wide_table_of_constants_is_not_broadcast_by_its_file(spark, monkeypatch):
    """Its file is small, what the driver would hold of it is not."""
    rows = 2_000_000
    wide = shared.written(spark.range(rows).select("id", *[F.lit(f"constant {k}").alias(f"c{k}") for k in range(30)]), "wide")
    joined = spark.range(rows).join(wide.select("id", "c1"), "id", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()  # outside: by the size of the file
    seen, write = [], type(joined.write).parquet

    def parquet(self, path, *more, **names):
        seen.append(self._df.select("*")._jdf.queryExecution().sparkPlan().toString())
        return write(self, path, *more, **names)

    monkeypatch.setattr(type(joined.write), "parquet", parquet)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    assert shared.written(joined, "joined").count() == rows
    assert seen and "BroadcastHashJoin" not in seen[0]
    assert [spark.conf.get(k, None) for k in keys] == before
