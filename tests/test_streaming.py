from conftest import rows, triples

from tripleloom.operators.changes import DeltaVectorTable
from tripleloom.plans.reasoner import closure
from tripleloom.plans.rules import default_rules
from tripleloom.streaming.incremental import ClosedTable, stream_changes, stream_closure

FACTS = triples("rdfs:subclassOf a owl:TransitiveProperty\nex:A rdfs:subclassOf ex:B\nex:B rdfs:subclassOf ex:C\nex:C rdfs:subclassOf ex:D")


def test_closure_of_a_stream(spark, tmp_path):
    for k, part in enumerate((FACTS[2:], FACTS[:2])):
        spark.createDataFrame(part, "s string, p string, o string").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    table = ClosedTable(spark, f"file://{tmp_path}/closed", default_rules())
    source = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream_closure(source, table, f"{tmp_path}/checkpoint").awaitTermination()
    want = closure(spark.createDataFrame(FACTS, "s string, p string, o string"), default_rules()).triples.select("s", "p", "o")
    assert rows(table.read()) == rows(want)
    table.apply(spark.createDataFrame(FACTS[:2], "s string, p string, o string"), 1)  # delivered again
    assert table.read().distinct().count() == want.count()


def test_changes_of_a_stream(spark, tmp_path):
    feed = "change_id bigint, s string, p string, o string, old_o string, status int, valid_from bigint, seq int"
    parts = [[(1, "<s>", "<p>", '"a"', None, 0, 1, 0)], [(2, "<s>", "<p>", '"b"', '"a"', 0, 2, 0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, feed).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    table = DeltaVectorTable(spark, f"file://{tmp_path}/t")
    source = spark.readStream.schema(feed).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream_changes(source, table, f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(table.read()) == [("<s>", "<p>", '"b"')]
