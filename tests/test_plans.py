import pytest
from pyspark.sql import functions as F

from tablemill.errors import OpError
from tablemill.plans import sql as sql_
from tablemill.plans.workspace import Workspace
from tablemill.sources import catalog, files
from tablemill.streaming import journal


@pytest.fixture
def space(spark):
    emp = spark.createDataFrame([(1, "ann", "x", 10), (2, "bob", "y", 20), (3, "cy", "x", 30)], "id int, name string, dept string, pay int")
    return Workspace(spark, {"emp": emp, "dept": spark.createDataFrame([("x", "north"), ("z", "south")], "dept string, place string")})


def test_rejected_calls_change_nothing(space):
    before = dict(space.handles)
    for args in (dict(tool="nope"), dict(tool="project", table="emp", expressions=["wrong"]), dict(tool="condition_filter", table="none", conditions=[]), dict(tool="limit", table="emp", wrong=1)):
        with pytest.raises(OpError):
            space.call(**args)
    assert space.handles == before and space.call("distinct", table="emp").name == "distinct_001"


def test_chain_with_values_and_tables(space):
    mean = space.group_aggregate("emp", group_by=[], aggregations=[{"op": "mean", "column": "pay", "as": "m"}])
    high = space.condition_filter("emp", conditions={"column": "pay", "op": ">=", "value_ref": {"table": mean.name}})
    known = space.condition_filter(high.name, conditions={"column": "dept", "op": "in", "in_table": "dept"})
    assert [r.name for r in known.df.collect()] == ["cy"]
    both = space.join_tables(base="emp", joins=[{"table": "dept", "on": [{"left": "emp.dept", "right": "dept"}], "type": "left"}])
    assert len(both.df.collect()) == 3 and both.inputs == ("emp", "dept")
    share = space.scalar_compute(operation="percent", operands=[{"value_ref": mean.name}, 40])
    assert share.df.first()[0] == 50.0
    assert space.set_op(left="emp.dept", right="dept.dept", op="except").df.collect()[0][0] == "y"
    assert space.backward_slice(known.name) == ["emp", high.name, known.name] and space.check("distinct", table="emp") == ["id", "name", "dept", "pay"]


def test_order_is_kept_or_lost(space):
    top = space.extreme_value_select("emp", order_by=["pay DESC"])
    assert top.ordered and space.condition_filter(top.name, conditions=[]).ordered
    assert not space.group_aggregate(top.name, group_by=["dept"], aggregations=[]).ordered


def test_steps_isolate_failures(space):
    steps = [
        {"id": "a", "tool": "distinct", "args": {"table": "emp"}},
        {"id": "b", "tool": "project", "args": {"table": {"step": "a"}, "expressions": ["nope"]}},
        {"id": "c", "tool": "distinct", "args": {"table": {"step": "b"}}},
        {"id": "d", "tool": "distinct", "args": {"table": {"step": "a"}}},
    ]
    done = space.run(steps, isolate=True)
    assert done["b"]["code"] == "unknown_column" and done["c"]["code"] == "blocked" and len(done["d"].df.collect()) == 3
    with pytest.raises(OpError):
        space.run(steps)
    with pytest.raises(OpError, match="unknown_step"):
        space.run([{"id": "z", "tool": "distinct", "args": {"table": {"step": "later"}}}])


def test_checkpoints(space):
    space.checkpoint("start")
    space.distinct("emp")
    space.restore("start")
    assert set(space.handles) == {"emp", "dept"}
    assert space.distinct("emp").name == "distinct_002"
    with pytest.raises(OpError):
        space.restore("never")


def test_sql_is_read_only(spark, space):
    out = space.execute_sql(sql="SELECT dept, sum(pay) AS s FROM emp GROUP BY dept")
    assert sorted(map(tuple, out.df.collect())) == [("x", 40), ("y", 20)]
    for bad in ("DROP TABLE emp", "SELECT 1; SELECT 2", "INSERT INTO emp SELECT * FROM emp", "WITH a AS (SELECT 1) INSERT INTO emp SELECT * FROM a"):
        with pytest.raises(OpError, match="not_read_only"):
            sql_.execute_sql(spark, bad, {})
    assert sql_.check_read_only("SELECT ';' AS x;") == "SELECT ';' AS x"
    assert not spark.catalog.tableExists("emp")
    assert space.try_call("execute_sql", sql="SELECT * FROM nowhere")["code"] == "table_or_view_not_found"
    with pytest.raises(OpError, match="too_many_rows"):
        sql_.bounded(spark.range(5), 4)
    assert sql_.preview(spark.range(5), 3)[1]


def test_deadline(spark):
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    with pytest.raises(OpError, match="deadline_exceeded"):
        sql_.within(spark, 2, lambda: spark.range(1).select(slow("id")).collect())
    assert sql_.within(spark, 60, lambda: spark.range(3).count()) == 3


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    files.sink_parquet(df, f"{tmp_path}/p")
    assert sorted(files.scan_table(spark, f"{tmp_path}/p").collect()) == sorted(df.collect())
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"}, {"id": 2}]')
    assert files.scan_json_array(spark, f"{tmp_path}/a.json", "id long, name string").count() == 2
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    assert files.scan_csv(spark, f"{tmp_path}/a.csv").first().name == "x"
    files.sink_sample(df, f"{tmp_path}/s", 1, "id", "test")
    assert files.scan_jsonl(spark, f"{tmp_path}/s").first().source == "test"
    task = files.tasks(df, "set", "dev", {"task_id": "id", "question": "name"}).orderBy("task_id").first()
    assert (task.task_id, task.question, task.dataset, task.gold_sql, task.metadata) == ("1", "x", "set", None, None)


def test_journal_resumes(spark, tmp_path):
    args = dict(path=f"{tmp_path}/j", schema="id long, ok boolean", key="id")
    log = files.Journal(spark, config={"model": 1}, **args)
    assert log.append(spark.createDataFrame([(1, True), (2, False)], args["schema"])) == 2
    again = files.Journal(spark, config={"model": 1}, **args)
    assert again.append(spark.createDataFrame([(2, True), (3, True)], args["schema"])) == 1
    assert again.records(F.col("ok")).count() == 2
    with pytest.raises(ValueError, match="another configuration"):
        files.Journal(spark, config={"model": 2}, **args)


def test_streamed_journal_takes_each_record_once(spark, tmp_path):
    schema, folder = "id long, ts timestamp", tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"id": 1, "ts": "2024-01-01T00:00:00"}\n{"id": 1, "ts": "2024-01-01T00:00:00"}\n')
    for n in (1, 2):
        stream = journal.records_stream(spark, str(folder), schema)
        journal.to_journal(stream, f"{tmp_path}/out", f"{tmp_path}/mark", "id", "ts").awaitTermination(120)
        assert spark.read.schema(schema).json(f"{tmp_path}/out").count() == n
        (folder / f"{n + 1}.json").write_text('{"id": 1, "ts": "2024-01-01T00:00:01"}\n{"id": 2, "ts": "2024-01-01T00:00:02"}\n')
    counts = journal.counts_by_window(journal.records_stream(spark, str(folder), schema), "ts", [], "1 minute", "0 seconds")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.n for r in spark.table("counts").collect()] == [6]


def test_catalog_keys(spark, space):
    sources = {
        "dept": catalog.Source("dept", space.handles["dept"].df, ("dept",)),
        "emp": catalog.Source("emp", space.handles["emp"].df, ("id",), (catalog.ForeignKey("dept", "dept"),)),
    }
    assert catalog.edges(sources) == [("emp", "dept", "dept", "dept")]
    assert catalog.columns(spark, sources).filter("is_key").count() == 2
