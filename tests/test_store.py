import pytest
from pyspark.sql import functions as F

from quillgrid import staging
from quillgrid.sources import container
from quillgrid.store import NAMES, Block, with_fid
from quillgrid.types import FID, Feature, field, fields_of, schema_of


class Point(Feature):
    x: "f64"  # noqa: F821
    y: "f64"  # noqa: F821
    z: "f64"  # noqa: F821
    _private: int = 0


class Triangle(Feature):
    id: "u32"  # noqa: F821
    a: Point
    b: Point
    c: Point


def test_schema_of_annotations():
    assert list(fields_of(Point)) == ["x", "y", "z"]
    s = schema_of(Triangle)
    assert s.fieldNames() == [FID, "id", "a", "b", "c"] and s["a"].metadata["ref"] == "Point"
    with pytest.raises(ValueError):
        field("a_name_of_more_than_15", "u8")
    with pytest.raises(AttributeError):
        Point(w=1)


def test_push_deref_and_names(spark):
    b = Block.create(spark)
    t = Triangle(id=1, a=Point(x=1, y=10, z=20), b=Point(x=2, y=11, z=21), c=Point(x=3, y=12, z=22))
    with pytest.raises(RuntimeError):
        b["Point"]
    for v in (t.a, t.b, t.c):
        v.x, v.y, v.z = float(v.x), float(v.y), float(v.z)
    b.push(t, name="first")
    b.fix()
    assert list(b.layers) == [NAMES, "Triangle", "Point"] or len(b) == 3
    row = b.get("first")
    assert row["id"] == 1 and b.get("none") is None
    c = b.at(row["c"]["ilayer"], row["c"]["ifeature"])
    assert (c["x"], c["y"], c["z"]) == (3.0, 12.0, 22.0)
    with pytest.raises(RuntimeError):
        b.push(t)
    with pytest.raises(IndexError):
        b["Point"][3]


def test_truncate_appends_children_and_copies_values(spark):
    b = Block.truncate(spark, [(Point, 6, "Point"), (Triangle, 1, "TA"), (Triangle, 1, "TB")])
    assert len(b["Point"]) == 6 + 3 + 3
    b = b.update_column("Point", "x", __import__("pyspark.sql.functions", fromlist=["x"]).col(FID) * 0.1)
    b = b.assign_ref("TA", 0, "a", (0, 2))
    ref = b["TA"][0]["a"]
    assert b.at(ref["ilayer"], ref["ifeature"])["x"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        Block.truncate(spark, [(Point, 0, "Point")])
    with pytest.raises(KeyError):
        b.get("name")


def test_update_cell_save_load_share(spark, tmp_path):
    b = Block.truncate(spark, [(Point, 3, "P")]).update_cell("P", 1, "y", 7)
    b.save(str(tmp_path / "b"))
    back = Block.load(spark, str(tmp_path / "b"))
    assert [r["y"] for r in back["P"]] == [0.0, 7.0, 0.0] and len(back) == 1
    back.share("shared_block")
    assert len(Block.attach(spark, "shared_block")["p" if "p" in Block.attach(spark, "shared_block").layers else "P"]) == 3
    back.unlink("shared_block")
    with pytest.raises(FileNotFoundError):
        Block.load(spark, str(tmp_path / "none"))


def test_container_keeps_every_type(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(FID, T.LongType(), False), field("a", "u8"), field("b", "u32"), field("c", "i32"), field("n", "u8n", 0.0, 1.0), field("m", "u16n", 0.0, 1.0), field("s", "str"), field("w", "wstr"), field("r", "ref"), field("raw", "bytes")])
    rows = [(0, 255, 2**32 - 1, -5, 0.5, 0.5, "x", "\U0001f600", (1, 7), b"\x00\x01"), (1, 0, 0, 2, 1.0, 1.0, "", "ü", (0, 2**24 - 1), b"")]
    b = Block.of(spark, {"L": spark.createDataFrame(rows, schema)})
    container.save(b, str(tmp_path / "c.db"))
    got = [r.asDict(recursive=True) for r in container.load(spark, str(tmp_path / "c.db"))["L"]]
    assert got[0]["a"] == 255 and got[0]["b"] == 2**32 - 1 and got[0]["c"] == -5
    assert got[0]["n"] == pytest.approx(127 / 255) and got[0]["m"] == pytest.approx(32767 / 65535)
    assert got[0]["w"] == "\U0001f600" and got[1]["r"] == {"ilayer": 0, "ifeature": 2**24 - 1} and bytes(got[0]["_bytes"]) == b"\x00\x01"
    with pytest.raises(ValueError):
        container.headers(b"nothing")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_numbers_of_wide_rows_in_many_partitions(spark, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(old, (adaptive, "64", "1m"), strict=True):
            spark.conf.set(k, v)
        wide = spark.range(0, 30_000, 1, 16).select((F.pmod(F.col("id") * 7919, F.lit(30_011))).alias("k"), F.col("id").alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 6).alias("text"))
        got = with_fid(wide, F.desc("k"))
        assert got.columns == [FID, "k", "v", "text"] and got.count() == 30_000
        rows = got.select(FID, "k", "v").orderBy(FID).collect()
        want = sorted(((i * 7919 % 30_011, i) for i in range(30_000)), reverse=True)
        assert [tuple(r) for r in rows] == [(n, k, v) for n, (k, v) in enumerate(want)]
        assert with_fid(wide.limit(0), "k").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bulk_push_builds_what_push_builds(spark):
    rows = [Triangle(id=i, a=Point(x=1.0 + i, y=2.0, z=3.0), b=Point(x=4.0, y=5.0 * i, z=6.0), c=Point()) for i in range(9)]
    one = Block.create(spark)
    for r in rows:
        one.push(r)
    one.fix()
    point = lambda p: None if p is None else (p.x, p.y, p.z)
    df = spark.createDataFrame([(r.id, point(r.a), point(r.b)) for r in rows], "id long, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>")
    many = Block.push_all(spark, Triangle, df, "id")
    for name in ("Triangle", "Point"):
        strip = lambda r: [tuple(x) if not isinstance(x, (int, float)) else x for x in r]
        a, b = ([strip(r) for r in block[name]] for block in (one, many))
        if name == "Triangle":  # the bulk block has no layer of names, so its layers count from 0
            a = [[*r[:2], *[(i - 1, f) for i, f in r[2:]]] for r in a]
        assert a == b
    with many as open_:
        assert len(open_) == 2
    assert len(many) == 0


def test_intermediate_tables_can_be_cleared(spark):
    kept = staging.stored(spark.range(5), "t")
    where = kept.inputFiles()[0]
    staging.clear()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_a_scope_removes_what_it_does_not_keep(spark):
    there = lambda where: (lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where))
    outer = staging.stored(spark.range(3), "t").inputFiles()[0]
    with staging.scope() as mine:
        inner = staging.stored(spark.range(5), "t")
        kept = mine.keep(inner.where("id > 1"), "t")
        where, last = inner.inputFiles()[0], kept.inputFiles()[0]
    assert there(outer) and not there(where) and kept.count() == 3
    mine.drop()
    assert not there(last)
    staging.clear()
    assert not there(outer)
