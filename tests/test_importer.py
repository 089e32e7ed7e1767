import pytest

from quillgrid.functions import textgeom as G
from quillgrid.sources import importer, shapefile


def test_grammar():
    out, sources = importer.parse("out.db # target\n# nothing\n[ESRI Shapefile]/a/b.shp!roads -l r tx16 st32 aabbox(auto)\n/c.shp cf64 aabbox(0,1,2,3)\n")
    assert out == "out.db" and sources[0] == importer.Source("/a/b.shp", "ESRI Shapefile", "roads", "r", "tx16", True, "auto")
    assert sources[1].name == "c" and sources[1].box == (0.0, 1.0, 2.0, 3.0)
    for bad in ("", "out\n/a what", "out\n/a aabbox(1,2)"):
        with pytest.raises(ValueError):
            importer.parse(bad)


def test_import_drops_rows_without_geometry_and_reports_bad_sources(spark, tmp_path):
    df = spark.createDataFrame([(G.as_struct(G.from_wkt("POINT(1 2)")), "a", 2**31 + 5), (None, "b", 1)], f"geom {G.GEOM}, name string, n long")
    for ext, raw in shapefile.shapefile_bytes(df).items():
        (tmp_path / f"p.{ext}").write_bytes(raw)
    (tmp_path / "t.csv").write_text('wkt;n\n"POINT(5 6)";1\n'.replace(";", ","))
    where, block, failed = importer.run(spark, f"{tmp_path}/o.db\n{tmp_path}/p.shp -l points\n[csv]{tmp_path}/t.csv -l t\n{tmp_path}/none.shp\n")
    assert where.endswith("o.db") and list(block.layers) == ["points", "t"] and len(failed) == 1
    row = block["points"][0]
    assert (row["name"], row["n"]) == ("a", 5 - 2**31) and G.of_struct(row["geom"].asDict(recursive=True)).coords == [1.0, 2.0]
    assert "scanned 1 rows" in importer.dump(block)


def test_import_stores_the_asked_coordinates(spark, tmp_path):
    from quillgrid.sources import container

    (tmp_path / "t.csv").write_text('wkt,n\n"LINESTRING Z(0 0 5, 4 8 5)",1\n"MULTILINESTRING((1 1, 2 2), (3 3, 4 4))",2\n')
    (tmp_path / "m.csv").write_text('wkt,n\n"POINT(5 6)",1\n"LINESTRING(0 0, 1 1)",2\n')
    where, block, failed = importer.run(spark, f"{tmp_path}/o.db\n[csv]{tmp_path}/t.csv -l t tx24 st32 aabbox(auto)\n[csv]{tmp_path}/m.csv -l mixed\n")
    assert list(block.layers) == ["t"] and "points, lines or polygons" in failed[f"{tmp_path}/m.csv"]
    container.save(block, where)
    h = container.headers((tmp_path / "o.db").read_bytes())[0]
    assert (h["geom"], h["coord"], h["aabbox"], h["extent"]) == (2, 4, True, [0.0, 0.0, 4.0, 8.0])
    got = [r["_geom"] for r in container.load(spark, where)["t"]]
    assert [g["kind"] for g in got] == ["LineString", "MultiLineString"] and got[0]["parts"][0]["points"][1]["y"] == 8.0
