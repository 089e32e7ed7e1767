import pytest

from quillgrid.functions import blobgeom as B
from quillgrid.functions import textgeom as G

TEXTS = [
    "POINT(1 2)", "POINT Z(1 2 3)", "LINESTRING M(0 0 5, 1.5 2 6, 3 4 7, 9 9 8)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
    "MULTIPOINT(1 2, 3 4)", "MULTILINESTRING ZM((0 0 1 2, 1 1 1 2, 2 2 5 6), (5 5 5 5, 6 6 6 6))", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5)))",
    "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1))",
]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trips(text):
    g = G.from_wkt("SRID=4326;" + text)
    want = G.to_wkt(g)
    for small in (False, True):
        for little in (False, True):
            raw = B.to_blob(g, small, little)
            back = B.from_blob(raw)
            assert G.to_wkt(back) == want and back.srid == 4326
    assert B.blob_box(B.to_blob(g)) == B.blob_box(B.to_blob(g, True, False))
    assert G.to_wkt(B.from_fgf(B.to_fgf(g))) == want


def test_fixed_bytes():
    raw = B.to_blob(G.Geometry("Point", [1.0, 2.0], "XY", 4326))
    assert len(raw) == 60 and raw[:6].hex() == "0001e6100000" and raw[38] == 0x7C and raw[-1] == 0xFE and raw[39:43].hex() == "01000000"
    assert B.to_fgf(G.Geometry("Point", [1.0, 2.0])).hex()[:16] == "0100000000000000"
    line = G.from_wkt("LINESTRING(0 0, 0.1 0.2, 1 1)")
    assert len(B.to_blob(line, True)) == len(B.to_blob(line)) - 8 and B.from_blob(B.to_blob(line, True)).coords[1][0] == pytest.approx(0.1, abs=1e-6)


def test_what_is_neither():
    raw = B.to_blob(G.from_wkt(TEXTS[3]))
    for bad in (b"", raw[:-1], raw[:50] + raw[-1:], raw[:39] + b"\xff" * 4 + raw[43:], b"\x01" + raw[1:]):
        with pytest.raises(ValueError):
            B.from_blob(bad)
    for bad in (b"", b"\x09\0\0\0", B.to_fgf(G.from_wkt(TEXTS[3]))[:-1], B.to_fgf(G.from_wkt("POINT(1 2)")) + b"x"):
        with pytest.raises(ValueError):
            B.from_fgf(bad)
    with pytest.raises(ValueError):
        B.to_blob(G.from_wkt("POINT EMPTY"))


def test_kml():
    for text in [t for t in TEXTS if " M" not in t and "ZM" not in t]:
        g = G.from_wkt(text)
        assert G.to_wkt(B.from_kml(G.to_kml(g))) == G.to_wkt(g)
    assert B.from_kml('<Placemark xmlns="http://www.opengis.net/kml/2.2"><name>n</name><Point><coordinates> 1 , 2 , 3 </coordinates></Point></Placemark>').coords == [1.0, 2.0, 3.0]
    for bad in ("", "<Point/>", "<a><b/></a>", "<Point><coordinates>1</coordinates></Point>", "<!DOCTYPE x><Point><coordinates>1,2</coordinates></Point>", "<Polygon/>"):
        with pytest.raises(ValueError):
            B.from_kml(bad)


def test_columns(spark):
    df = spark.createDataFrame([("POINT(1 2)",), ("nonsense",), (None,)], "t string").select(G.st_from_wkt("t").alias("g"))
    got = df.select(G.st_as_wkt(B.st_from_blob(B.st_as_blob("g"))).alias("a"), G.st_as_wkt(B.st_from_fgf(B.st_as_fgf("g"))).alias("b"), G.st_as_wkt(B.st_from_hex_wkb(B.st_as_hex_wkb("g"))).alias("c")).collect()
    assert [tuple(r) for r in got] == [("POINT(1 2)",) * 3, (None,) * 3, (None,) * 3]
