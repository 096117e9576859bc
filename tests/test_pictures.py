"""Pictures straight from bytes: layouts, rejects, sealing from files and back, and the validator before it."""

import struct

import pytest
from pyspark.sql import functions as F

from conftest import make_blocks
from tesserae.operators import seal, validate, verify
from tesserae.session import materialize
from tesserae.sources import files, pictures


def bmp(width, height, pixel, bits=24, upward=True, compression=0):
    rows = []
    for y in range(height):
        row = b"".join(bytes(reversed(pixel(y, x))) if bits == 24 else bytes([pixel(y, x)[0]]) for x in range(width))
        rows.append(row + b"\0" * (-len(row) % 4))
    body = b"".join(reversed(rows) if upward else rows)
    start = 54 + (1024 if bits == 8 else 0)
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", start + len(body), 0, start, 40, width, height if upward else -height, 1, bits, compression, len(body), 0, 0, 0, 0)
    return head + b"\7" * (start - 54) + body


def pixel(y, x):
    return ((y * 31 + x * 7) % 256, (y * 3 + x * 11 + 5) % 256, (y * x + 9) % 256)


def test_every_layout(spark, tmp_path):
    grey = bytes(pixel(y, x)[0] for y in range(17) for x in range(26))
    colour = bytes(v for y in range(17) for x in range(26) for v in pixel(y, x))
    made = {
        "up.bmp": bmp(26, 17, pixel), "down.bmp": bmp(26, 17, pixel, upward=False), "grey.bmp": bmp(26, 17, pixel, bits=8),
        "a.pgm": b"P5\n# a note\n26 17\n255\n" + grey, "b.ppm": b"P6 26 17 255 " + colour,
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    table = files.binary_files(spark, str(tmp_path))
    assert pictures.picture_rejects(table).count() == 0
    for side in (8, 4):
        got = {}
        for r in pictures.picture_blocks(table, stem=F.element_at(F.split("path", "/"), -1), block=side).collect():
            assert (r.height, r.width, r.k, r.ncols) == (17 // side * side, 26 // side * side, (17 // side) * (26 // side), 26 // side)
            assert (r.r, r.c) == divmod(r.idx, r.ncols) and r.owner_id == f"{r.stem}|{r.height}x{r.width}|{side}"
            got[r.stem, r.ch, r.idx] = list(r.px)
        for (stem, ch, idx), px in got.items():
            r, c = divmod(idx, 26 // side)
            assert px == [pixel(r * side + p // side, c * side + p % side)[ch] for p in range(side * side)], (stem, ch, idx)
        per = {name: 3 if name in ("up.bmp", "down.bmp", "b.ppm") else 1 for name in made}
        assert len(got) == sum(per.values()) * (17 // side) * (26 // side)


def test_rejects(spark):
    rows = {
        "x.png": b"\x89PNG\r\n" + b"0" * 90, "null": None, "empty": b"", "short.bmp": bmp(16, 16, pixel)[:-1], "rle.bmp": bmp(16, 16, pixel, compression=1), "deep.pgm": b"P5 16 16 65535 " + b"0" * 600,
        "tiny.bmp": bmp(7, 30, pixel), "none.ppm": b"P6 0 5 255 ", "huge.ppm": b"P6 99999 99999 255 " + b"0" * 50, "text.ppm": b"P6 sixteen", "cut.bmp": b"BM", "good.bmp": bmp(8, 8, pixel),
    }
    df = spark.createDataFrame(list(rows.items()), "path string, content binary")
    got = {r.path: r.reason for r in pictures.picture_rejects(df).collect()}
    assert got == {
        "x.png": "format", "null": "format", "empty": "format", "short.bmp": "cut short", "rle.bmp": "depth or compression", "deep.pgm": "depth or compression", "tiny.bmp": "smaller than a block",
        "none.ppm": "size", "huge.ppm": "more than 40000000 pixels", "text.ppm": "format", "cut.bmp": "format",
    }
    assert {r.stem for r in pictures.picture_blocks(df).collect()} == {"good.bmp"} and pictures.picture_blocks(df.limit(0)).count() == 0


def test_sealed_pictures_verify_from_their_files(spark, ring, tmp_path):
    (tmp_path / "in.bmp").write_bytes(bmp(50, 43, pixel))
    source = pictures.picture_blocks(files.binary_files(spark, str(tmp_path)), stem=F.lit("in"))
    s = materialize(seal.seal(source, ring, "A", strict=True))
    (tmp_path / "out").mkdir()
    for r in pictures.to_pictures(s, "px_sealed").collect():
        (tmp_path / "out" / "sealed.bmp").write_bytes(r.content)
    back = pictures.picture_blocks(files.binary_files(spark, str(tmp_path / "out")), stem=F.lit("in"))
    checked = verify.check_tags(back, ring, "A")
    assert checked.count() == s.count() == 3 * 30 and checked.filter("mismatch").count() == 0
    assert pictures.to_pictures(s.filter("idx <> 3"), "px_sealed").count() == 0


def test_grey_owners_become_equal_colours(spark):
    b = make_blocks(spark, 2, 3, lambda ch, i: [(i * 40 + p) % 256 for p in range(64)])
    again = pictures.picture_blocks(pictures.to_pictures(b).withColumnRenamed("owner_id", "path"), stem=F.lit("img"))
    want = {r.idx: list(r.px) for r in b.collect()}
    assert {(r.ch, r.idx): list(r.px) for r in again.collect()} == {(ch, i): px for i, px in want.items() for ch in range(3)}


def test_validator(spark, ring):
    def reasons(df, variant="B", rule=ring):
        return {r.owner_id: (r.reason, r.n) for r in validate.validate_blocks(df, variant, rule).collect()}

    b = materialize(make_blocks(spark, 3, 4, lambda ch, i: [i] * 64, channels=3))
    name = b.first().owner_id
    one = F.col("idx") == 5
    assert reasons(b) == {} and reasons(b.limit(0)) == {}
    assert reasons(b.filter("ch < 2")) == {name: ("channels", 24)}
    assert reasons(make_blocks(spark, 1, 2, lambda ch, i: [i] * 64)) != {} and list(reasons(make_blocks(spark, 1, 2, lambda ch, i: [i] * 64)).values()) == [("too_small", 2)]
    four = make_blocks(spark, 2, 2, lambda ch, i: [i] * 16, block=4)
    assert list(reasons(four, "C").values()) == [("variant", 4)] and reasons(four, "A") == {}
    assert reasons(b.filter(~one)) == {name: ("missing", 3)}
    assert reasons(b.unionByName(b.filter(one & (F.col("ch") == 1)))) == {name: ("repeated", 1)}
    assert reasons(b.withColumn("px", F.when(one, F.array_append(F.slice("px", 1, 63), F.lit(256))).otherwise(F.col("px")))) == {name: ("samples", 3)}
    assert reasons(b.withColumn("px", F.when(~one, F.col("px")))) == {name: ("samples", 3)}
    assert reasons(b.withColumn("width", F.when(one, 40).otherwise(F.col("width")))) == {name: ("geometry", 3)}
    assert reasons(b.withColumn("key_id", F.when(one, 77).otherwise(F.col("key_id")))) == {name: ("key", 3)}
    with pytest.raises(ValueError, match="missing"):
        seal.seal(b.filter(~one), ring, "B", strict=True)
