import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from tesserae.llm import media


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def samples():
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")
    gif = b"GIF89a\1\0\1\0\x80\0\0" + b"\0\0\0\xff\xff\xff" + b"\x21\xf9\4\0\0\0\0\0" + b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0" + b"\x3b"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
    jpeg = b"\xff\xd8\xff\xe0\0\4JF" + b"\xff\xda\0\4\1\2" + b"\x11\xff\0\x22\xff\xd3\x33" + b"\xff\xd9"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "text " * 20)
    ogg = b"OggS\0\2" + b"\0" * 20 + b"\1\3abc" + b"OggS\0\4" + b"\0" * 20 + b"\1\2de"
    flac = b"fLaC" + b"\x80\0\0\x22" + b"\0" * 34 + b"frames"
    mp4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 12) + b"mdat" + b"abcd"
    pdf = b"%PDF-1.4\nobj\nstartxref\n9\n%%EOF\n"
    return {
        "image/png": png, "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/zip": held.getvalue(), "application/gzip": gzip.compress(b"x" * 300_000),
        "application/ogg": ogg, "audio/flac": flac, "video/mp4": mp4, "application/pdf": pdf, "audio/wav": media.wav(b"abc"),
        "image/webp": b"RIFF" + struct.pack("<I", 14) + b"WEBPVP8 " + struct.pack("<I", 2) + b"ab",
    }


def test_each_format_is_found_and_measured():
    for kind, content in samples().items():
        found = media.sniff(content, "image/png")
        assert found["type"] == kind and found["declared_ok"] == (kind == "image/png"), kind
        assert (found["whole"]["start"], found["whole"]["length"]) == (0, len(content)), kind
        broken = content[:-3] if kind != "audio/flac" else content[:20]
        assert media.parts(broken)[0] is None, kind


def test_embedded_parts_are_carved(spark):
    made = samples()
    holders = [k for k in made if k != "audio/flac"]   # its length is open
    rows = [(k, b"noise BM RIFF PK\3\4 GIF89a " + made[k] + b" tail", "x") for k in holders] + [("none", None, None), ("empty", b"", "y"), ("wav", media.wav(b"\x00" * 8 + made["image/png"] + made["image/gif"]), "AUDIO/WAV")]
    df = spark.createDataFrame(rows, "kind string, content binary, declared string").withColumn("media_type", F.lit("old")).withColumn("found", F.lit(1))
    got = media.inspect(df, "content", "declared")
    assert got.count() == len(rows)
    carved = {}
    for r in media.carve(got, "content").collect():
        carved.setdefault(r.kind, []).append((r.part["type"], bytes(r.part_bytes)))
    for kind in holders:
        assert carved[kind] == [(kind, made[kind])], kind
    assert carved["wav"] == [("image/png", made["image/png"]), ("image/gif", made["image/gif"])]
    types = {r.kind: (r.media_type, r.declared_ok) for r in got.collect()}
    assert types["wav"] == ("audio/wav", True) and types["none"] == types["empty"] == (media.UNKNOWN, False)
    assert media.inspect(df.limit(0), "content").count() == 0


def test_query_reads_back_what_it_stored(spark, tmp_path):
    from tesserae.llm.queries import op10_media

    texts = {1: None, 2: "", 3: "a" * 64, 4: "é" * 33, 5: "BM RIFF %PDF-1.4 PK\x03\x04", 6: "word " * 200_000, 7: "a" * 64}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op10_media(spark, str(tmp_path)).collect()}
    for k, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(media.wav(payload)) and r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
        assert r.feature.startswith("audio/wav;") and not r.declared_ok
    assert rows[3].feature == rows[7].feature
