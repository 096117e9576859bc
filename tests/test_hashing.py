import hashlib
import hmac
import struct

from pyspark.sql import functions as F

from conftest import make_blocks
from tesserae.functions import hashing as H
from tesserae.operators import seal
from tesserae.sources import keyring as K


def test_hmac_matches_python(spark, ring):
    key = K.subkey(K.test_key(2), K.LABEL_TAG)
    texts = ["", "a", "tag" * 50, "é" * 40]
    df = spark.createDataFrame([(2, t) for t in texts], "key_id int, t string")
    got = K.with_key(df, ring).select("t", H.hmac_hex(F.col("tag_in"), F.col("tag_out"), H.utf8(F.col("t"))).alias("h")).collect()
    for row in got:
        assert row["h"] == hmac.new(key, row["t"].encode(), hashlib.sha256).hexdigest()


def test_tag_message_layout(spark, ring):
    """The message bytes equal a big-endian struct plus length-prefixed owner, content and backup."""
    b = make_blocks(spark, 2, 3, lambda ch, i: [(37 * p + i) % 256 for p in range(64)], key_id=1)
    s = seal.seal(b, ring, "B").collect()
    key = K.subkey(K.test_key(1), K.LABEL_TAG)
    for row in s:
        oid = row["owner_id"].encode()
        msg = struct.pack(">4sHHHBBI", b"WGT2", row["height"], row["width"], 8, row["ch"], 2, row["idx"])
        msg += len(oid).to_bytes(2, "big") + oid + bytes(v & 252 for v in row["px"]) + bytes(row["carried"])
        assert row["tag"] == hmac.digest(key, msg, "sha256")[:4].hex()


def test_seed_and_run_id(spark):
    row = spark.range(1).select(
        H.derive_seed(F.lit("7"), F.lit("x"), F.lit("0.25")).alias("s"), H.run_id(F.lit("a"), F.lit(8)).alias("r")
    ).first()
    assert row["s"] == int(hashlib.sha256(b"7|x|0.25").hexdigest()[:15], 16)
    assert row["r"] == hashlib.sha256(b"a|8").hexdigest()[:16]


def test_keys_stay_out_of_plans(spark, ring, blocks):
    plan = seal.seal(blocks, ring, "B")._jdf.queryExecution().toString()
    for _, *pads in K.keyring_rows({i: K.test_key(i) for i in range(5)}):
        for pad in pads:
            assert pad.hex().upper() not in plan.upper()
