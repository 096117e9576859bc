"""Key material as a small table.

The table holds HMAC pads of label-separated subkeys, never the master keys, and
reaches the jobs by a join on ``key_id`` so that no key byte is a literal in a
query plan.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession, functions as F

# Subkey labels; data sealed elsewhere verifies when its own labels are passed instead.
LABEL_TAG = b"tesserae/v1/tag"
LABEL_MAP = b"tesserae/v1/map"

TEST_KEYS = 5
BROADCAST_KEYS = 32_768
SCHEMA = "key_id int, tag_in binary, tag_out binary, map_in binary, map_out binary"


def test_key(key_id: int) -> bytes:
    return b"tesserae-test-key-%02d" % key_id


def subkey(master: bytes | str, label: bytes) -> bytes:
    master = master.encode("utf-8") if isinstance(master, str) else master
    return hmac.digest(master, label, "sha256")


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The two 64-byte HMAC-SHA256 pads of a key."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def keyring_rows(keys: dict[int, bytes | str], labels: tuple[bytes, bytes] = (LABEL_TAG, LABEL_MAP)) -> list[tuple]:
    tag, place = labels
    return [(i, *pads(subkey(k, tag)), *pads(subkey(k, place))) for i, k in sorted(keys.items())]


def keyring(spark: SparkSession, keys: dict[int, bytes | str] | None = None,
            labels: tuple[bytes, bytes] = (LABEL_TAG, LABEL_MAP)) -> DataFrame:
    """The keyring as a table, hinted for broadcast while its known size allows it.

    A row has under 300 bytes, so BROADCAST_KEYS rows stay below 10 MB.  A larger ring is
    joined by key, where adaptive skew handling splits a key that many blocks share.
    """
    keys = keys or {i: test_key(i) for i in range(TEST_KEYS)}
    ring = spark.createDataFrame(keyring_rows(keys, labels), SCHEMA)
    return F.broadcast(ring) if len(keys) <= BROADCAST_KEYS else ring


def with_key(blocks: DataFrame, ring: DataFrame, known_only: bool = False) -> DataFrame:
    """Attach pads by key_id; nothing is shuffled when the ring is broadcast.

    Rows of an unknown or absent key keep their place and get null pads, so that checks can
    report them; ``known_only`` leaves them out, which sealing does.
    """
    return blocks.join(ring, "key_id", "inner" if known_only else "left")
