"""The shared case most block queries look at: sealed vectors, a noise rectangle, verification."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import SparkSession, functions as F

from ..operators import inject, repair, seal, verify
from ..session import materialize
from ..sources import carriers
from ..sources.keyring import keyring
from .sqlkit import Sql


def case(spark: SparkSession, folder: str, variant: str = "B", channels: int = 1, ratio: str = "0.25") -> SimpleNamespace:
    ring = keyring(spark)
    blocks = carriers.vector_blocks(spark, folder, channels, ncols=6 if channels == 1 else 4)
    sealed = seal.seal(blocks, ring, variant)
    damaged = inject.inject_noise(seal.as_received(sealed), F.lit(ratio))
    # what arrived, checked; read by the mask, by the owners' state and through the holders
    checked = materialize(verify.check_tags(damaged, ring, variant))
    damaged = checked.drop("stored_tag", "stored_desc", "fresh_tag", "mismatch")
    mask = verify.localize(checked)
    return SimpleNamespace(
        ring=ring, blocks=blocks, sealed=sealed, damaged=damaged, checked=checked, mask=mask, variant=variant
    )


def state(c: SimpleNamespace):
    return verify.with_partner_state(c.checked, c.mask, c.ring)


def repaired(c: SimpleNamespace):
    return repair.repair(state(c), c.variant)


def case_sql(variant: str = "B", channels: int = 1, ratio: str = "0.25") -> Sql:
    return (
        Sql().keyring().vectors("fa", channels, 6 if channels == 1 else 4).seal("fa", "sealed", variant)
        .received("sealed", "rcv").region("rcv", "reg", "'noise'", f"'{ratio}'").noised("reg", "dmg")
        .check("dmg", "chk", variant).localize("chk", "mask")
    )


def state_sql(variant: str = "B", channels: int = 1, ratio: str = "0.25") -> Sql:
    return case_sql(variant, channels, ratio).state("chk", "mask", "sealed_map", "st")


def repaired_sql(variant: str = "B", channels: int = 1, ratio: str = "0.25") -> Sql:
    return state_sql(variant, channels, ratio).repaired("st", "rep", variant)
