"""Queries that account for every row: what is missing, added, unknown or untagged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, utf8
from ..functions.pixels import to_bytes
from ..operators import manifest as man, records as rec, repair, seal, verify
from ..session import materialize
from ..sources import carriers
from ..sources.keyring import keyring
from . import sqlkit as S
from .records import events_sql, sealed_records_sql, tag_sql
from .registry import big, query
from .sqlkit import Sql

U = S.fraction("sha256(owner_id || '|' || rec_key)")


def mac(*parts: str) -> str:
    message = " || ".join(S.netstring(p) for p in parts)
    return S.hmac("tag", f"encode({message})")


def number(digest: str, start: int) -> str:
    return f"('0x' || substr({digest}, {start}, {man.DIGITS}))::BIGINT::HUGEINT"


def digest(column: str) -> str:
    return f"sum({number(column, 1)})::VARCHAR || '|' || sum({number(column, man.DIGITS + 1)})::VARCHAR"


def seal_sql(mark: str, owner: str = "owner_id") -> str:
    return f"substr({mac(repr(mark), owner, 'key_id::VARCHAR', 'n::VARCHAR', 'digest')}, 1, {man.SEAL_DIGITS})"


def manifest_sql(q: Sql) -> Sql:
    sealed_records_sql(q)
    q.add("mo0", f"SELECT owner_id, key_id, count(*)::BIGINT AS n, {digest('m')} AS digest FROM "
          f"(SELECT owner_id, key_id, {mac(repr(man.MARK_ROW), 'owner_id', 'rec_key', 'tag')} AS m FROM rs JOIN keyring USING (key_id)) GROUP BY ALL")
    q.add("mo", f"SELECT owner_id, key_id, n, digest, {seal_sql(man.MARK_OWNER)} AS seal FROM mo0 JOIN keyring USING (key_id)")
    q.add("mk0", f"SELECT '' AS owner_id, key_id, count(*)::BIGINT AS n, {digest('m')} AS digest FROM "
          f"(SELECT key_id, {mac(repr(man.MARK_KEY), 'owner_id', 'seal')} AS m FROM mo JOIN keyring USING (key_id)) GROUP BY ALL")
    q.add("mk", f"SELECT owner_id, key_id, n, digest, {seal_sql(man.MARK_KEY)} AS seal FROM mk0 JOIN keyring USING (key_id)")
    return q.add("manifest", "SELECT 'owner' AS kind, * FROM mo UNION ALL SELECT 'key', * FROM mk")


def received_sql(q: Sql) -> Sql:
    """Altered, deleted, renamed keys, stripped tags, copies, forged records, and whole owners gone."""
    manifest_sql(q)
    cols = "holder, backup, backup_of"
    q.add("ru", f"SELECT *, {U} AS u FROM rs WHERE {S.fraction('sha256(owner_id)')} >= 0.05")
    q.add(
        "rx",
        f"SELECT owner_id, CASE WHEN u >= 0.08 AND u < 0.11 THEN 99 ELSE key_id END AS key_id, rec_key, CASE WHEN u < 0.05 THEN content || encode('!') ELSE content END AS content, {cols}, "
        f"CASE WHEN u >= 0.11 AND u < 0.14 THEN NULL ELSE tag END AS tag FROM ru WHERE u < 0.05 OR u >= 0.08 "
        f"UNION ALL SELECT owner_id, key_id, rec_key, content, {cols}, tag FROM ru WHERE u >= 0.14 AND u < 0.16 "
        f"UNION ALL SELECT owner_id, key_id, rec_key || 'x', content, {cols}, tag FROM ru WHERE u >= 0.16 AND u < 0.18",
    )
    reason = f"CASE WHEN tag_in IS NULL THEN 'unknown key' WHEN tag IS NULL THEN 'no tag' WHEN tag <> {tag_sql()} THEN 'tag differs' END"
    return q.add("rc", f"SELECT r.*, {reason} AS reason, {mac(repr(man.MARK_ROW), 'owner_id', 'rec_key', 'tag')} AS m FROM rx r LEFT JOIN keyring USING (key_id)")


def ledger_sql(q: Sql) -> Sql:
    """By set operations on keys, without the grouped mentions of the Spark plan."""
    received_sql(q)
    q.add("good", "SELECT *, sha256(content) AS v, sha256(backup) AS bv FROM rc WHERE reason IS NULL")
    q.add("own", "SELECT owner_id, rec_key, v, count(*) AS n, min(m) AS m FROM good GROUP BY ALL")
    q.add("held", "SELECT DISTINCT owner_id, backup_of AS rec_key, bv AS v FROM good")
    q.add("named", "SELECT owner_id, rec_key FROM good UNION SELECT owner_id, backup_of FROM good UNION SELECT owner_id, holder FROM good")
    q.add("versions", "SELECT owner_id, rec_key, count(*) AS versions FROM own GROUP BY ALL")
    q.add("anyheld", "SELECT DISTINCT owner_id, rec_key, TRUE AS any_held FROM held")
    q.add("agreed", "SELECT DISTINCT owner_id, rec_key, TRUE AS agreed FROM own JOIN held USING (owner_id, rec_key, v)")
    q.add(
        "ownst",
        "SELECT o.owner_id, o.rec_key, o.n, o.m, CASE WHEN h.v IS NOT NULL THEN 'AUTHENTIC' WHEN a.any_held IS NULL AND s.versions = 1 THEN 'AUTHENTIC' WHEN a.any_held IS NULL THEN 'UNCONFIRMED' "
        "WHEN g.agreed THEN 'ADDED' ELSE 'ALTERED' END AS st FROM own o LEFT JOIN held h USING (owner_id, rec_key, v) LEFT JOIN anyheld a USING (owner_id, rec_key) "
        "LEFT JOIN agreed g USING (owner_id, rec_key) JOIN versions s USING (owner_id, rec_key)",
    )
    q.add(
        "each",
        "SELECT owner_id, rec_key, 'AUTHENTIC' AS status, 1 AS n FROM ownst WHERE st = 'AUTHENTIC' UNION ALL SELECT owner_id, rec_key, 'ADDED', n - 1 FROM ownst WHERE st = 'AUTHENTIC' AND n > 1 "
        "UNION ALL SELECT owner_id, rec_key, st, n FROM ownst WHERE st <> 'AUTHENTIC' "
        "UNION ALL SELECT owner_id, rec_key, CASE reason WHEN 'unknown key' THEN 'UNKNOWN_KEY' WHEN 'no tag' THEN 'NO_TAG' ELSE CASE WHEN d.rec_key IS NOT NULL AND s.versions IS NULL THEN 'ALTERED' ELSE 'ADDED' END END, 1 "
        "FROM rc LEFT JOIN named d USING (owner_id, rec_key) LEFT JOIN versions s USING (owner_id, rec_key) WHERE reason IS NOT NULL "
        "UNION ALL SELECT owner_id, rec_key, 'DELETED', 1 FROM named ANTI JOIN rc USING (owner_id, rec_key)",
    )
    q.add(
        "recs",
        "SELECT owner_id, rec_key, status, sum(n)::BIGINT AS n, bool_or(coalesce(any_held, FALSE) AND status NOT IN ('AUTHENTIC', 'ADDED')) AS restorable FROM "
        "(SELECT e.owner_id, e.rec_key, e.n, any_held, CASE WHEN mo.owner_id IS NULL THEN 'ADDED' ELSE status END AS status FROM each e LEFT JOIN mo USING (owner_id) LEFT JOIN anyheld USING (owner_id, rec_key)) GROUP BY ALL",
    )
    q.add("found", f"SELECT owner_id, count(*) AS found, {digest('m')} AS got FROM ownst WHERE st = 'AUTHENTIC' GROUP BY owner_id")
    state = "CASE WHEN kind = 'key' THEN 'COMPLETE' WHEN coalesce(found, 0) < n THEN 'INCOMPLETE' WHEN got <> digest THEN 'MISMATCH' ELSE 'COMPLETE' END"
    return q.add(
        "ledger",
        "SELECT owner_id, rec_key, CASE status WHEN 'DELETED' THEN 'deleted' ELSE 'record' END AS kind, status, n, restorable FROM recs "
        f"UNION ALL SELECT CASE kind WHEN 'key' THEN 'key ' || key_id ELSE owner_id END, NULL, 'manifest', {state}, 1, FALSE FROM manifest LEFT JOIN found USING (owner_id)",
    )


def received(sealed):
    u = hash_fraction(F.sha2(utf8(F.concat_ws("|", "owner_id", "rec_key")), 256))
    rows = sealed.withColumn("_u", u).filter(hash_fraction(F.sha2(utf8(F.col("owner_id")), 256)) >= 0.05)
    between = lambda a, b: (F.col("_u") >= a) & (F.col("_u") < b)
    hit = rows.filter(~between(0.05, 0.08)).withColumns({
        "content": F.when(F.col("_u") < 0.05, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")),
        "key_id": F.when(between(0.08, 0.11), 99).otherwise(F.col("key_id")), "tag": F.when(~between(0.11, 0.14), F.col("tag")),
    })
    forged = rows.filter(between(0.16, 0.18)).withColumn("rec_key", F.concat("rec_key", F.lit("x")))
    return hit.unionByName(rows.filter(between(0.14, 0.16))).unionByName(forged).drop("_u")


def sealed_events(spark, d):
    ring = keyring(spark)
    return ring, materialize(rec.seal_records(carriers.event_records(spark, d), ring))


@query("record_manifest", manifest_sql(events_sql()).select(f"SELECT kind, owner_id, {big('key_id', 'n')}, digest, seal FROM manifest"))
def record_manifest(spark, d):
    """Count and keyed multiset digest of every user's sealed events, and of every key's users."""
    ring, s = sealed_events(spark, d)
    return man.record_manifest(s, ring)


@query("account_records", ledger_sql(events_sql()).select("SELECT * FROM ledger"))
def account_records(spark, d):
    """Every received, deleted and added event, and every manifest row, after seven kinds of damage."""
    ring, s = sealed_events(spark, d)
    return man.account_records(received(s), man.record_manifest(s, ring), ring)


@query("restore_records", ledger_sql(events_sql()).add(
    "hc", "SELECT owner_id, backup_of AS rec_key, max(backup) AS backup FROM good GROUP BY ALL",
).select(
    "SELECT owner_id, rec_key, 'AUTHENTIC' AS status, hex(content) AS content_hex FROM (SELECT owner_id, rec_key, any_value(content) AS content FROM good GROUP BY ALL) JOIN recs USING (owner_id, rec_key) WHERE status = 'AUTHENTIC' "
    "UNION ALL SELECT owner_id, rec_key, CASE WHEN backup IS NULL THEN 'UNRECOVERABLE' ELSE 'RECOVERED' END, hex(backup) FROM (SELECT DISTINCT owner_id, rec_key FROM recs WHERE status IN ('DELETED', 'ALTERED', 'UNKNOWN_KEY', 'NO_TAG', 'UNCONFIRMED')) "
    "LEFT JOIN hc USING (owner_id, rec_key)"
))
def restore_records(spark, d):
    """The sealed events again: authentic ones as received, deleted and damaged ones from their partners."""
    ring, s = sealed_events(spark, d)
    got = materialize(received(s))
    ledger = materialize(man.account_records(got, man.record_manifest(s, ring), ring))
    return man.restore_records(got, ledger, ring).select("owner_id", "rec_key", "status", F.hex("content").alias("content_hex"))


# -- blocks ------------------------------------------------------------------

UB = S.fraction("sha256(owner_id || '|' || idx)")


def incomplete_sql() -> Sql:
    """A tenth of the blocks gone, a few with another key, in two copies, or under an index past the grid."""
    q = Sql().keyring().vectors("fa").seal("fa", "sealed", "B").received("sealed", "rcv")
    q.add("gr", f"SELECT *, {UB} AS u FROM rcv")
    # a block that arrived verifies under the manifest's key and geometry, whatever its own fields say
    q.check("rcv", "chk0", "B")
    q.add("chk", f"SELECT c.* EXCLUDE (px, stored_desc, mismatch), CASE WHEN u >= 0.1 THEN c.px END AS px, CASE WHEN u >= 0.1 THEN stored_desc END AS stored_desc, "
          "u < 0.1 AS mismatch, CASE WHEN u < 0.1 THEN 0 WHEN u >= 0.15 AND u < 0.2 THEN 2 ELSE 1 END AS copies FROM chk0 c JOIN (SELECT owner_id, ch, idx, u FROM gr) USING (owner_id, ch, idx)")
    return q.localize("chk", "mask").state("chk", "mask", "sealed_map", "st")


def incomplete(spark, d):
    ring = keyring(spark)
    s = seal.seal(carriers.vector_blocks(spark, d), ring, "B")
    manifest = man.grid_manifest(s, ring)
    u = hash_fraction(F.sha2(utf8(F.concat_ws("|", "owner_id", F.col("idx").cast("string"))), 256))
    rows = seal.as_received(s).withColumn("_u", u)
    between = lambda a, b: (F.col("_u") >= a) & (F.col("_u") < b)
    got = rows.filter("_u >= 0.1").withColumns({
        "key_id": F.when(between(0.1, 0.15), 99).otherwise(F.col("key_id")), "k": F.when(between(0.2, 0.22), F.col("k") + 6).otherwise(F.col("k")),
    })
    stray = rows.filter(between(0.3, 0.35)).withColumn("idx", F.col("idx") + F.col("k"))
    return ring, materialize(got.unionByName(rows.filter(between(0.15, 0.2))).unionByName(stray).drop("_u")), manifest


@query("verify_complete", incomplete_sql().select(f"SELECT owner_id, {big('ch', 'idx', 'copies')}, mismatch, raw, flagged FROM st"))
def verify_complete(spark, d):
    """Every sealed cell is checked, absent ones included; altered keys and sizes of single rows move nothing."""
    ring, got, manifest = incomplete(spark, d)
    checked = materialize(man.complete_blocks(got, manifest, ring, "B"))
    mask = verify.localize(checked)
    return checked.join(mask.select("owner_id", "idx", "raw", "flagged"), ["owner_id", "idx"]).select("owner_id", "ch", "idx", "copies", "mismatch", "raw", "flagged")


@query(
    "repair_complete",
    incomplete_sql().repaired("st", "rep", "B").select(
        "SELECT owner_id, ch::BIGINT AS ch, idx::BIGINT AS idx, recoverable, unrecoverable, CASE WHEN unrecoverable THEN repeat('00', 64) ELSE hex(" + S.to_bytes("px_repaired") + ") END AS px_hex FROM rep"
    ),
)
def repair_complete(spark, d):
    """Absent blocks rebuilt from the partners that hold their backups."""
    ring, got, manifest = incomplete(spark, d)
    checked = materialize(man.complete_blocks(got, manifest, ring, "B"))
    rep = repair.repair(verify.with_partner_state(checked, verify.localize(checked), ring), "B")
    return rep.select("owner_id", "ch", "idx", "recoverable", "unrecoverable", F.hex(to_bytes(F.col("px_repaired"))).alias("px_hex"))


@query("stray_blocks", Sql().keyring().vectors("fa").select(f"SELECT owner_id, ch::BIGINT AS ch, (idx + k)::BIGINT AS idx FROM (SELECT *, {UB} AS u FROM fa) WHERE u >= 0.3 AND u < 0.35"))
def stray_blocks(spark, d):
    """Received blocks that belong to no sealed cell."""
    _, got, manifest = incomplete(spark, d)
    return man.stray_blocks(got, manifest).select("owner_id", "ch", "idx")
