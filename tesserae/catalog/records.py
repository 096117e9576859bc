"""Queries that seal, verify and repair ordinary records and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, utf8
from ..operators import records as rec
from ..session import materialize
from ..sources import carriers
from ..sources.keyring import keyring
from ..sources.tables import table
from . import sqlkit as S
from .blocks import lineitem_sql
from .registry import query, r6, sql_r6
from .sqlkit import Sql


def orders_sql() -> Sql:
    fields = [
        "o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "round_even(o_totalprice * 100, 0)::BIGINT::VARCHAR",
        "epoch_us(o_orderdate)::VARCHAR", "o_orderpriority",
    ]
    content = f"encode({' || '.join(S.netstring(f) for f in fields)})"
    return Sql().keyring().add(
        "src",
        f"SELECT 'orders|' || strftime(o_orderdate, '%Y-%m') AS owner_id, month(o_orderdate) % 5 AS key_id, o_orderkey::VARCHAR AS rec_key, {content} AS content FROM orders",
    )


def events_sql() -> Sql:
    fields = ["event_id::VARCHAR", "epoch_us(ts)::VARCHAR", "user_id::VARCHAR", "event_type", "round_even(value * 100, 0)::BIGINT::VARCHAR", "props"]
    content = f"encode({' || '.join(S.netstring(f) for f in fields)})"
    return Sql().keyring().add(
        "src", f"SELECT 'user|' || user_id AS owner_id, user_id % 5 AS key_id, event_id::VARCHAR AS rec_key, {content} AS content FROM events"
    )


def text_sql() -> Sql:
    """Chunks of every text; texts of up to 128 bytes are single records of a shared owner."""
    return Sql().keyring().add("txt", "SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents").add(
        "src",
        "SELECT 'doc' || doc_id AS owner_id, doc_id % 5 AS key_id, i::VARCHAR AS rec_key, unhex(substr(h, (i * 128 + 1)::INT, 128)) AS content FROM "
        "(SELECT doc_id, h, unnest(range((n + 63) // 64)) AS i FROM txt WHERE n > 128) "
        "UNION ALL SELECT 'doc|short|' || doc_id % 5, doc_id % 5, doc_id::VARCHAR, unhex(h) FROM txt WHERE n <= 128",
    )


def leftovers_sql() -> Sql:
    """Vectors past the last whole grid row, as records of a shared owner."""
    return Sql().keyring().vectors("fa").add(
        "src",
        f"SELECT 'vec|rest|' || label % 5 AS owner_id, label % 5 AS key_id, vec_id::VARCHAR AS rec_key, {S.to_bytes('px')} AS content FROM fa_p WHERE idx >= inpage - inpage % 6",
    )


def sealed_records_sql(q: Sql) -> Sql:
    q.add("rk", f"SELECT *, {S.hmac('map', 'encode(' + S.netstring('owner_id') + ' || ' + S.netstring('rec_key') + ')')} AS h FROM src JOIN keyring USING (key_id)")
    w = "PARTITION BY owner_id ORDER BY h, rec_key"
    full = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    wrap = lambda fn, col, edge: f"coalesce({fn}({col}) OVER ({w}), {edge}_value({col}) OVER ({w} {full}))"
    q.add(
        "rp",
        f"SELECT *, {wrap('lead', 'rec_key', 'first')} AS holder, {wrap('lag', 'content', 'last')} AS backup, {wrap('lag', 'rec_key', 'last')} AS backup_of FROM rk",
    )
    return q.add("rs", f"SELECT owner_id, key_id, rec_key, content, holder, backup, backup_of, {tag_sql()} AS tag FROM rp WHERE holder <> backup_of")   # fewer than three records have no such cycle


def tag_sql() -> str:
    names = " || ".join(S.netstring(c) for c in ("owner_id", "rec_key", "holder", "backup_of"))
    size = lambda c: f"octet_length({c})::VARCHAR || ':'"
    message = f"encode('TSR1' || {names} || {size('content')}) || content || encode({size('backup')}) || backup"
    return f"substr({S.hmac('tag', message)}, 1, 32)"


def damaged_records_sql(q: Sql) -> Sql:
    """A tenth of the contents and, disjointly, a twentieth of the backups are altered."""
    sealed_records_sql(q)
    u = S.fraction("sha256(owner_id || '|' || rec_key)")
    q.add(
        "rd",
        f"SELECT owner_id, key_id, rec_key, CASE WHEN {u} < 0.1 THEN content || encode('!') ELSE content END AS content, holder, "
        f"CASE WHEN {u} >= 0.1 AND {u} < 0.15 THEN backup || encode('!') ELSE backup END AS backup, backup_of, tag FROM rs",
    )
    q.add("rc", f"SELECT d.*, tag <> {tag_sql()} AS flagged FROM rd d JOIN keyring USING (key_id)")
    return q.add(
        "rr",
        "SELECT c.owner_id, c.rec_key, c.flagged, CASE WHEN NOT c.flagged THEN 'AUTHENTIC' WHEN b.backup IS NULL THEN 'UNRECOVERABLE' ELSE 'RECOVERED' END AS status, "
        "CASE WHEN c.flagged THEN b.backup ELSE c.content END AS content FROM rc c LEFT JOIN (SELECT owner_id, backup_of AS rec_key, backup FROM rc WHERE NOT flagged) b USING (owner_id, rec_key)",
    )


def sealed(spark, records):
    ring = keyring(spark)
    return ring, rec.seal_records(records, ring)


def damaged(df):
    u = hash_fraction(F.sha2(utf8(F.concat_ws("|", "owner_id", "rec_key")), 256))
    mark = F.encode(F.lit("!"), "UTF-8")
    return df.withColumn("_u", u).withColumn(
        "content", F.when(F.col("_u") < 0.1, F.concat("content", mark)).otherwise(F.col("content"))
    ).withColumn(
        "backup", F.when((F.col("_u") >= 0.1) & (F.col("_u") < 0.15), F.concat("backup", mark)).otherwise(F.col("backup"))
    ).drop("_u")


def text_records(spark, d):
    chunks = carriers.text_chunks(spark, d).select("owner_id", "key_id", F.col("idx").cast("string").alias("rec_key"), "content")
    return chunks.unionByName(carriers.short_texts(spark, d))


@query("seal_records", sealed_records_sql(orders_sql()).select("SELECT owner_id, rec_key, holder, backup_of, tag FROM rs"))
def seal_records(spark, d):
    """Orders sealed by month: holder, carried backup and tag of each."""
    _, s = sealed(spark, carriers.order_records(spark, d))
    return s.select("owner_id", "rec_key", "holder", "backup_of", "tag")


LI = lineitem_sql()
LI.steps["src"] = LI.steps.pop("li")


@query("verify_records", damaged_records_sql(LI).select("SELECT owner_id, rec_key, flagged FROM rc"))
def verify_records(spark, d):
    """Line items sealed by ship month, damaged, verified."""
    ring, s = sealed(spark, carriers.lineitem_records(spark, d))
    return rec.check_records(damaged(s), ring).select("owner_id", "rec_key", "flagged")


@query("repair_records", damaged_records_sql(events_sql()).select("SELECT owner_id, rec_key, flagged, status, hex(content) AS content_hex FROM rr"))
def repair_records(spark, d):
    """Events sealed per user, damaged, repaired exactly from intact partners."""
    ring, s = sealed(spark, carriers.event_records(spark, d))
    out = rec.repair_records(materialize(rec.check_records(damaged(s), ring)))
    return out.select("owner_id", "rec_key", "flagged", "status", F.hex("content").alias("content_hex"))


@query(
    "records_recoverability",
    damaged_records_sql(text_sql()).select(
        f"SELECT owner_id, count(*)::BIGINT AS k, count_if(flagged)::BIGINT AS tampered, count_if(status = 'RECOVERED')::BIGINT AS recovered, count_if(status = 'UNRECOVERABLE')::BIGINT AS unrecoverable, "
        f"{sql_r6('CASE WHEN count_if(flagged) = 0 THEN 1.0 ELSE 1.0 - count_if(status = ' + repr('UNRECOVERABLE') + ') / count_if(flagged) END', 'rho')} FROM rr GROUP BY owner_id"
    ),
)
def records_recoverability(spark, d):
    """Whole texts in 64-byte chunks: what a tenth of damage leaves recoverable, per document."""
    ring, s = sealed(spark, text_records(spark, d))
    out = rec.record_summary(rec.repair_records(materialize(rec.check_records(damaged(s), ring))))
    return out.select("owner_id", "k", "tampered", "recovered", "unrecoverable", r6(F.col("rho"), "rho"))


@query("seal_leftovers", sealed_records_sql(leftovers_sql()).select("SELECT owner_id, rec_key, holder, backup_of, hex(content) AS content_hex, tag FROM rs"))
def seal_leftovers(spark, d):
    """Vectors that no whole grid row holds, sealed as records."""
    _, s = sealed(spark, carriers.vector_leftovers(spark, d))
    return s.select("owner_id", "rec_key", "holder", "backup_of", F.hex("content").alias("content_hex"), "tag")


@query(
    "coverage",
    "WITH v AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), l AS (SELECT label % 5 AS k, sum(n % 6) AS n FROM v GROUP BY 1), "
    "t AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), h AS (SELECT doc_id % 5 AS k, count(*) AS docs, sum(n) AS bytes FROM t WHERE n <= 128 GROUP BY 1) "
    "SELECT 'vectors' AS carrier, sum(n)::BIGINT AS input_rows, (sum(n) - (SELECT coalesce(sum(n), 0) FROM l WHERE n < 3))::BIGINT AS sealed_rows, (SELECT coalesce(sum(n), 0) FROM l WHERE n < 3)::BIGINT AS rejected_rows, "
    "(sum(n) * 64)::BIGINT AS input_bytes, (64 * (sum(n) - (SELECT coalesce(sum(n), 0) FROM l WHERE n < 3)))::BIGINT AS sealed_bytes FROM v "
    "UNION ALL SELECT 'texts', count(*)::BIGINT, (count(*) - (SELECT coalesce(sum(docs), 0) FROM h WHERE docs < 3))::BIGINT, (SELECT coalesce(sum(docs), 0) FROM h WHERE docs < 3)::BIGINT, "
    "sum(n)::BIGINT, (sum(n) - (SELECT coalesce(sum(bytes), 0) FROM h WHERE docs < 3))::BIGINT FROM t",
)
def coverage(spark, d):
    """Rows and bytes that come in, are sealed (in a grid or as records) and are rejected, for each carrier."""
    ring = keyring(spark)
    grid = carriers.vector_blocks(spark, d).select(F.lit("vectors").alias("carrier"), F.lit(1).alias("rows"), F.size("px").cast("bigint").alias("bytes"))
    loose = carriers.vector_leftovers(spark, d)
    texts = text_records(spark, d)
    sums = lambda df: df.groupBy("carrier").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    whole = lambda df, name: df.select(F.lit(name).alias("carrier"), F.lit(1).alias("rows"), F.octet_length("content").cast("bigint").alias("bytes"))
    first = F.when(F.col("owner_id").startswith("doc|") | (F.col("rec_key") == "0"), 1).otherwise(0)   # a text counts once, however many chunks it has
    cut = lambda df: df.select(F.lit("texts").alias("carrier"), first.alias("rows"), F.octet_length("content").cast("bigint").alias("bytes"))
    sealed_sums = sums(grid.unionByName(whole(rec.seal_records(loose, ring), "vectors")).unionByName(cut(rec.seal_records(texts, ring))))
    inputs = sums(
        table(spark, d, "embeddings").select(F.lit("vectors").alias("carrier"), F.lit(1).alias("rows"), F.size("embedding").cast("bigint").alias("bytes")).unionByName(
            table(spark, d, "documents").select(F.lit("texts").alias("carrier"), F.lit(1).alias("rows"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")))
    )
    small = lambda df, name: df.join(rec.validate_records(df).select("owner_id"), "owner_id", "left_semi").select(F.lit(name).alias("carrier"), F.lit(1).alias("rows"), F.lit(0).cast("bigint").alias("bytes"))
    rejected = sums(small(loose, "vectors").unionByName(small(texts, "texts")))
    return (
        inputs.join(sealed_sums.withColumnsRenamed({"rows": "s_rows", "bytes": "s_bytes"}), "carrier", "left")
        .join(rejected.withColumnRenamed("rows", "r_rows").drop("bytes"), "carrier", "left")
        .select("carrier", F.col("rows").alias("input_rows"), F.coalesce("s_rows", F.lit(0)).alias("sealed_rows"), F.coalesce("r_rows", F.lit(0)).alias("rejected_rows"),
                F.col("bytes").alias("input_bytes"), F.coalesce("s_bytes", F.lit(0)).alias("sealed_bytes"))
    )
