"""Queries over the archive, manifests and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import content_hash, utf8
from ..operators import inject, library as lib, score, seal
from ..operators.index import write_index
from ..operators.store import Library
from ..session import broadcast_if_small, materialize, scratch
from ..sources import carriers, files
from ..sources.keyring import keyring
from ..sources.tables import table
from . import sqlkit as S
from .registry import big, query, r6, sql_r6
from .scores import sql_scores
from .sqlkit import Sql


def _documents(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"),
        F.col("doc_id").alias("created_at"), content_hash(utf8(F.col("text"))).alias("sha256"),
    )


def _library(spark, d):
    docs = _documents(spark, d)
    return lib.upsert(docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1"))


UPSERT = (
    "SELECT sha256(text) AS sha256, min(doc_id) AS id, arg_max(source || '/' || doc_id, doc_id) AS name, max(doc_id) AS created_at, "
    "count(*)::BIGINT AS arrivals FROM documents GROUP BY sha256(text)"
)


@query("library_upsert", UPSERT)
def library_upsert(spark, d):
    """Documents upserted by content hash."""
    return _library(spark, d)


@query("library_list", f"SELECT * FROM ({UPSERT}) WHERE id % 10 <> 3")
def library_list(spark, d):
    """Listing, newest first, after deleting some ids."""
    known = _library(spark, d)
    gone = known.filter("id % 10 = 3").select("id")
    return lib.listing(lib.delete(known, gone))


@query("library_store", f"SELECT * FROM ({UPSERT}) WHERE id % 10 <> 3")
def library_store(spark, d):
    """The stored library after two upserts and a delete, each a version of the partitions it touches."""
    docs = _documents(spark, d)
    kept = Library(spark, scratch(spark))
    kept.upsert(docs.filter("id % 2 = 0"))
    kept.upsert(docs.filter("id % 2 = 1"))
    kept.delete(kept.read().filter("id % 10 = 3"))
    return kept.read()


@query(
    "byte_identical",
    f"SELECT d.doc_id, u.id AS record_id, u.id IS NOT NULL AS byte_identical FROM (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents) d "
    f"LEFT JOIN ({UPSERT}) u USING (sha256)",
)
def byte_identical(spark, d):
    """Received documents, some altered, looked up by content hash."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    received = table(spark, d, "documents").select("doc_id", content_hash(utf8(text)).alias("sha256"))
    return lib.by_hash(received, _library(spark, d)).select("doc_id", "record_id", "byte_identical")


# -- identification ----------------------------------------------------------

def _archive(spark, d):
    """Two records per owner, under two keys; the received sets are damaged and intact copies."""
    ring = keyring(spark)
    blocks = carriers.vector_blocks(spark, d, 3, 4)
    record = lambda second: (F.col("label") * 100_000 + F.col("page")) * 2 + second
    first = seal.seal(blocks, ring, "B").withColumn("record_id", record(0).cast("bigint"))
    other = blocks.withColumn("key_id", ((F.col("key_id") + 1) % 5).cast("int"))
    second = seal.seal(other, ring, "B").withColumn("record_id", record(1).cast("bigint"))
    # an archive exists before anything is looked up in it
    archive = materialize(first.unionByName(second))
    first, second = archive.filter("record_id % 2 = 0"), archive.filter("record_id % 2 = 1")
    records = archive.filter((F.col("idx") == 0) & (F.col("ch") == 0)).select(
        "record_id", "owner_id", "key_id", "height", "width", F.col("k").alias("n_blocks"), F.lit(3).alias("n_channels")
    )
    damaged = inject.inject_noise(seal.as_received(first).drop("record_id"), F.lit("0.25"))
    copies = damaged.withColumn("query_id", F.concat(F.lit("damaged|"), "stem"))
    intact = seal.as_received(second).drop("record_id").withColumn("query_id", F.concat(F.lit("intact|"), "stem"))
    cols = ["query_id", "height", "width", "block", "k", "ncols", "ch", "idx", "r", "c", "px"]
    received = materialize(copies.select(*cols).unionByName(intact.select(*cols)))
    return ring, archive.withColumnRenamed("px_sealed", "px_stored"), records, received


def _archive_sql() -> Sql:
    q = Sql().keyring().vectors("fa", 3, 4).add("fb", "SELECT * REPLACE ((key_id + 1) % 5 AS key_id) FROM fa")
    q.seal("fa", "s1", "B").seal("fb", "s2", "B").received("s1", "r1").region("r1", "g", "'noise'", "'0.25'").noised("g", "dmg").received("s2", "r2")
    cols = "height, width, block, k, ncols, ch, idx, r, c, px"
    q.add("recv", f"SELECT 'damaged|' || stem AS query_id, {cols} FROM dmg UNION ALL SELECT 'intact|' || stem, {cols} FROM r2")
    rid = "(label * 100000 + page) * 2"
    q.add("arch", f"SELECT {rid} AS record_id, owner_id, key_id, height, width, k, ch, idx, px_sealed FROM s1 UNION ALL SELECT {rid} + 1, owner_id, key_id, height, width, k, ch, idx, px_sealed FROM s2")
    q.add("recs", "SELECT record_id, owner_id, key_id, height, width FROM arch WHERE idx = 0 AND ch = 0")
    # every candidate of the same shape against every block
    q.add("allp", "SELECT r.*, c.record_id, c.owner_id, c.key_id FROM recv r JOIN recs c USING (height, width)")
    q.check("allp", "allc", "B")
    q.add("perb", "SELECT query_id, record_id, idx, bool_or(mismatch) AS raw FROM allc GROUP BY ALL")
    q.add("cnt", "SELECT query_id, record_id, count_if(NOT raw) AS verifying, row_number() OVER (PARTITION BY query_id ORDER BY count_if(NOT raw) DESC, record_id DESC) AS rn FROM perb GROUP BY query_id, record_id")
    return q.add(
        "ident",
        "SELECT query_id, count(*)::BIGINT AS n_candidates, max(CASE WHEN rn = 1 THEN verifying END)::BIGINT AS verifying, max(CASE WHEN rn = 2 THEN verifying END)::BIGINT AS runner_up, "
        "max(CASE WHEN rn = 1 AND verifying >= 8 THEN record_id END)::BIGINT AS record_id FROM cnt GROUP BY query_id",
    )


@query("identify", _archive_sql().select("SELECT * FROM ident"))
def identify(spark, d):
    """Which record each received set is, by the stored index; the oracle tries every record of the shape."""
    ring, archive, records, received = _archive(spark, d)
    return lib.identify(received, None, records, ring, "B", index=write_index(archive, records, scratch(spark), 8))


@query(
    "verify_library",
    _archive_sql().add("mine", "SELECT r.*, i.record_id, c.owner_id, c.key_id FROM recv r JOIN ident i USING (query_id) JOIN recs c USING (record_id)")
    .check("mine", "mchk", "B").localize("mchk", "mmask", extra="query_id, ").add(
        "cmp",
        "SELECT query_id, record_id, idx, count(DISTINCT p) FILTER (WHERE a <> b) AS changed FROM (SELECT m.query_id, m.record_id, m.idx, unnest(range(64)) AS p, unnest(m.px) AS a, unnest(s.px_sealed) AS b "
        "FROM mine m JOIN arch s USING (record_id, ch, idx)) GROUP BY ALL",
    ).add(
        "vl",
        "SELECT query_id, record_id::BIGINT AS record_id, count(*)::BIGINT AS total_blocks, count_if(flagged)::BIGINT AS flagged_blocks, sum(changed)::BIGINT AS changed_px, "
        "count_if(flagged AND changed > 0)::BIGINT AS x_tp, count_if(flagged AND changed = 0)::BIGINT AS x_fp, count_if(NOT flagged AND changed > 0)::BIGINT AS x_fn, "
        "count_if(NOT flagged AND changed = 0)::BIGINT AS x_tn FROM cmp JOIN (SELECT query_id, idx, flagged FROM mmask) USING (query_id, idx) GROUP BY ALL",
    ).select(
        f"SELECT query_id, record_id, total_blocks, flagged_blocks, changed_px, changed_px = 0 AS byte_identical, CASE WHEN flagged_blocks > 0 THEN 'TAMPERED' ELSE 'AUTHENTIC' END AS verdict, "
        f"{sql_scores('', 'x')} FROM vl"
    ),
)
def verify_library(spark, d):
    """Identify, localize, compare with the stored copy, and give a verdict."""
    ring, archive, records, received = _archive(spark, d)
    matches = lib.identify(received, archive, records, ring, "B")
    v = lib.verify_against_library(received, archive, records, matches, ring, "B")
    scores = v.select("*", *score.loc_scores())
    return scores.select(
        "query_id", "record_id", "total_blocks", "flagged_blocks", "changed_px", "byte_identical", "verdict",
        *[r6(F.col(c), c) for c in ("precision", "recall", "f1", "iou", "fpr")],
    )


# -- manifests and files -----------------------------------------------------

def _manifest(spark, d):
    """Documents as a pinned manifest; one dataset of three is a placeholder."""
    t = table(spark, d, "documents")
    return t.select(
        F.when(F.col("doc_id") % 19 == 0, "synthetic").otherwise(F.col("source")).alias("dataset"),
        F.concat("doc_id", F.lit("."), "lang", F.lit(".txt")).alias("filename"),
        F.concat("source", F.lit("/"), "doc_id").alias("relpath"),
        (F.octet_length(utf8(F.col("text"))) % 640).cast("bigint").alias("width"),
        F.floor(F.octet_length(utf8(F.col("text"))) / 640).cast("bigint").alias("height"),
        content_hash(utf8(F.col("text"))).alias("sha256"), "doc_id",
    )


MANIFEST_SQL = (
    "SELECT CASE WHEN doc_id % 19 = 0 THEN 'synthetic' ELSE source END AS dataset, doc_id || '.' || lang || '.txt' AS filename, source || '/' || doc_id AS relpath, "
    "(octet_length(encode(text)) % 640)::BIGINT AS width, (octet_length(encode(text)) // 640)::BIGINT AS height, sha256(text) AS sha256, doc_id, text FROM documents"
)


@query(
    "scan_manifest",
    f"SELECT dataset, split_part(filename, '.', 1) AS stem, height, width, count(*) OVER (PARTITION BY dataset)::BIGINT AS n_dataset FROM ({MANIFEST_SQL}) WHERE dataset <> 'synthetic'",
)
def scan_manifest(spark, d):
    """Real datasets only, with stem, shape and the size of each dataset."""
    m = _manifest(spark, d).filter("dataset <> 'synthetic'")
    sizes = m.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_dataset"))
    return m.join(broadcast_if_small(sizes), "dataset").select("dataset", F.substring_index("filename", ".", 1).alias("stem"), "height", "width", "n_dataset")


FILES_SQL = (
    f"SELECT relpath, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS now FROM ({MANIFEST_SQL}) WHERE doc_id % 11 <> 0"
)


@query(
    "manifest_verify",
    f"""WITH p AS (SELECT relpath, dataset, sha256 FROM ({MANIFEST_SQL}) WHERE doc_id % 17 <> 0), f AS ({FILES_SQL}),
        s AS (SELECT coalesce(p.relpath, f.relpath) AS relpath, p.dataset, CASE WHEN p.sha256 IS NULL THEN 'EXTRA' WHEN f.now IS NULL THEN 'MISSING' WHEN f.now <> p.sha256 THEN 'HASH MISMATCH' ELSE 'OK' END AS status
              FROM p FULL JOIN f USING (relpath))
        SELECT coalesce(dataset, '-') AS dataset, status, count(*)::BIGINT AS n, min(relpath) AS first_path FROM s GROUP BY ALL""",
)
def manifest_verify(spark, d):
    """Pinned hashes against the files that are there, counted per dataset and outcome."""
    m = _manifest(spark, d)
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    there = table(spark, d, "documents").filter("doc_id % 11 <> 0").select(
        F.concat("source", F.lit("/"), "doc_id").alias("relpath"), content_hash(utf8(text)).alias("sha256")
    )
    out = files.verify_manifest(m.filter("doc_id % 17 <> 0"), there)
    return out.groupBy(F.coalesce("dataset", F.lit("-")).alias("dataset"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("relpath").alias("first_path")
    )


@query(
    "manifest_merge",
    f"""WITH m AS ({MANIFEST_SQL}), e AS (SELECT relpath, dataset, filename, sha256 FROM m WHERE doc_id % 3 <> 1),
        p AS (SELECT relpath, dataset, filename, sha256(text || '!') AS sha256 FROM m WHERE doc_id % 3 <> 0)
        SELECT *, (CASE dataset WHEN 'web' THEN 0 WHEN 'wiki' THEN 1 ELSE 99 END)::BIGINT AS dataset_rank FROM (SELECT * FROM p UNION ALL SELECT * FROM e WHERE relpath NOT IN (SELECT relpath FROM p))""",
)
def manifest_merge(spark, d):
    """Processed rows replace those of the same path; others stay."""
    t = _manifest(spark, d)
    texts = table(spark, d, "documents").select("doc_id", content_hash(utf8(F.concat("text", F.lit("!")))).alias("new_sha"))
    cols = ["relpath", "dataset", "filename", "sha256"]
    done = t.filter("doc_id % 3 <> 0").join(texts, "doc_id").select("relpath", "dataset", "filename", F.col("new_sha").alias("sha256"))
    return files.merge_manifest(t.filter("doc_id % 3 <> 1").select(*cols), done, ["web", "wiki"]).orderBy("dataset_rank", "filename")


# Sample heads for the census, by remainder of the document number.
HEADS = (
    "89504E470D0A1A0A", "FFD8FFE0", "424D", "49492A00", "4D4D002A", "524946460000000057454250", "474946383761", "474946383961",
    "25504446", "",
)


def _census_sql() -> str:
    heads = ", ".join(f"'{h}'" for h in HEADS)
    content = f"upper(substr([{heads}][(doc_id % 10 + 1)::INT] || hex(encode(text)), 1, 32))"
    cases = []
    for fmt, marks in files.MAGIC:
        cond = " AND ".join(f"substr(h, {2 * at + 1}, {len(t)}) = '{t}'" for at, t in marks)
        cases.append(f"WHEN {cond} THEN '{fmt}'")
    return (
        f"SELECT fmt, fmt IN ('jpeg', 'webp', 'gif') AS rejected, count(*)::BIGINT AS n_files, sum(size)::BIGINT AS bytes, count_if(size > 20000)::BIGINT AS oversized FROM "
        f"(SELECT size, CASE {' '.join(cases)} ELSE 'unknown' END AS fmt FROM (SELECT {content} AS h, octet_length(encode(text)) + len([{heads}][(doc_id % 10 + 1)::INT]) // 2 AS size FROM documents)) GROUP BY ALL"
    )


@query("format_census", _census_sql())
def format_census(spark, d):
    """Formats by leading bytes, lossy ones rejected before decoding, oversized ones counted."""
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % 10 + 1).cast("int"))
    t = table(spark, d, "documents").select(F.concat(F.unhex(head), utf8(F.col("text"))).alias("content"))
    return files.with_format(t).withColumn("size", F.octet_length("content").cast("bigint")).groupBy("fmt", "rejected").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.count_if(F.col("size") > 20000).alias("oversized")
    )
