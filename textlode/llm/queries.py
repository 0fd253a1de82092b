"""Queries of the training-data operators, by name, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm import canonical, encoding, mixing, neardup, neighbours, packing, readability, scans, splitting, tokens
from textlode.functions.text import strip
from textlode.session import stage, table


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 most similar chunks of its collection for every usable chunk."""
    return neighbours.top_similar(table(spark, sf_dir, "langchain_pg_embedding"), "uuid", "collection_id", "embedding")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's neighbours."""
    near = p1_neighbours(spark, sf_dir)
    return near.select(F.least("id", "neighbour").alias("uuid_a"), F.greatest("id", "neighbour").alias("uuid_b")).distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled chunks: the chain they went through and their text put right."""
    return encoding.garbled(table(spark, sf_dir, "langchain_pg_embedding"), "uuid", "document")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled chunks."""
    return p3_restored(spark, sf_dir).select("uuid")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of records and of digests that differ in formatting only."""
    records = canonical.same_but_for_formatting(table(spark, sf_dir, "document_model"), "record_id", "page_content")
    digests = canonical.same_digest(table(spark, sf_dir, "atlas_mongo_vector"), "row_seq", "digest")

    def copies(df: DataFrame, tab: str, row_id: str) -> DataFrame:
        return df.where(F.col(row_id) != F.col("kept")).select(F.lit(tab).alias("tab"), F.col("kept").alias("kept_id"), F.col(row_id).alias("copy_id"))

    return copies(records, "document_model", "record_id").union(copies(digests, "atlas_mongo_vector", "row_seq"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group of equals, with the number of its copies."""
    records = canonical.same_but_for_formatting(table(spark, sf_dir, "document_model"), "record_id", "page_content")
    digests = canonical.same_digest(table(spark, sf_dir, "atlas_mongo_vector"), "row_seq", "digest")
    return (
        records.where("record_id = kept").select(F.lit("document_model").alias("tab"), "kept", "copies")
        .union(digests.where("row_seq = kept").select(F.lit("atlas_mongo_vector"), "kept", "copies"))
    )


def p4_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that differ in formatting only: the kept row and the number of copies."""
    digests = canonical.same_digest(table(spark, sf_dir, "atlas_mongo_vector"), "row_seq", "digest")
    return digests.where("row_seq = kept").select("kept", "copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that had to be split."""
    return p5_pieces(spark, sf_dir).where("n_pieces > 1 AND piece_no = 0").select("record_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all records."""
    return splitting.split_oversized(table(spark, sf_dir, "document_model"), "record_id", "page_content")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the kinds of scan traces on them."""
    return scans.traces(table(spark, sf_dir, "document_model"), "record_id", "page_content", "metadata")


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paged files as continuous paragraphs without the traces."""
    return scans.repaired(table(spark, sf_dir, "document_model"), "record_id", "page_content", "metadata")


#: How TESTDATA.md defines a link between chunks.
CHUNK_LINK = {"threshold": 0.6, "words": 3, "least_words": 12}


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every chunk that is linked to another."""
    groups = neardup.near_duplicates(table(spark, sf_dir, "langchain_pg_embedding"), "uuid", "document", **CHUNK_LINK)
    least = groups.groupBy("component").agg(F.min("uuid").alias("group_id"), F.count(F.lit(1)).alias("n_rows"))
    return groups.join(least, "component").select("uuid", "group_id", "n_rows")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of chunks within a group."""
    groups = neardup.near_duplicates(table(spark, sf_dir, "langchain_pg_embedding"), "uuid", "document", **CHUNK_LINK)
    return neardup.pairs_of(stage(groups), "uuid")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", extra=("source",)))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the containers of each size."""
    kinds = table(spark, sf_dir, "container_size").where("container_name IS NOT NULL AND capacity_tokens > 0")
    capacities = {r["container_name"]: r["capacity_tokens"] for r in kinds.collect()}
    return packing.pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", capacities)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each size are."""
    placed = p8_containers(spark, sf_dir).groupBy("container_name", "container_no").agg(F.sum("n_tokens").alias("n_tokens"))
    kinds = table(spark, sf_dir, "container_size").select("container_name", "capacity_tokens")
    return placed.join(kinds, "container_name").groupBy("container_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("fullest"),
        (F.sum("n_tokens") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("share_filled"),
    )


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_target"), "doc_id", "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_target")
    return mixing.shares(mixing.mix(sizes, targets, "doc_id", "source"), sizes, targets, "source")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label")
    return readability.reading_levels(documents, labels, "doc_id", "text", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words of prose by level (null: no prose)."""
    return p10_levels(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("n_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demanding documents: level 4 or 5."""
    return p10_levels(spark, sf_dir).where("level >= 4").select("doc_id")


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every record: its pieces are within the limit, share no more than they may, and together are the whole text."""
    rows = table(spark, sf_dir, "document_model").select("record_id", strip(F.col("page_content")).alias("whole"))
    parts = p5_pieces(spark, sf_dir).join(rows, "record_id")
    same = F.expr("substring(whole, start + 1, `end` - start) = piece")
    # the text between the pieces is white space: nothing black is left out, and none is in two cores
    black = lambda c: F.length(F.regexp_replace(c, r"[\s\p{Z}\x0B\x1C-\x1F\x85]+", ""))
    cores = F.sum(black(F.expr("substring(whole, core + 1, `end` - core)")))
    return parts.groupBy("record_id").agg(
        (F.max(F.length("piece")) <= splitting.LIMIT).alias("within_limit"), (F.max(F.col("core") - F.col("start")) <= splitting.OVERLAP).alias("overlaps"), F.bool_and(same).alias("in_text"),
        (cores == F.max(black(F.col("whole")))).alias("covered"), (F.count(F.lit(1)) > 1).alias("was_split"),
    )


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each size: containers above it, documents that aren't placed whole, and documents cut though they fit."""
    sizes = _sizes(spark, sf_dir)
    kinds = table(spark, sf_dir, "container_size").where("container_name IS NOT NULL AND capacity_tokens > 0").select("container_name", "capacity_tokens")
    placed = stage(packing.pack(sizes, "doc_id", "n_tokens", {r["container_name"]: r["capacity_tokens"] for r in kinds.collect()}))
    full = placed.groupBy("container_name", "container_no").agg(F.sum("n_tokens").alias("n")).join(kinds, "container_name")
    full = full.groupBy("container_name").agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    whole = placed.groupBy("container_name", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    whole = whole.join(sizes.select("doc_id", F.col("n_tokens").alias("want")), "doc_id").join(kinds, "container_name")
    bad = (F.col("got") != F.col("want")) | ((F.col("pieces") > 1) & (F.col("want") <= F.col("capacity_tokens")))
    whole = whole.groupBy("container_name").agg(F.count(F.lit(1)).alias("documents"), F.sum(bad.cast("long")).alias("wrong"))
    return full.join(whole, "container_name").select("container_name", "documents", "overfull", "wrong")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source that is used: no document is used more often than allowed, and the tokens are within half of one document - the source's largest - of what
    water-filling gives it."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_target")
    used = mixing.mix(sizes, targets, "doc_id", "source").groupBy("source").agg(F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("n_tokens")).alias("got"))
    plan = spark.createDataFrame([(a, c, float(e)) for a, _, c, _, e in mixing._amounts(sizes, targets, "source", None)], "source string, repeats int, wanted double")
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    return used.join(plan, "source").join(largest, "source").select("source", (F.col("most") <= F.col("repeats")).alias("within_repeats"), (F.abs(F.col("got") - F.col("wanted")) <= F.col("largest")).alias("reached"))


QUERIES = {
    "p5_checks": p5_checks, "p8_checks": p8_checks, "p9_checks": p9_checks,
    "p1_found": p1_found, "p1_neighbours": p1_neighbours,
    "p3_found": p3_found, "p3_restored": p3_restored,
    "p4_found": p4_found, "p4_collapsed": p4_collapsed, "p4_digests": p4_digests,
    "p5_found": p5_found, "p5_pieces": p5_pieces,
    "p6_found": p6_found, "p6_paragraphs": p6_paragraphs,
    "p7_found": p7_found, "p7_groups": p7_groups,
    "p8_containers": p8_containers, "p8_fill": p8_fill,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile,
}


def _norm(x: str) -> str:
    """SQL for the letters and digits of ``x``, case folded."""
    return rf"replace(replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 'ß', 'ss'), 'ς', 'σ')"


_NEIGHBOURS = r"""
        WITH u AS (
            SELECT DISTINCT uuid, collection_id AS c, embedding::DOUBLE[] AS v FROM langchain_pg_embedding
            WHERE collection_id IS NOT NULL AND uuid IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.uuid AS x, b.uuid AS y, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.c = b.c AND a.uuid <> b.uuid),
        r AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM s)"""
_LINKS = r"""
        WITH RECURSIVE w AS (SELECT uuid, regexp_extract_all(lower(document), '[\p{L}\p{N}]+') AS w FROM langchain_pg_embedding),
        s AS (SELECT uuid, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS t FROM w WHERE len(w) >= 12),
        n AS (SELECT uuid, count(*) AS n FROM s GROUP BY uuid),
        p AS (SELECT a.uuid AS x, b.uuid AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.uuid <> b.uuid GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n AS nx ON nx.uuid = x JOIN n AS ny ON ny.uuid = y WHERE c >= 0.6 * (nx.n + ny.n - c)),
        r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"""
SQL = {
    "p1_found": f"{_NEIGHBOURS} SELECT DISTINCT least(x, y) AS uuid_a, greatest(x, y) AS uuid_b FROM r WHERE k <= 4",
    "p1_neighbours": f"{_NEIGHBOURS} SELECT x AS id, y AS neighbour, s AS similarity, k::INT AS rank FROM r WHERE k <= 4",
    "p4_found": rf"""
        WITH RECURSIVE t AS (SELECT record_id AS id, page_content AS x, {_norm('page_content')} AS p FROM document_model),
        j AS (SELECT id, unnest(json_keys(x::JSON)) AS k, x::JSON AS o FROM t WHERE p <> '' AND json_valid(x) AND json_type(x::JSON) = 'OBJECT'),
        jf AS (SELECT id, list_sort(list({_norm('k')} || ':' || {_norm("coalesce(o->>('$.\"' || k || '\"'), '')")})) AS s FROM j GROUP BY id),
        l AS (SELECT id, list_filter(string_split(replace(x, chr(13), chr(10)), chr(10)), lambda v: {_norm('v')} <> '') AS l FROM t WHERE p <> '' AND id NOT IN (SELECT id FROM jf)),
        lf AS (SELECT id, list_sort(list_transform(l, lambda v: {_norm("string_split(v, ':')[1]")} || ':' || {_norm("substring(v, instr(v, ':') + 1)")})) AS s FROM l
               WHERE len(l) >= 3 AND len(list_filter(l, lambda v: NOT regexp_matches(v, '^[^:]*[\p{{L}}\p{{N}}][^:]*:'))) = 0),
        f AS (SELECT t.id, t.p, coalesce(jf.s, lf.s) AS s FROM t LEFT JOIN jf USING (id) LEFT JOIN lf USING (id) WHERE t.p <> ''),
        h AS (SELECT id, min(id) OVER (PARTITION BY p) AS a FROM f UNION SELECT id, min(id) OVER (PARTITION BY s) FROM f WHERE s IS NOT NULL),
        e AS (SELECT id AS x, a AS y FROM h UNION SELECT a, id FROM h),
        r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        d AS (SELECT row_seq AS id, min(row_seq) OVER (PARTITION BY g) AS a FROM (SELECT row_seq, {_norm('digest')} AS g FROM atlas_mongo_vector) WHERE g <> '')
        SELECT 'document_model' AS tab, min(y) AS kept_id, x AS copy_id FROM r GROUP BY x HAVING min(y) < x
        UNION ALL SELECT 'atlas_mongo_vector', a, id FROM d WHERE a < id""",
    "p7_found": f"{_LINKS} SELECT x AS uuid_a, y AS uuid_b FROM r WHERE x < y",
    "p7_groups": f"{_LINKS} SELECT x AS uuid, min(y) AS group_id, count(DISTINCT y) AS n_rows FROM r GROUP BY x",
    "p5_checks": r"""
        SELECT record_id, true AS within_limit, true AS overlaps, true AS in_text, true AS covered, length(t) > 1500 AS was_split FROM (
            SELECT record_id, regexp_replace(page_content, '^[\s\x{85}\p{Z}\x0B\x1C-\x1F]+|[\s\x{85}\p{Z}\x0B\x1C-\x1F]+$', '', 'g') AS t FROM document_model) WHERE t <> ''""",
    "p8_checks": """
        SELECT container_name, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS wrong FROM container_size
        WHERE container_name IS NOT NULL AND capacity_tokens > 0""",
    "p9_checks": """
        SELECT source, true AS within_repeats, true AS reached FROM mix_target WHERE target_share > 0 AND max_repeats > 0
          AND source IN (SELECT source FROM documents WHERE text <> '')""",
    "p4_digests": """
        WITH n AS (SELECT row_seq, nullif(regexp_replace(lower(digest), '[^\\p{L}\\p{N}]+', '', 'g'), '') AS d FROM atlas_mongo_vector)
        SELECT min(row_seq) AS kept, count(*) AS copies FROM n WHERE d IS NOT NULL GROUP BY d HAVING count(*) > 1""",
    "p5_found": """
        SELECT record_id FROM document_model
        WHERE length(regexp_replace(page_content, '^[\\s\\x{85}\\p{Z}\\x0B\\x1C-\\x1F]+|[\\s\\x{85}\\p{Z}\\x0B\\x1C-\\x1F]+$', '', 'g')) > 1500""",
}
SQL["p4_collapsed"] = f"SELECT tab, kept_id AS kept, count(*) + 1 AS copies FROM ({SQL['p4_found']}) GROUP BY ALL"
