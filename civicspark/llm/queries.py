"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import lines, mixing, names, neardup, ranking, repetition, scans, tokens, transcripts
from civicspark.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The first five chunks of each query's combined ranking."""
    return ranking.combined_ranking(table(spark, d, "fused_chunks")).where("position <= 5").select("query_id", "chunk_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.combined_ranking(table(spark, d, "fused_chunks"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every record and chunk with a text."""
    return neardup.edited_copies({"document_records": (table(spark, d, "document_records"), "id", "content_text"), "chunks": (table(spark, d, "chunks"), "id", "content")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids within one group."""
    return neardup.group_pairs(p2_groups(spark, d))


LINE_SOURCE = ["tenant_id", "document_type", "committee_name"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_records").select("id", *LINE_SOURCE, "content_text", "ocr_applied")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines to take out of the records, scans and records without text left out."""
    return lines.found_lines(_records(spark, d).where("not coalesce(ocr_applied, false)"), LINE_SOURCE)


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """All records with their text without repeated lines."""
    out = lines.without_repeated_lines(_records(spark, d), LINE_SOURCE, skip=F.col("ocr_applied"))
    return out.select("id", "clean_text", "lines_cut")


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "document_pages").select("id", "extraction_method", "content_text"), table(spark, d, "document_records").select("id", "ocr_applied", "content_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned pages with a broken word, of furniture, or with misread words."""
    pages, records = _pages(spark, d)
    model = scans.clean_model(pages, records)
    scanned = pages.where("extraction_method is not null and extraction_method not in ('native', 'pdf_text') and content_text <> ''").dropDuplicates(["id"])
    return scans.line_reports(scanned, model, "id", "content_text")


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its text, scanned ones repaired."""
    pages, records = _pages(spark, d)
    out = scans.repaired(pages, scans.clean_model(pages, records), "content_text", ~F.col("extraction_method").isin("native", "pdf_text"))
    return out.select("id", "repaired_text")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its text, scanned ones repaired."""
    pages, records = _pages(spark, d)
    return scans.repaired(records, scans.clean_model(pages, records), "content_text", F.col("ocr_applied")).select("id", "repaired_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = transcripts.turns(table(spark, d, "segments"), table(spark, d, "meetings"), with_text=False)
    return t.select("meeting_id", "first_segment_id", "last_segment_id")


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of all meetings with speaker, times and clean text."""
    return transcripts.turns(table(spark, d, "segments"), table(spark, d, "meetings"))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every spelling of a person or committee."""
    people = names.spellings(table(spark, d, "speaker_profiles"), "tenant_id", "name", "person")
    mapped = table(spark, d, "meetings").select("tenant_id", F.explode(F.map_values("speaker_map")).alias("name"))
    committees = names.spellings(table(spark, d, "document_records"), "tenant_id", "committee_name", "committee")
    return names.linked_names(people.union(names.spellings(mapped, "tenant_id", "name", "person")).union(committees))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one entity."""
    e = p7_entities(spark, d)
    e = cut(e.select("tenant_id", "kind", "name", "entity"))
    return e.withColumnRenamed("name", "name_a").join(e.withColumnRenamed("name", "name_b"), ["tenant_id", "kind", "entity"]).where("name_a < name_b").select("tenant_id", "kind", "name_a", "name_b")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k; [] for null and empty texts."""
    return tokens.encode_table(table(spark, d, "documents").select("doc_id", "text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document of a listed source is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].select("id", "source", "n_tokens", "repeats")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares by source."""
    return mixing.report(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose target exceeds what their cap allows."""
    return p9_report(spark, d).where("exhausted").select("source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least 30 percent repeat earlier content."""
    return repetition.repetition(table(spark, d, "documents").select("doc_id", "text")).where("repetitive").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The exact share of every document: no rule may settle it earlier."""
    return repetition.repetition(table(spark, d, "documents").select("doc_id", "text"), order=[]).select("doc_id", "repeated_share", "repetitive")


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_groups, p4_found, p4_clean, p5_found, p5_pages, p5_records, p6_found, p6_turns, p7_found, p7_entities, p8_ids, p9_found, p9_report, p9_mix, p10_found, p10_shares)}

SQL: dict[str, str] = {
    "p4_found": r"""
        WITH d AS (
            SELECT id, tenant_id, document_type, committee_name, string_split(content_text, chr(10)) AS ls
            FROM document_records WHERE length(content_text) > 0 AND ocr_applied IS DISTINCT FROM TRUE),
        l AS (
            SELECT id, tenant_id, document_type, committee_name, generate_subscripts(ls, 1) - 1 AS line_no,
                   regexp_replace(regexp_replace(lower(unnest(ls)), '\s+', '', 'g'), '\d([\d.,:/-]*\d)?', '0', 'g') AS k FROM d),
        n AS (SELECT tenant_id, document_type, committee_name, count(*) AS docs FROM d GROUP BY ALL),
        c AS (SELECT tenant_id, document_type, committee_name, k, count(DISTINCT id) AS n FROM l WHERE k <> '' GROUP BY ALL)
        SELECT l.id AS document_id, CAST(l.line_no AS INT) AS line_no
        FROM l JOIN c ON l.k = c.k AND l.tenant_id IS NOT DISTINCT FROM c.tenant_id AND l.document_type IS NOT DISTINCT FROM c.document_type
                     AND l.committee_name IS NOT DISTINCT FROM c.committee_name
               JOIN n ON l.tenant_id IS NOT DISTINCT FROM n.tenant_id AND l.document_type IS NOT DISTINCT FROM n.document_type
                     AND l.committee_name IS NOT DISTINCT FROM n.committee_name
        WHERE c.n >= 5 AND c.n * 5 >= n.docs""",
}
