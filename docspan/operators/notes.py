"""Note classification. A note is one row; it is split, scored and grouped inside that row, so no job here
shuffles text: only counts are exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.functions.notes import RULES, Rule, best_rule, keywords_in, note_blocks, section_of
from docspan.operators.rows import with_position


def segment_notes(notes: DataFrame) -> DataFrame:
    """note_id, block_no, text, is_code."""
    return with_position(notes, ["note_id"], note_blocks(F.col("content")), "b").select(
        "note_id", (F.col("pos") + 1).alias("block_no"), F.col("b.text").alias("text"), F.col("b.is_code").alias("is_code")
    )


def classify_notes(blocks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blocks with the section each belongs to and the confidence. Each step is used more than once by the
    next, so it stays a projection of its own and is computed once."""
    lowered = blocks.withColumn("lower", F.lower("text"))
    worded = lowered.withColumn("words", keywords_in(F.col("lower"), rules))
    scored = worded.select(*blocks.columns, best_rule(F.col("text"), F.col("lower"), F.col("words"), rules).alias("best"))
    return scored.select(*blocks.columns, section_of(F.col("is_code"), F.col("best"), rules).alias("s")).select(
        *blocks.columns, "s.section_id", "s.section_title", "s.section_order", "s.confidence")


def classified_array(content: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The same for a whole note inside its row: ARRAY<STRUCT<block_no, text, is_code, s>>."""
    lowered = F.transform(note_blocks(content), lambda b, i: F.struct(
        (i + 1).alias("block_no"), b["text"].alias("text"), b["is_code"].alias("is_code"), F.lower(b["text"]).alias("lower")))
    worded = F.transform(lowered, lambda b: F.struct(b.alias("b"), keywords_in(b["lower"], rules).alias("words")))
    scored = F.transform(worded, lambda x: F.struct(
        x["b"].alias("b"), best_rule(x["b"]["text"], x["b"]["lower"], x["words"], rules).alias("best")))
    return F.transform(scored, lambda x: F.struct(
        x["b"]["block_no"].alias("block_no"), x["b"]["text"].alias("text"), x["b"]["is_code"].alias("is_code"),
        section_of(x["b"]["is_code"], x["best"], rules).alias("s")))


def note_sections(notes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per note and section present, in rule order, with its blocks in input order."""
    blocks = F.col("blocks")
    sections = F.array(*[F.struct(F.lit(r.rule_id).alias("section_id"), F.lit(r.title).alias("section_title"),
                                  F.lit(r.order).alias("section_order")) for r in sorted(rules, key=lambda r: r.order)])
    return (
        notes.select("note_id", classified_array(F.col("content"), rules).alias("blocks"))
        .select("note_id", "blocks", F.explode(sections).alias("sec"))
        .select("note_id", "sec.*", F.filter(blocks, lambda b: b["s"]["section_id"] == F.col("sec.section_id")).alias("blocks"))
        .filter(F.size("blocks") > 0)
        .select("note_id", "section_id", "section_title", "section_order", F.transform(
            "blocks", lambda b: F.struct(b["block_no"].alias("block_no"), b["text"].alias("text"), b["is_code"].alias("is_code"),
                                         b["s"]["confidence"].alias("confidence"))).alias("blocks"))
    )


def note_stats(notes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blocks and categorised blocks (confidence above zero) per note."""
    return notes.select("note_id", classified_array(F.col("content"), rules).alias("b")).select(
        "note_id", F.size("b").alias("block_count"),
        F.size(F.filter("b", lambda x: x["s"]["confidence"] > 0)).alias("categorised"),
    )


def section_totals(blocks: DataFrame) -> DataFrame:
    """Blocks per section over the corpus; partial counts are combined before the exchange."""
    return blocks.groupBy("section_id", "section_order").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("confidence") > 0).alias("categorised"))
